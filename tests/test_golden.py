"""The published catalogue and its published best portfolio, rejected gaps and price of forcing a measure."""

import pytest
from pyspark.sql import functions as F

from robustspark.operators import cells, portfolios

#: Measure, dimension, cost.
CATALOGUE = [
    ("bio_psa", "biodiversity", 1200), ("bio_restore", "biodiversity", 1500), ("bio_pa", "biodiversity", 700), ("water_eff", "water", 900), ("water_riparian", "water", 1300), ("water_head", "water", 1600), ("food_soil", "food", 1000),
    ("food_agro", "food", 800), ("hab_green", "habitat", 1000), ("hab_suds", "habitat", 1800), ("infra_resilient", "infrastructure", 2500), ("infra_services", "infrastructure", 2000), ("risk_sat", "disaster", 1200), ("risk_knowledge", "disaster", 600), ("health", "health", 800),
]
#: Class of each unit by dimension, capacities, records of each unit, matches, weights and budget.
DIMENSIONS = ("disaster", "habitat", "water", "infrastructure", "health", "biodiversity", "food")
CLASSES = {"rionegro": (4, 1, 3, 3, 1, 5, 2), "guarne": (4, 2, 3, 4, 2, 3, 2), "marinilla": (1, 2, 4, 1, 2, 5, 1)}
CAPACITY = [("rionegro", "biodiversity", 0.22), ("marinilla", "biodiversity", 0.24), ("guarne", "biodiversity", 0.33), ("rionegro", "disaster", 0.56), ("marinilla", "disaster", 0.61)]
RECORDS = {"rionegro": 11, "guarne": 16, "marinilla": 1}
MATCHES = [("bio_psa", "rionegro", 1), ("bio_restore", "rionegro", 2), ("water_riparian", "rionegro", 1), ("bio_psa", "guarne", 3), ("bio_restore", "guarne", 1), ("food_agro", "guarne", 4)]
BUDGET, W_VULN, W_REC, PENALTY, MIN_RECORDS = 5000, 0.7, 0.15, 0.35, 5
BEST = "bio_pa|bio_psa|food_agro|health|risk_knowledge|water_eff"
GAPS = {"hab_green": 2500, "infra_services": 2500, "risk_sat": 86500, "food_soil": 152500, "bio_restore": 205000, "water_riparian": 207500, "water_head": 245000, "hab_suds": 282500, "infra_resilient": 432500}


@pytest.fixture(scope="module")
def scored(spark):
    measures = spark.createDataFrame([(m, i, d, c) for i, (m, d, c) in enumerate(CATALOGUE)], "measure_id string, measure_no int, dimension_id string, cost long")
    classes = spark.createDataFrame([(u, d, k) for u, ks in CLASSES.items() for d, k in zip(DIMENSIONS, ks, strict=True)], "unit_id string, dimension_id string, class_no int")
    capacity = spark.createDataFrame(CAPACITY, "unit_id string, dimension_id string, capacity double")
    coverage, matches = spark.createDataFrame(list(RECORDS.items()), "unit_id string, records long"), spark.createDataFrame(MATCHES, "measure_id string, unit_id string, matches long")
    model = spark.createDataFrame([(MIN_RECORDS,)], "min_records long")
    placed = cells.place_measures(measures, classes, capacity, coverage, matches, model)
    rec = cells.recurrence_term(placed, model, cells.max_adequate(coverage, matches, model))
    top = placed.groupBy("measure_id").agg(F.max("class_no").alias("class_no"))
    rows = measures.join(top, "measure_id").join(rec, "measure_id")
    terms = rows.select("measure_id", "measure_no", "dimension_id", "cost", "class_no", cells.micro(W_VULN * cells.class_score(F.col("class_no"))).alias("vuln"), cells.micro(W_REC * F.col("rec_share")).alias("rec"), F.lit(0).cast("long").alias("cob"))
    sets = portfolios.enumerate_portfolios(spark, measures, spark.createDataFrame([(BUDGET,)], "budget long"), len(CATALOGUE))
    return measures, sets.join(portfolios.scores(sets, terms, PENALTY), "set_id").cache()


def test_best_portfolio(scored):
    best = portfolios.best(scored[1], -F.col("score")).first()
    assert (best["ids"], best["cost"], best["score"]) == (BEST, 5000, 2_812_500)


def test_rejected_gaps(scored):
    measures, rows = scored
    top = portfolios.best(rows, -F.col("score")).first()["score"]
    got = {r["measure_id"]: top - r["score"] for r in portfolios.best_by_measure(rows, measures).collect()}
    assert {m: g for m, g in got.items() if m not in BEST.split("|")} == GAPS and all(got[m] == 0 for m in BEST.split("|"))


def test_forcing_the_grey_measure(scored):
    """What the constraint costs: a score of 2.38 instead of 2.8125."""
    forced = portfolios.best(scored[1].filter(F.contains("ids", F.lit("infra_resilient"))), -F.col("score")).first()
    assert forced["score"] == 2_380_000 and round(100 * (1 - forced["score"] / 2_812_500), 4) == 15.3778
