"""Rules that the tables do not reach: golden portfolios, strata, planted boxes, missing data, geometry."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from robustspark.operators import audit, boxes, cells, portfolios, spatial, worlds

#: A published catalogue of 15 measures (id, cost).
COSTS = dict(bio_psa=1200, bio_restore=1500, bio_pa=700, water_eff=900, water_riparian=1300, water_head=1600, food_soil=1000, food_agro=800, hab_green=1000, hab_suds=1800, infra_resilient=2500, infra_services=2000, risk_sat=1200, risk_knowledge=600, health=800)


def catalogue(spark):
    rows = [(k, i, c) for i, (k, c) in enumerate(COSTS.items())]
    return spark.createDataFrame(rows, "measure_id string, measure_no int, cost long"), spark.createDataFrame([(5000,)], "budget long")


def test_golden_space(spark):
    measures, budget = catalogue(spark)
    sets = portfolios.enumerate_portfolios(spark, measures, budget, 15).toPandas()
    assert len(sets) == 1566
    assert sets.n.value_counts().sort_index().tolist() == [15, 105, 419, 717, 303, 7]


def test_grown_space_is_the_same(spark):
    measures, budget = catalogue(spark)
    one = portfolios.enumerate_portfolios(spark, measures, budget, 15).select("set_id", "n", "cost", "ids")
    two = portfolios._grown(measures, budget, 15).select("set_id", "n", "cost", "ids")
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_strata_are_permutations(spark):
    for n in (1, 2, 7, 1000, 1025):
        got = worlds.latin_hypercube(spark, n, 2, 3).toPandas()
        for c in ("u0", "u1"):
            assert sorted(np.floor(got[c].to_numpy() * n + 1e-9).astype(int)) == list(range(n))


def test_planted_box(spark):
    rng = np.random.default_rng(3)
    x = rng.random((1500, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(int)
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y int")
    path = boxes.prim(rows, ("a", "b", "c"), "y")
    assert path[-1]["density"] > 0.9 and path[-1]["coverage"] > 0.7
    assert {p["name"] for p in path[:6]} <= {"a", "b"}


def test_missing_capacity_never_breaks_a_tie(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    measures = one([("m", "d")], "measure_id string, dimension_id string")
    classes = one([(1, "d", 4), (2, "d", 4), (3, "d", 2)], "unit_id int, dimension_id string, class_no int")
    capacity = one([(1, "d", 0.3)], "unit_id int, dimension_id string, capacity double")
    coverage = one([(1, 9), (2, 1), (3, 9)], "unit_id int, records long")
    matches = one([("m", 1, 3)], "measure_id string, unit_id int, matches long")
    model = one([(5,)], "min_records long")
    placed = cells.place_measures(measures, classes, capacity, coverage, matches, model)
    assert sorted(r["unit_id"] for r in placed.collect()) == [1, 2]
    withheld = cells.recurrence_term(placed, model, one([(4,)], "denominator long")).first()
    assert withheld["rec_share"] is None


def test_excerpts_are_those_of_a_plain_search(spark):
    def plain(text, needle):
        found = []
        for m in re.finditer(re.escape(needle), text or "", re.IGNORECASE):
            snippet = " ".join(text[max(0, m.start() - 90) : m.end() + 140].split())
            if snippet not in found:
                found.append(snippet)
        return found[:2]

    rng = random.Random(5)
    texts = [None, "", "token", "TOKENtoken", "a.b\n\n a.b", "axb", " token" * 60, "é" * 200 + "Token" + "\t" * 200 + "tOKEN"]
    texts += [" ".join(rng.choice(["token", "Token.", "a.b", "a", "é\n", "word"]) for _ in range(n)) for n in (3, 40, 200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for needle in ("token", "a.b"):
        got = {r["i"]: r["x"] for r in rows.select("i", audit.excerpts(F.col("t"), needle).alias("x")).collect()}
        assert got == {i: plain(t, needle) for i, t in enumerate(texts)}


def test_verbatim_takes_the_first_claim_and_whole_quotes(spark):
    findings = spark.createDataFrame([(1, 0, " has it "), (1, 1, "has it not"), (1, 2, "has"), (2, 0, "has it"), (1, 3, "has it"), (1, 4, None)], "bundle int, finding int, quote string")
    claims = spark.createDataFrame([(1, 5, "who has it"), (1, 2, "has it all"), (1, 0, "HAS IT"), (2, 0, None)], "bundle int, position int, text string")
    got = sorted((r["bundle"], r["finding"], r["claim"]) for r in audit.verbatim(findings, claims).collect())
    assert got == [(1, 0, 2), (1, 3, 2)]


def test_numbers_and_rings(spark):
    row = spark.createDataFrame([("Suma 5.000 y 2,87 de 17 casos en S3-7.0",)], "t string")
    got = row.select(audit.numbers(F.col("t")).alias("n")).first()["n"]
    assert got == ["5.000", "2,87", "17"]
    ring = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)],)], "ring array<struct<x: double, y: double>>")
    got = ring.select(spatial.signed_area(F.col("ring")).alias("a"), spatial.inside(F.col("ring"), F.lit(1.0), F.lit(1.0)).alias("i"), spatial.inside(F.col("ring"), F.lit(3.0), F.lit(1.0)).alias("o")).first()
    assert (got["a"], got["i"], got["o"]) == (8.0, True, False)
