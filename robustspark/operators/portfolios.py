"""Portfolios: every set of measures within a budget, its exact score, and what the best set looks like.

Scores are whole micro-units, so sums don't depend on their order; ties end in cost, then the joined ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Above so many measures, sets are grown from feasible prefixes instead of tested one by one.
RANGE_LIMIT = 24


def member(set_id: Column, number: Column) -> Column:
    """Whether a bit of a set is on."""
    return F.expr("1") == F.call_function("getbit", set_id, number)


def enumerate_portfolios(spark: SparkSession, measures: DataFrame, budget: DataFrame, count: int) -> DataFrame:
    """Non-empty sets whose cost fits: set_id (a bit per measure_no), n, cost, ids. ``measures`` and ``budget`` are small."""
    if count > RANGE_LIMIT:
        return _grown(measures, budget, count)
    catalogue = measures.agg(F.array_sort(F.collect_list(F.struct("measure_no", "cost", "measure_id"))).alias("all"))
    sets = spark.range(1, 2**count).withColumnRenamed("id", "set_id").crossJoin(F.broadcast(catalogue)).crossJoin(F.broadcast(budget))
    chosen = F.filter("all", lambda m: member(F.col("set_id"), m["measure_no"]))
    sets = sets.select("set_id", "budget", chosen.alias("chosen")).withColumn("cost", F.aggregate("chosen", F.lit(0).cast("long"), lambda s, m: s + m["cost"]))
    fit = sets.filter("cost <= budget")
    return fit.select("set_id", F.size("chosen").alias("n"), "cost", F.array_join(F.array_sort(F.transform("chosen", lambda m: m["measure_id"])), "|").alias("ids"))


def _grown(measures: DataFrame, budget: DataFrame, count: int) -> DataFrame:
    """Level by level, only prefixes that fit are extended by a measure of higher number."""
    one = measures.select("measure_no", "measure_id", F.col("cost").alias("c"))
    level = one.crossJoin(budget).filter("c <= budget").select(F.shiftleft(F.lit(1).cast("long"), 0).alias("x"), "measure_no", "c", "budget", F.array("measure_id").alias("m"))
    level = level.select(F.expr("shiftleft(cast(1 as bigint), measure_no)").alias("set_id"), F.col("measure_no").alias("last"), F.col("c").alias("cost"), "budget", "m")
    out = level
    for _ in range(count - 1):
        level = level.join(F.broadcast(one), (F.col("measure_no") > F.col("last")) & (F.col("cost") + F.col("c") <= F.col("budget")))
        level = level.select(F.expr("set_id + shiftleft(cast(1 as bigint), measure_no)").alias("set_id"), F.col("measure_no").alias("last"), (F.col("cost") + F.col("c")).alias("cost"), "budget", F.concat("m", F.array("measure_id")).alias("m"))
        out = out.unionByName(level)
    return out.select("set_id", F.size("m").alias("n"), "cost", F.array_join(F.array_sort("m"), "|").alias("ids"))


def members(sets: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per set and measure in it; the terms of the catalogue are small."""
    return sets.join(F.broadcast(terms.withColumnRenamed("cost", "measure_cost")), member(F.col("set_id"), F.col("measure_no")))


def parts(rows: DataFrame, penalty: float, with_cob: bool = False, gate: tuple[int, float] | None = None, by: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Contribution of each member: in a dimension the first by total, then id, keeps its full term, the others ``penalty`` of it.

    The totals that order a dimension have no co-benefit unless ``with_cob``; a gate (class, factor) scales by class and
    divides by cost.
    """
    cob = F.col("cob") if with_cob else F.lit(0)
    total = F.col("vuln") + F.coalesce("rec", F.lit(0)) + cob
    order = F.row_number().over(Window.partitionBy(*by, "dimension_id").orderBy(total.desc(), "measure_id"))
    kept = F.when(F.col("place") == 1, F.col("vuln")).otherwise(F.floor(F.col("vuln") * F.lit(penalty) + 0.5).cast("long"))
    out = rows.withColumn("place", order).withColumn("part", kept + F.coalesce("rec", F.lit(0)) + cob)
    if gate:
        scaled = F.col("part") * F.when(F.col("class_no") >= gate[0], 1.0).otherwise(gate[1]) / F.col("measure_cost")
        out = out.withColumn("part", F.floor(scaled * 1000 + 0.5).cast("long"))
    return out


def scores(sets: DataFrame, terms: DataFrame, penalty: float, name: str = "score", **options) -> DataFrame:
    """The score of every set."""
    return parts(members(sets, terms), penalty, **options).groupBy("set_id").agg(F.sum("part").alias(name))


def best(scored: DataFrame, *keys: Column) -> DataFrame:
    """The set that is first by the keys, then cost, then ids; one row, found by a partially aggregated minimum."""
    order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate((*keys, F.col("cost"), F.col("ids")))))
    return scored.agg(F.min_by(F.struct(*scored.columns), order).alias("b")).select("b.*")


def best_by_measure(scored: DataFrame, measures: DataFrame, inside: bool = True) -> DataFrame:
    """Per measure the best set with it (or without it)."""
    has = member(F.col("set_id"), F.col("measure_no"))
    rows = scored.join(F.broadcast(measures.select("measure_id", "measure_no")), has if inside else ~has)
    return rows.groupBy("measure_id").agg(F.min_by(F.struct("set_id", "score", "cost", "ids"), F.struct((-F.col("score")).alias("s"), "cost", "ids")).alias("b")).select("measure_id", "b.*")
