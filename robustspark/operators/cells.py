"""Cells, placement and per-measure terms. Missing data stays null; only sums read a null recurrence as nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("unit_id", "dimension_id")


def micro(x: Column) -> Column:
    """Whole micro-units, half rounded up."""
    return F.floor(x * 1e6 + 0.5).cast("long")


def resolve_class(rows: DataFrame) -> DataFrame:
    """Per cell the first row with value and class, else the first with a class; a minimum, so it is partially aggregated."""
    known = rows.filter("class_no is not null")
    return known.groupBy(*CELL).agg(F.min_by("class_no", F.struct(F.col("value").isNull(), "row_no")).alias("class_no"))


def resolve_capacity(rows: DataFrame) -> DataFrame:
    """Per cell the first known capacity."""
    return rows.filter("value is not null").groupBy(*CELL).agg(F.min_by("value", "row_no").alias("capacity"))


def class_score(class_no: Column, gamma: Column | None = None) -> Column:
    """Classes 1 to 5 as 0.2 to 1.0, to the power gamma (1 or 2)."""
    score = class_no / 5.0
    return score if gamma is None else F.when(gamma == 2, score * score).otherwise(score)


def shifted(class_no: Column, flag: Column) -> Column:
    """One class higher where flagged, at most 5."""
    return F.least(F.lit(5), class_no + F.when(flag, 1).otherwise(0))


def record_counts(records: DataFrame) -> DataFrame:
    """Records per unit and measure, null where none is matched: all that coverage and matches need of the records."""
    return records.groupBy("unit_id", "measure_id").agg(F.count("*").alias("n"))


def coverage_of(units: DataFrame, counts: DataFrame) -> DataFrame:
    """Records per unit, from ``record_counts``; units without records are kept with 0."""
    counts = counts.groupBy("unit_id").agg(F.sum("n").alias("n"))
    return units.select("unit_id").join(counts, "unit_id", "left").select("unit_id", F.coalesce("n", F.lit(0)).alias("records"))


def match_counts(counts: DataFrame) -> DataFrame:
    """Matches per measure and unit, from ``record_counts``."""
    return counts.filter("measure_id is not null").select("measure_id", "unit_id", F.col("n").alias("matches"))


def max_adequate(coverage: DataFrame, matches: DataFrame, model: DataFrame) -> DataFrame:
    """The most matches of a measure in a unit with enough records, 0 if none; one row."""
    enough = coverage.crossJoin(model).filter("records >= min_records").select("unit_id")  # model has one row
    return matches.join(enough, "unit_id", "left_semi").agg(F.coalesce(F.max("matches"), F.lit(0)).alias("denominator"))


def place_measures(measures: DataFrame, cells: DataFrame, capacity: DataFrame, coverage: DataFrame, matches: DataFrame, model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of each measure (in each world, for ``by``): highest class; lowest capacity if all tied have one; most
    matches if all tied have enough records; else the tie stays. One row per candidate, with the tie steps taken."""
    key = [*by, "measure_id"]
    w = Window.partitionBy(*key)
    rows = measures.select("measure_id", "dimension_id").join(cells, "dimension_id").filter("class_no is not null")
    rows = rows.withColumn("top", F.max("class_no").over(w)).filter("class_no = top")
    rows = rows.join(capacity, list(CELL), "left").join(coverage, "unit_id", "left").join(matches, ["measure_id", "unit_id"], "left").crossJoin(model)
    rows = rows.withColumns({"tied": F.count("*").over(w), "with_capacity": F.count("capacity").over(w), "lowest": F.min("capacity").over(w)})
    by_capacity = (F.col("tied") > 1) & (F.col("with_capacity") == F.col("tied"))
    rows = rows.withColumn("step_capacity", by_capacity).filter(~by_capacity | (F.col("capacity") == F.col("lowest")))
    rows = rows.withColumns({"left_": F.count("*").over(w), "thin": F.min("records").over(w) < F.col("min_records"), "most": F.max(F.coalesce("matches", F.lit(0))).over(w)})
    by_records = (F.col("left_") > 1) & ~F.col("thin")
    rows = rows.withColumn("step_records", by_records).filter(~by_records | (F.coalesce("matches", F.lit(0)) == F.col("most")))
    return rows.select(*key, "dimension_id", "unit_id", F.col("top").alias("class_no"), "records", F.coalesce("matches", F.lit(0)).alias("matches"), "step_capacity", "step_records")


def recurrence_term(placed: DataFrame, model: DataFrame, denominator: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the most matches; null if any candidate has too few records."""
    rows = placed.crossJoin(model).crossJoin(denominator)  # one row each
    share = F.when(F.first("denominator") > 0, F.max("matches") / F.first("denominator")).otherwise(0.0)
    return rows.groupBy(*by, "measure_id").agg(F.when(F.min("records") >= F.first("min_records"), share).alias("rec_share"))


def cobenefit_term(placed: DataFrame, measures: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least class over the candidates in the measure's co-benefit dimension."""
    named = measures.filter("cob_dim is not null").select("measure_id", F.col("cob_dim"))
    other = cells.select(*by, F.col("unit_id"), F.col("dimension_id").alias("cob_dim"), F.col("class_no").alias("cob_class"))
    return placed.join(named, "measure_id").join(other, [*by, "unit_id", "cob_dim"], "left").groupBy(*by, "measure_id").agg(F.min("cob_class").alias("cob_class"))


def lever_profiles(units: DataFrame, dims: DataFrame, readings: DataFrame) -> DataFrame:
    """The full grid of cells with profile and needed lever; unknown readings never ask for a lever."""
    grid = units.select("unit_id").crossJoin(F.broadcast(dims.select("dimension_id"))).join(readings, list(CELL), "left")
    s, ca = F.col("s_level"), F.col("ca_level")
    full = s.isNotNull() & ca.isNotNull()
    profile = (
        F.when(full & (s >= 4) & (ca >= 2), "reduce_s").when(full & (s >= 4), "both").when(full & (ca < 2), "raise_ca").when(full, "no_lever")
        .when(s.isNotNull() | ca.isNotNull(), "partial").otherwise("unknown")
    )
    return grid.withColumn("profile", profile).withColumn("needed", F.when(F.col("profile") == "reduce_s", "S").when(F.col("profile") == "raise_ca", "CA"))


def lever_fit(placed: DataFrame, measures: DataFrame, profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether every candidate cell needs another lever than the measure's."""
    rows = placed.join(measures.select("measure_id", "lever"), "measure_id").join(profiles.select(*CELL, "needed"), list(CELL), "left")
    wrong = F.col("needed").isNotNull() & (F.col("lever") != "S+CA") & (F.col("lever") != F.col("needed"))
    return rows.groupBy(*by, "measure_id").agg(F.bool_and(wrong).alias("mismatch"))


def urgency_term(placed: DataFrame, measures: DataFrame, unit_id: int, dimension_id: str, weight: float) -> DataFrame:
    """Extra score of measures of one dimension whose candidates include the unit, or whose scope is the corridor."""
    there = placed.groupBy("measure_id").agg(F.bool_or(F.col("unit_id") == unit_id).alias("there"), F.max("class_no").alias("class_no"))
    hit = (F.col("dimension_id") == dimension_id) & (F.col("there") | (F.col("scope") == "corridor"))
    extra = F.when(hit, micro(weight * (F.least(F.lit(1.0), (F.col("class_no") + 1) / 5.0) - F.col("class_no") / 5.0))).otherwise(F.lit(0).cast("long"))
    return measures.join(there, "measure_id").select("measure_id", extra.alias("urgency_micro"))
