"""Exact order statistics of distributed columns, by counting in ranges that close in on a place.

A pass counts the values of each range in ``BINS`` equal parts, with the least and greatest value of each part; the part
that holds the wanted place is the next range, until it holds one value. Counts are partially aggregated, so no column is
sorted or gathered, and at most BINS rows for each wanted place come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def part_of(value: Column, low: Column, high: Column) -> Column:
    """The part of the range [low, high] that holds ``value``; halves keep the widest ranges finite."""
    share = (value / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    return F.coalesce(F.least(F.lit(BINS - 1), F.floor(share * BINS)), F.lit(0)).cast("int")


def order_statistics(rows: DataFrame, key: str, value: str, places: dict) -> dict:
    """The values at 0-based ``places`` (key: list of places) of each group of ``rows (key, value)``: {(key, place): value}.

    Groups are few; nulls are left out, places beyond a group's size have no answer. ``rows`` are read once a pass, and should be kept.
    """
    own = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in own.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    # of each wanted place the range that holds it, and how many values lie below the range
    wanted = {(k, p): (*ends[k][1:], 0) for k, ps in places.items() for p in ps if k in ends and 0 <= p < ends[k][0]}
    kind = own.schema["k"].dataType.simpleString()
    while open_ := sorted({(k, lo, hi) for (k, _), (lo, hi, _) in wanted.items() if lo < hi}, key=repr):
        ranges = F.broadcast(own.sparkSession.createDataFrame(open_, f"r_k {kind}, lo double, hi double"))  # a row for each wanted place at most
        met = own.join(ranges, F.col("k").eqNullSafe(F.col("r_k")) & F.col("v").between(F.col("lo"), F.col("hi")))
        parts = met.groupBy("k", "lo", "hi", part_of(F.col("v"), F.col("lo"), F.col("hi")).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        counted: dict = {}
        for r in parts.collect():
            counted.setdefault((r["k"], r["lo"], r["hi"]), []).append((r["part"], r["n"], r["least"], r["most"]))
        for (k, p), (lo, hi, below) in wanted.items():
            if lo < hi:
                for _, n, least, most in sorted(counted[k, lo, hi]):
                    if p < below + n:
                        wanted[k, p] = (least, most, below)
                        break
                    below += n
    return {x: lo for x, (lo, _, _) in wanted.items()}


def quantiles(rows: DataFrame, key: str, value: str, fractions: Sequence[float]) -> dict:
    """Quantiles between neighbours in proportion: {(key, fraction): value}; groups without values have none."""
    sizes = {r[0]: r[1] for r in rows.filter(F.col(value).isNotNull()).groupBy(key).count().collect()}
    places = {k: sorted({x for q in fractions for x in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}) for k, n in sizes.items()}
    found = order_statistics(rows, key, value, places)
    out = {}
    for k, n in sizes.items():
        for q in fractions:
            at = (n - 1) * q
            low, high = found[k, math.floor(at)], found[k, math.ceil(at)]
            out[k, q] = low + (high - low) * (at - math.floor(at))
    return out
