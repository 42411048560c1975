"""Spatial features at the user's level: rings as arrays of points, areas, bounds, containment by a grid join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signed_area(ring: Column) -> Column:
    """Shoelace sum of a closed ring of (x, y), twice the signed area."""
    ahead = F.slice(ring, F.lit(2), F.size(ring) - 1)
    return F.aggregate(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)


def bounds(ring: Column) -> Column:
    """Struct of the least and greatest coordinates."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray test."""
    ahead = F.slice(ring, F.lit(2), F.size(ring) - 1)
    crosses = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), ahead, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.aggregate(crosses, F.lit(0), lambda s, c: s + F.when(c, 1).otherwise(0)) % 2 == 1


#: Parts into which the points of one ring are dealt.
DEALT = 16


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(point_id, polygon_id) by an equi-join on grid cells and the exact test; a polygon is in the cells of its bounds.

    Each place is tested once against each ring, however many points and polygons are there; plain joins then give the
    pairs, so that a pair costs a row and no test. Rings are told apart by 128 bits of hash. The points of a ring are dealt
    into ``DEALT`` parts, and these over a fixed number of tasks: rows out grow by points times polygons, not by rows in.
    """
    keyed = polygons.select("polygon_id", "ring", F.xxhash64("ring").alias("ring_a"), F.xxhash64(F.lit(1), "ring").alias("ring_b"))
    spread = keyed.select("ring", "ring_a", "ring_b").distinct().withColumn("b", bounds(F.col("ring")))
    across = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    spread = spread.withColumn("cx", F.explode(across(F.col("b.x0"), F.col("b.x1")))).withColumn("cy", F.explode(across(F.col("b.y0"), F.col("b.y1"))))
    places = points.select("x", "y").distinct().withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    hits = places.join(spread, ["cx", "cy"]).filter(inside(F.col("ring"), F.col("x"), F.col("y"))).select("x", "y", "ring_a", "ring_b")
    on, tasks = ["ring_a", "ring_b", "part"], int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = points.join(hits, ["x", "y"]).select("point_id", "ring_a", "ring_b", F.pmod(F.xxhash64("point_id"), F.lit(DEALT)).cast("int").alias("part"))
    held = keyed.select("polygon_id", "ring_a", "ring_b", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    return met.repartition(tasks, *on).join(held, on).select("point_id", "polygon_id")


def interior_point(ring: Column) -> Column:
    """A point inside a closed ring: halfway between the first two crossings of a line between its two lowest heights; null if it is flat."""
    heights = F.array_sort(F.array_distinct(F.transform(ring, lambda p: p["y"])))
    level = (F.get(heights, F.lit(0)) + F.get(heights, F.lit(1))) / 2

    def point(y: Column) -> Column:
        ahead = F.slice(ring, F.lit(2), F.size(ring) - 1)
        across = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), ahead, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
        xs = F.array_sort(F.filter(across, lambda x: x.isNotNull()))
        return F.when(F.size(xs) >= 2, F.struct(((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).alias("x"), y.alias("y")))

    return F.get(F.transform(F.array(level), point), F.lit(0))


def assemble_polygons(rings: DataFrame) -> DataFrame:
    """(feature_id, shell_no, ring, holes): the polygons of ``rings (feature_id, ring_no, ring)``, holes as sorted ring numbers.

    Rings of under four points are no rings. A negative signed area makes a shell, any other a hole; a feature without
    shells has its holes as shells. A hole belongs to every shell of its feature that holds a point inside it, found by a
    join on the cells of a grid that has as many cells over a feature as it has shells; a hole in no shell is left out.
    """
    kept = rings.filter(F.size("ring") >= 4).select("feature_id", "ring_no", "ring", (signed_area(F.col("ring")) < 0).alias("negative"), bounds(F.col("ring")).alias("b"))
    sizes = kept.groupBy("feature_id").agg(
        F.bool_or("negative").alias("has_shell"), F.count_if("negative").alias("n_shells"), F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"),
        F.greatest(F.max("b.x1") - F.min("b.x0"), F.max("b.y1") - F.min("b.y0")).alias("extent"),
    )
    cell = F.greatest(F.col("extent") / F.ceil(F.sqrt(F.greatest("n_shells", F.lit(1)))), F.lit(1e-12))
    rows = kept.join(sizes.withColumn("cell", cell), "feature_id").withColumn("shell", F.col("negative") | ~F.col("has_shell"))
    at = lambda v, low: F.floor((v - F.col(low)) / F.col("cell"))
    shells = rows.filter("shell").select("feature_id", F.col("ring_no").alias("shell_no"), "ring", "b", "x0", "y0", "cell")
    cells = shells.select("feature_id", "shell_no", "ring", "b", "y0", "cell", F.explode(F.sequence(at(F.col("b.x0"), "x0"), at(F.col("b.x1"), "x0"))).alias("cx")).select("feature_id", "shell_no", "ring", "cx", F.explode(F.sequence(at(F.col("b.y0"), "y0"), at(F.col("b.y1"), "y0"))).alias("cy"))
    points = rows.filter("not shell").withColumn("p", interior_point(F.col("ring"))).filter("p is not null").select("feature_id", F.col("ring_no").alias("hole_no"), "p", at(F.col("p.x"), "x0").alias("cx"), at(F.col("p.y"), "y0").alias("cy"))
    held = points.join(cells, ["feature_id", "cx", "cy"]).filter(inside(F.col("ring"), F.col("p.x"), F.col("p.y")))
    holes = held.groupBy("feature_id", "shell_no").agg(F.array_sort(F.collect_list("hole_no")).alias("holes"))
    return shells.select("feature_id", "shell_no", "ring").join(holes, ["feature_id", "shell_no"], "left").withColumn("holes", F.coalesce("holes", F.array().cast("array<int>")))
