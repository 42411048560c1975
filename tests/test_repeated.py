"""Steps whose inputs repeat the same places, rings, leaves or texts very often."""

import re

import pandas as pd
from pyspark.sql import functions as F

from robustspark.operators import evidence as E
from robustspark.operators import spatial as S
from robustspark.operators import text as X


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_points_in_polygons_against_all_pairs(spark):
    """Repeated places, rings and ids, null ids and a null ring give a row for every pair of rows."""
    points = [(k % 40, k % 7 + 0.5, k % 11 + 0.5) for k in range(150)] + [(None, 1.5, 1.5), (None, 1.5, 1.5)]
    polygons = [(k % 9, square(float(k % 5), float(k % 3 * 4), 3.0 + k % 2)) for k in range(30)] + [(None, square(0.0, 0.0, 9.0)), (3, None)]
    inside = lambda ring, x, y: ring is not None and ring[0][0] < x < ring[2][0] and ring[0][1] < y < ring[2][1]
    want = sorted(((p, q) for p, x, y in points for q, ring in polygons if inside(ring, x, y)), key=repr)
    rows = spark.createDataFrame(points, "point_id long, x double, y double")
    shapes = spark.createDataFrame(polygons, "polygon_id long, ring array<struct<x: double, y: double>>")
    assert sorted((tuple(r) for r in S.points_in_polygons(rows, shapes, 2.0).collect()), key=repr) == want


def test_a_place_is_tested_once_against_a_ring(spark, monkeypatch):
    """600 points at 12 places and 200 polygons of one ring: 60,000 pairs, but 12 tests."""
    tests, exact = spark.sparkContext.accumulator(0), S.inside

    @F.pandas_udf("boolean")
    def counted(ok: pd.Series) -> pd.Series:
        tests.add(len(ok))
        return ok

    monkeypatch.setattr(S, "inside", lambda ring, x, y: counted(exact(ring, x, y)))
    points = spark.range(600).select(F.col("id").alias("point_id"), (F.col("id") % 12 + 0.5).alias("x"), F.lit(0.5).alias("y"))
    polygons = spark.createDataFrame([(k, square(0.0, 0.0, 6.0)) for k in range(200)], "polygon_id long, ring array<struct<x: double, y: double>>")
    assert S.points_in_polygons(points, polygons, 100.0).agg(F.count("point_id"), F.sum("polygon_id")).first() == (60_000, 300 * 199 * 100)
    assert tests.value == 12


def test_no_step_deals_the_figures_by_what_they_cite_alone(spark):
    """All data is one pool, and claims without an output have no key: neither may come to one task."""
    words = E.Wording((), "", "")
    rows = [("p", k, "It is 2,5 and 7", None if k % 3 else "s", "f1" if k % 3 == 1 else None, [2.5] if k % 2 else None) for k in range(30)]
    claims = spark.createDataFrame(rows, "product string, claim int, text string, source_id string, fingerprint string, numbers array<double>")
    leaves, known = spark.createDataFrame([("f1", 2.5)], "fingerprint string, value double"), spark.createDataFrame([("f1",)], "fingerprint string")
    data = spark.createDataFrame([(2.5,), (7.0,), (7.0,)], "value double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, status = E.check_numbers(claims, leaves, known, data, words)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, status)]
        assert "Exchange hashpartitioning" in plans[0] and not [x for p in plans for x in re.findall(r"hashpartitioning\((?:pool|leaf_key)#\d+, \d+", p)]
        assert sorted(r["claim"] for r in status.collect() if r["verified"]) == [k for k in range(30) if k % 6 == 0]
        assert {(r["claim"] % 3, r["check_name"]) for r in found.collect()} == {(0, "figure not in output"), (1, "figure not in output"), (2, "figures without citation")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_plain_texts_are_folded_without_python(spark):
    """Only texts with other than ASCII characters go to a task's Python, and these in small pieces."""
    texts = [" A\tB\x0b\x0c\r\n c ", "", None, "\x1c x\x1dy\x1e\x1f", "z\x00\x7f Z", "É  Ü", "ﬁn\u3000x", "a\x85b", "\x85"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r["f"] for r in rows.select("k", X.folded(F.col("t")).alias("f")).orderBy("k").collect()] == [X.fold_one(t) for t in texts]
    big = spark.createDataFrame([(k, f"É{k} " * (k % 7)) for k in range(3000)], "k int, t string").coalesce(1)
    assert all(r["f"] == X.fold_one(r["t"]) for r in big.select("t", X.folded(F.col("t")).alias("f")).collect())


def test_answers_that_repeat_an_id_keep_their_own_values(spark):
    """A row is judged by its own value, and each row of an id that needs a label lacks it; figures are read once."""
    answers = "answer int, run string, text string, figures array<struct<text: string, value: double, tool: string, fingerprint: string>>, labels array<string>"
    rows = [(1, "r", "It is 2,5.", [("2,5", 2.5, "t", "f")], ["B"]), (1, "r", "It is 3.", [("3", 3.0, "t", "f")], ["B"]), (1, "r", "None.", None, ["B"]), (2, "r", "None.", [], ["B"])]
    leaves = spark.createDataFrame([("r", "t", "f", 0, "a", 2.5)], "run string, tool string, fingerprint string, place long, path string, value double")
    outputs = spark.createDataFrame([("r", "t", "f", {"a": "A"})], "run string, tool string, fingerprint string, labels map<string, string>")
    out = E.verify_answers(spark.createDataFrame(rows, answers), leaves, outputs, E.Wording(("A", "B"), "B", "A"), {})
    assert sorted(tuple(r) for r in out.fillna("").collect()) == [(1, "exploratory label missing", "")] * 3 + [(1, "value not in output", "3")]
