"""Keyed permutations, emphasis weights, Unicode folding, assembled polygons and files against plain versions."""

import hashlib
import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from robustspark.operators import spatial, text, worlds
from robustspark.sources import files


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select(*(worlds.permuted(F.col("id"), n, k).alias(f"p{k}") for k in (0, 1, 905))).toPandas()
    assert all(sorted(rows[c]) == list(range(n)) for c in rows)
    assert n < 64 or (rows["p0"] != rows["p1"]).mean() > 0.9 and abs(np.corrcoef(rows["p0"], np.arange(n))[0, 1]) < 0.3


@pytest.mark.parametrize("n", [10**8 + 7, 2**33 + 1, 10**12])
def test_permutation_of_many(spark, n):
    """Distinct and inside; applied to both ends and the middle of the range."""
    points = [*range(2000), *range(n // 2, n // 2 + 2000), *range(n - 2000, n)]
    rows = spark.createDataFrame([(p,) for p in points], "id long").select(worlds.permuted(F.col("id"), n, 3).alias("p")).toPandas()["p"]
    assert rows.min() >= 0 and rows.max() < n and rows.nunique() == len(points) and rows.max() > 0.9 * n and rows.min() < 0.1 * n


def test_each_stratum_has_one_point(spark):
    got = worlds.latin_hypercube(spark, 500, 3, 9).toPandas()
    for d in range(3):
        assert sorted(got[f"s{d}"]) == list(range(500)) and (np.floor(got[f"u{d}"] * 500) == got[f"s{d}"]).all()


def test_emphasised_weights(spark):
    rng = np.random.default_rng(4)
    u = rng.random((300, 6))
    u[:20, 3] = u[:20, 1]  # equal draws
    u[20:40] = 0.5
    flags = rng.random(300) < 0.7
    rows = spark.createDataFrame([(i, bool(f), *map(float, r)) for i, (f, r) in enumerate(zip(flags, u, strict=True))], "i int, f boolean, " + ", ".join(f"u{k} double" for k in range(6)))
    got = {r["i"]: r["w"] for r in rows.select("i", worlds.emphasised([F.col(f"u{k}") for k in range(6)], F.col("f"), 3, 1).alias("w")).collect()}
    for i in range(300):
        draws = -np.log1p(-u[i])
        w = 6 * draws / draws.sum()
        if flags[i]:
            order = np.argsort(-w, kind="stable")
            top, rest = w[order[:2]], iter(w[np.sort(order[2:])])
            first, second = (top[0], top[1]) if draws[3] >= draws[1] else (top[1], top[0])
            w = [first if d == 3 else second if d == 1 else next(rest) for d in range(6)]
        assert np.allclose(got[i], w) and np.isclose(sum(got[i]), 6)


FOLDED = {
    "Ámbito  de\tAcción\n": "ambito de accion", "ﬁn ½ Ⅷ ＡＢ": "fin 1⁄2 viii ab", "é ñ": "e n", "Straße ÅÉ": "straße ae", " x y ": "x y", "한글": unicodedata.normalize("NFKD", "한글"), "": "", None: "", "ǅ İ": "dz i",
}


def test_fold_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(FOLDED)], "i int, t string").repartition(2)
    assert [r["f"] for r in rows.select("i", text.fold_text(F.col("t")).alias("f")).orderBy("i").collect()] == list(FOLDED.values())


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"d": [3, {"z": null, "y": "é"}], "c": true}}', "[]", "no json", None, '{"a": 1.50}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["c"] for r in rows.select("i", text.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False) if t and t != "no json" else None for t in texts]


def ring(points, clockwise):
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
    points = points if (area < 0) == clockwise else points[::-1]
    return [*points, points[0]]


def square(x, y, s, clockwise):
    return ring([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], clockwise)


def test_assemble_polygons(spark):
    l_shape = ring([(0.0, 0.0), (10.0, 0.0), (10.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0)], True)
    rows = [
        (1, 1, square(0.0, 0.0, 10.0, True)), (1, 2, square(1.0, 1.0, 2.0, False)), (1, 3, square(5.0, 5.0, 2.0, False)), (1, 4, square(50.0, 50.0, 2.0, False)), (1, 5, [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]),
        (2, 1, l_shape), (2, 2, square(3.0, 3.0, 1.0, False)), (2, 3, square(0.5, 5.0, 1.0, False)), (3, 1, square(0.0, 0.0, 1.0, False)), (3, 2, square(5.0, 0.0, 1.0, False)),
        (4, 1, square(0.0, 0.0, 20.0, True)), (4, 2, square(2.0, 2.0, 10.0, True)), (4, 3, square(4.0, 4.0, 1.0, False)), (5, 1, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]), (6, 1, square(3.0, 3.0, 0.0, True)),
    ]
    df = spark.createDataFrame([(f, n, [{"x": float(x), "y": float(y)} for x, y in r]) for f, n, r in rows], "feature_id int, ring_no int, ring array<struct<x: double, y: double>>").repartition(3)
    got = {(r["feature_id"], r["shell_no"]): r["holes"] for r in spatial.assemble_polygons(df).collect()}
    assert got == {(1, 1): [2, 3], (2, 1): [3], (3, 1): [], (3, 2): [], (4, 1): [3], (4, 2): [3], (5, 1): [], (6, 1): []}
    assert spatial.assemble_polygons(df.limit(0)).collect() == []


def test_many_shells_of_one_feature(spark):
    """A grid of shells in one feature, each with a hole; every third hole lies outside."""
    rows = [(1, k, square(10.0 * (k % 20), 10.0 * (k // 20), 8.0, True)) for k in range(400)]
    rows += [(1, 1000 + k, square(10.0 * (k % 20) + (9.0 if k % 3 == 0 else 2.0), 10.0 * (k // 20) + 2.0, 0.5, False)) for k in range(400)]
    df = spark.createDataFrame([(f, n, [{"x": x, "y": y} for x, y in r]) for f, n, r in rows], "feature_id int, ring_no int, ring array<struct<x: double, y: double>>")
    assert {r["shell_no"]: r["holes"] for r in spatial.assemble_polygons(df).collect()} == {k: [] if k % 3 == 0 else [1000 + k] for k in range(400)}


def test_inventory(spark, tmp_path):
    root = tmp_path / "bundle"
    contents = {
        "a.txt": b"one\r\ntwo\r\n", "b/c.csv": "ñ\r\n".encode(), "b/raw.bin": b"\0\r\n", "b/p.PNG": b"\r\n", "bad.utf": b"\xff\r\n", "b/d/e.txt": b"last line",
        "b/key.pem": b"x", "b/credentials.json": b"x", "data/public/z.txt": b"x", ".env.local": b"x", "Thumbs.db": b"x",
    }
    for name, raw in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    got = {r["path"]: (r["bytes"], r["digest"]) for r in files.inventory(files.binary_files(spark, str(root))).collect()}
    kept = {n: r if n in ("b/raw.bin", "b/p.PNG") else r.replace(b"\r\n", b"\n") for n, r in contents.items() if list(contents).index(n) < 6}
    assert got == {n: (len(r), hashlib.sha256(r).hexdigest()) for n, r in kept.items()}


def test_written(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 0.5, "b")], "k int, v double, day string")
    for form, by in (("json", []), ("parquet", ["day"]), ("json", ["day"])):
        assert sorted(map(tuple, files.written(df, files.scratch(spark, "t"), form, by).collect())) == [(1, None, "a"), (2, 0.5, "b")]
