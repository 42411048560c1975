"""The prefix trie, toxicity and hard negatives against brute-force versions, and their edge cases."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from robustspark.llm import negatives, queries, toxicity, trie
from robustspark.llm.textops import utf8

# --- prefix trie ---


def conversation_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 215), -103, -100]:
        n = rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 33])
        shared = rng.random() < 0.5
        rows += [(c, t, "user" if t % 2 else None, f"text {t % 7 if shared else rng.randrange(3)}") for t in range(n)]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 340) for t in range(40)]  # one group of copies
    rows += [(401, None, "a", "null first"), (401, 4, "a", None), (401, 4, None, "tie"), (401, 4, None, "tie"), (None, 1, "a", "no conversation")]
    return rows


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else None, len(w), children[p], leaves[p], saved[p], digest(p)) for p, w in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(spark, rows, **options):
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn int, role string, text string, conv string, place int, node string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(trie.rebuilt(turns), **options).collect())


@pytest.mark.parametrize("options", [{}, {"size": 4, "digits": 2}, {"size": 16, "digits": 1}])
def test_op11_prefix_trie(spark, options):
    rows = conversation_rows()
    assert trie_of(spark, rows, **options) == brute_trie(rows)


def test_op11_empty_and_alone(spark):
    assert trie_of(spark, []) == []
    for one in ([(7, 0, None, None)], [(7, None, "a", "b"), (7, 0, "a", "b")], [(None, 0, "a", "b")]):
        assert trie_of(spark, one) == brute_trie(one)


def test_op11_names_agree_wherever_a_sequence_ends():
    names = [hashlib.md5(str(i).encode()).digest() for i in range(64)]
    whole = []
    trie._prefixes(names, 0, 64, trie.ROOT, whole)
    assert len(set(whole)) == 64
    for n in range(64):
        out = []
        trie._prefixes(names[:n], 0, 64, trie.ROOT, out)
        assert out == whole[:n]


def test_op11_member_lists_of_many_pieces(spark):
    ids = [*range(-700, 2500, 3), 2**40, 2**40 + 1]
    rows = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 5)], "node binary, conv long").repartition(7)
    got = {bytes(r["node"]): r["ends"] for r in trie.member_lists(rows).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}


# --- toxicity ---

LABELS = "doc_id long, toxic int, quality int"


def toxic_corpus(seed=8, size=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "er", "ou", "st", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    bad = ["vilcrab", "grumsnout", "dreckfoot"]
    rows, labels, planted = [], [], {}
    for i in range(size):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 12))).capitalize() + "." for _ in range(rng.randrange(1, 12))]
        if i % 4 == 0:
            at = rng.randrange(len(sentences))
            w = sentences[at].split(" ")
            w[rng.randrange(len(w)) : 0] = [rng.choice(bad) + rng.choice(["", "s", "ing"])]
            sentences[at] = " ".join(w)
            planted[i] = sum(len(s) + 1 for s in sentences[:at])
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(i % 4 == 0), 1))
    return rows, labels, planted


def test_op12_toxicity_and_its_sentences(spark):
    rows, labels, planted = toxic_corpus()
    extra = [(None, "a vilcrab."), (5000, None), (5001, ""), (5002, " \n ... !"), (5003, "So. " * 30_000 + "A dreckfoot is here. " + "So. " * 10), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows + extra], "doc_id long, text string, id string, score double").repartition(5)
    found = toxicity.toxicity_scores(docs, spark.createDataFrame([*labels, (None, 1, 1), (5002, None, 1)], LABELS)).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in found}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in by_id if by_id[i]["held_out"]] and all(by_id[i]["held_out"] == (i in set(held)) for i, _ in rows)
    hits = [i for i in held if by_id[i]["predicted"]]
    assert len(set(hits) & planted.keys()) >= 0.97 * len(planted.keys() & set(held)) and len(set(hits) - planted.keys()) <= 2
    texts = dict(rows)
    for i in hits:
        worst = max(by_id[i]["offending"], key=lambda s: s["score"])
        assert any(w in texts[i][worst["start"] : worst["end"]] for w in ("vilcrab", "grumsnout", "dreckfoot")) or i not in planted
        assert i not in planted or worst["start"] == planted[i]
    assert [by_id[i]["score"] for i in (5000, 5001, 5002)] == [0.0] * 3 and by_id[5002]["n_sentences"] == 0
    assert by_id[None]["held_out"] is False and by_id[None]["predicted"] == 1
    span = max(by_id[5003]["offending"], key=lambda s: s["score"])
    assert extra[4][1][span["start"] : span["end"]] == "A dreckfoot is here"
    digest = {r["doc_id"]: r for r in toxicity.toxicity_digest(spark.createDataFrame(found, toxicity.toxicity_scores(docs, spark.createDataFrame(labels, LABELS)).schema)).collect()}
    assert (digest[5003]["worst_start"], digest[5003]["worst_end"]) == (span["start"], span["end"]) and digest[5001]["worst_start"] is None


def test_op12_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b. c"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], LABELS)
    assert all(r["predicted"] == 0 and 0 <= r["score"] < 0.1 for r in toxicity.toxicity_scores(docs, none).collect())
    assert all(r["predicted"] == 0 for r in toxicity.toxicity_scores(docs, spark.createDataFrame([(2, 1, 1), (4, 1, 1)], LABELS)).collect())
    assert toxicity.toxicity_scores(docs.limit(0), none).collect() == []


def test_op12_gradient_and_noisy_or():
    rng = np.random.default_rng(3)
    doc, y = np.array([0, 0, 1, 2, 2, 2]), np.array([1, 0, 1])
    logit = rng.normal(-1, 1, 6)
    p = 1 / (1 + np.exp(-logit))
    clean = toxicity.noisy_or(logit, doc, 3)
    assert np.allclose(np.exp(clean), [np.prod(1 - p[doc == k]) for k in range(3)])
    loss, gradient = toxicity.loss_gradient(y, clean, logit, doc)
    toxic = 1 - np.exp(clean)
    assert np.isclose(loss, -np.sum(np.where(y == 1, np.log(toxic), np.log(1 - toxic))))
    for k in range(6):
        moved = logit + 1e-6 * (np.arange(6) == k)
        assert np.isclose((toxicity.loss_gradient(y, toxicity.noisy_or(moved, doc, 3), moved, doc)[0] - loss) / 1e-6, gradient[k], atol=1e-4)


def test_op12_sentences_of_plain_rules():
    texts = ["One two.  Three!\nfour\n\nFIVE", "", "...", "é à. Ünd so? 12 34.", "no end"]
    data, off = utf8(pa.array(texts))
    found = toxicity.sentences(data, off)
    cut = [(int(d), bytes(data[s:e]).decode()) for d, s, e in zip(found.doc, found.start, found.end)]
    assert cut == [(0, "One two"), (0, "Three"), (0, "four"), (0, "FIVE"), (3, "é à"), (3, "Ünd so"), (4, "no end")]
    again = toxicity.sentences(*utf8(pa.array(["five THREE"])))
    assert set(again.feature.tolist()) <= set(found.feature.tolist())


# --- hard negatives ---


def brute_negatives(rows):
    own = {}
    for i, y, v in rows:
        if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = tuple(int(np.floor(256.0 * x)) for x in v)
            own[i, (y + 1) % 10 if i % 7 == 0 else y, q] = None
    wide = max((len(q) for _, _, q in own), default=0)
    own = [(i, y, [*q, *[0] * (wide - len(q))]) for i, y, q in own]
    out = []
    for a, y, q in own:
        if a % 50:
            continue
        scored = sorted((-sum(m * n for m, n in zip(q, r, strict=True)), i, z) for i, z, r in own if i != a)
        for s, p, _ in [x for x in scored if x[2] == y][:5]:
            inside = [(-t, i) for t, i, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(inside[:3])]
    return sorted(out)


def mined(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, 0, 0.5, "x") for r in rows], f"vec_id long, label int, embedding array<{kind}>, window int, score double, id string").repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.hard_negatives(df, label=moved).collect())


def vectors(seed, size, wide=64, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, (12, wide))
    rows = centre[rng.integers(0, 12, size)] + rng.normal(0, 0.8, (size, wide))
    rows = scale * rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return [(i, int(rng.integers(0, 10)), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_op13_hard_negatives(spark):
    rows = vectors(1, 1200)
    rows += [(2000 + k, k % 10, rows[50][2]) for k in range(150)]  # a group of copies, ties by id
    rows += [(None, 1, rows[0][2]), (4000, None, rows[0][2]), (4050, 1, None), (4100, 1, [None] * 64), (4150, 1, [float("nan")] * 64), (4200, 1, [float("inf")] + [0.0] * 63)]
    rows += [rows[100], rows[100], (150, 3, rows[7][2]), (4250, 2, rows[3][2][:20]), (4300, 2, []), (4350, 2, [0.0] * 64), (4400, 2, [-x for x in rows[0][2]])]
    assert mined(spark, rows) == brute_negatives(rows)


def test_op13_exact_beyond_single_and_double_precision(spark):
    for scale, kind in ((40.0, "float"), (5e6, "double")):
        rows = vectors(2, 260, wide=20, scale=scale)
        assert mined(spark, rows, kind) == brute_negatives(rows)


def test_op13_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0, 0.5])]) == []
    rows = [(0, 1, [1.0, 0.5]), (1, 2, [1.0, 0.2]), (3, 2, [0.9, 0.2]), (2, 2, [0.5, 0.5]), (50, 2, [0.0, 0.0])]
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_op13_index_loses_no_pair():
    rng = np.random.default_rng(9)
    for wide in (5, 16, 40, 64):
        anchors, rows = rng.integers(-90, 200, (50, wide)).astype(float), rng.integers(-120, 120, (80, wide)).astype(float)
        scores = rows @ anchors.T
        threshold = np.sort(scores, axis=0)[-rng.integers(1, 20, 50), np.arange(50)]
        index = negatives.Index(np.arange(50), np.zeros(50), anchors, threshold, float(np.sqrt(np.square(rows).sum(1)).max()))
        turned = rows[:, index.order]
        rest = np.concatenate([np.sqrt(np.cumsum(np.square(turned)[:, ::-1], axis=1)[:, ::-1]), np.zeros((80, 1))], axis=1)
        r, a, s = index.pairs(turned, rest, np.ones((80, 50), bool), threshold[index.place], index.matrix)
        assert sorted(zip(r.tolist(), index.place[a].tolist(), s.tolist())) == sorted((i, j, scores[i, j]) for i, j in zip(*np.nonzero(scores >= threshold)))


# --- SQL twins ---


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("conversations", "embeddings", "documents"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, folder).collect()]
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, got)) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
