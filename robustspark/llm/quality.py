"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word gives two features, its letters and its shape (case, digits, marks, length, whether
it repeats the word before), each hashed to a bucket. A bucket
has a fixed sparse ternary index vector; its word vector is the sum of the index vectors of the neighbouring words over
the whole corpus, so the table of vectors has a fixed size however large the corpus is. Documents pool the vectors of
their words. A numpy network is fitted on at most ``SAMPLE`` labelled documents, those of least hash among the ones not
held out; a temperature fitted on a fifth of them calibrates its probabilities.

Null and empty texts, and texts of spaces, pool to zeros and are scored like any other; with no labels of both kinds the
score is the share of label 1 (0.5 without labels). Null and repeated ids are kept row by row, a null id is not held out;
repeated rows give repeated rows; no rows give no rows; a text is pooled whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustspark.llm.textops import LOWER, chunks, mix, prefix_hashes, range_hashes, release, utf8, words

LETTERS, SHAPES, WIDTH, NONZERO = 4096, 1024, 32, 4
BUCKETS = LETTERS + SHAPES
SAMPLE, HIDDEN, EPOCHS, FOLDS = 20_000, 32, 400, 5
PASS_SCORE = 0.3
#: Bytes of text whose word vectors are held at once (some 60 bytes for each).
POOL_BYTES = 400_000

_hash = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, NONZERO)
#: Places and signs of every bucket's index vector.
PLACE, SIGN = (_hash % np.uint64(WIDTH)).astype(np.int64), np.where(_hash >> np.uint64(63), 1.0, -1.0)

_UPPER, _LOWER, _DIGIT = np.zeros(256, np.int32), np.zeros(256, np.int32), np.zeros(256, np.int32)
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = _DIGIT[48:58] = 1
_MARK = 1 - _UPPER - _LOWER - _DIGIT
_LETTER = (_UPPER + _LOWER).astype(bool)


def _counted(table: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return total[e] - total[s]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word the bucket of its letters and of its shape, and the documents' offsets among the words."""
    s, e, at = words(data, off)
    if not len(s):
        return s, s, at
    upper, lower, digit, mark = (_counted(t, data, s, e) for t in (_UPPER, _LOWER, _DIGIT, _MARK))
    first, last = data[s], data[e - 1]
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, np.where((upper == 1) & (_UPPER[first] == 1), 1, 3)))
    shape = case + 4 * np.where(digit == 0, 0, np.where(digit == e - s, 2, 1)) + 12 * np.minimum(mark, 4) + 60 * (np.minimum(e - s, 15) // 3) + 360 * np.where(_MARK[last] == 1, last, 0).astype(np.int64)
    lead = np.where(_MARK[first] == 1, first, 0).astype(np.uint64)
    core = np.where(_LETTER[data], LOWER[data], 0).astype(np.uint8)
    letters = range_hashes(prefix_hashes(core), s, np.maximum(s + 1, e - np.minimum(mark, e - s)))
    again = np.concatenate([[False], letters[1:] == letters[:-1]])
    again[at[:-1][at[:-1] < len(s)]] = False
    shape += 100_000 * again
    return (letters % np.uint64(LETTERS)).astype(np.int64), LETTERS + (mix(shape.astype(np.uint64) * np.uint64(256) + lead) % np.uint64(SHAPES)).astype(np.int64), at


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    total = np.zeros(BUCKETS * WIDTH)
    for whole in batches:
        for part in chunks(whole, "text", 2 * POOL_BYTES):
            letters, shapes, at = features(*utf8(part.column("text")))
            if len(letters) < 2:
                continue
            inside = np.ones(len(letters) - 1, bool)
            ends = at[1:-1]
            inside[ends[(ends > 0) & (ends < len(letters))] - 1] = False
            for feature in (letters, shapes):
                a, b = feature[:-1][inside], feature[1:][inside]
                for word, other in ((a, b), (b, a)):
                    for k in range(NONZERO):
                        total += np.bincount(word * WIDTH + PLACE[other, k], SIGN[other, k], BUCKETS * WIDTH)
    table = total.reshape(BUCKETS, WIDTH)
    used = np.flatnonzero(table.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(table[used, k]) for k in range(WIDTH))], ["bucket", *(f"v{k}" for k in range(WIDTH))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all of ``docs (text)``: a fixed number of rows of unit length."""
    sums = docs.select("text").mapInArrow(_context_rows, "bucket long, " + ", ".join(f"v{k} double" for k in range(WIDTH)))
    table = np.zeros((BUCKETS, WIDTH))
    for row in sums.groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH))).collect():
        table[row[0]] = row[1:]
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(table: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per document the means of its letter vectors and shape vectors, their spread, and the log of its length."""
    letters, shapes, at = features(data, off)
    size = np.diff(at)
    out = np.zeros((len(size), 2 * WIDTH + 3))
    full = np.flatnonzero(size)
    if len(full):
        for k, feature in enumerate((letters, shapes)):
            means = np.add.reduceat(table[feature], at[full], axis=0) / size[full, None]
            out[full, k * WIDTH : (k + 1) * WIDTH] = means
            out[full, 2 * WIDTH + k] = np.linalg.norm(means, axis=1)
    out[:, -1] = np.log1p(size) / 5
    return out


@dataclass
class Network:
    """Two dense layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
    """A network for labels ``y``; rows where ``check`` only set the temperature. The same rows give the same network."""
    rng = np.random.default_rng(7)
    wide = x.shape[1]
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(wide), np.ones(wide))
    base = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    net = Network(mean, scale, rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(base / (1 - base))))
    if len(np.unique(y)) < 2:
        return net
    train = ~check if 0 < (~check).sum() and len(np.unique(y[~check])) == 2 else np.ones(len(y), bool)
    xs, ys = (x[train] - mean) / scale, y[train]
    names = ("w1", "b1", "w2", "b2")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    for step in range(1, EPOCHS + 1):
        hidden = np.tanh(xs @ net.w1 + net.b1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30))) - ys) / len(ys)
        back = np.outer(error, net.w2) * (1 - hidden**2)
        grads = {"w1": xs.T @ back + 1e-4 * net.w1, "b1": back.sum(0), "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum()}
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * grads[n]
            second[n] = 0.99 * second[n] + 0.01 * grads[n] ** 2
            setattr(net, n, getattr(net, n) - 0.02 * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8))
    if check.any():
        z, yc = net.logits(x[check]), y[check]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.mean(np.logaddexp(0, z / t) - yc * z / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fold(id_col: Column) -> Column:
    """The remainder by which documents are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def _pool_rows(docs: DataFrame, table, with_id: str) -> DataFrame:  # noqa: ANN001
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in chunks(whole, "text", POOL_BYTES):
                x = pooled(table.value, *utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column(with_id), pa.array(list(x), pa.list_(pa.float64()))], [with_id, "x"])

    return docs.select(with_id, "text").mapInArrow(pool, f"{with_id} long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, table) -> Network:  # noqa: ANN001
    """Fits the network on the sample; ``docs (id, text)``, ``labels (id, y)``, ``table`` a broadcast."""
    known = labels.filter((fold(F.col("id")) != 0) & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # at most SAMPLE rows of two numbers are broadcast
    rows = docs.join(F.broadcast(sample.select("id")), "id", "left_semi")
    pooled_rows, y = _pool_rows(rows, table, "id").toArrow(), {r[0]: r[1] for r in sample.collect()}
    ids, x = (pooled_rows.column(c).combine_chunks() for c in ("id", "x"))
    keys, first = np.unique(ids.to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * WIDTH + 3)[first]
    return fit(x, np.array([float(y[k] >= 1) for k in keys.tolist()]), mix(keys.view(np.uint64)) % np.uint64(5) == 0)


def _fitted(rows: DataFrame, labels: DataFrame) -> tuple:
    """The word vectors over ``rows (id, text)`` and the network, as broadcasts of fixed size."""
    context = rows.sparkSession.sparkContext
    table = context.broadcast(word_vectors(rows))
    return table, context.broadcast(train(rows, labels, table))


def _scored(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of each of ``rows (id, text)`` beside its id."""
    table, net = _fitted(rows, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for part in chunks(whole, "text", POOL_BYTES):
                got = net.value.score(pooled(table.value, *utf8(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(got)], ["id", "score"])

    return rows.mapInArrow(score, "id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = _scored(rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")))
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PASS_SCORE).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the classifier accepts, all columns kept.

    Scores depend on the text alone, so rows that repeat an id are judged each by its text, and so are rows without an id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table, net = _fitted(rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for part in chunks(whole, text_col, POOL_BYTES):
                yield part.filter(pa.array(net.value.score(pooled(table.value, *utf8(part.column(text_col)))) >= PASS_SCORE))

    return docs.mapInArrow(keep, docs.schema)
