"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, a noisy-or joins the two.

A sentence's probability is a logistic function of its words and word beginnings; a document is toxic unless all of its
sentences are clean: 1 - prod(1 - p). The weights are fitted by gradient descent on that product from document labels
alone, so the sentences that bring a document its label get the high scores, and are returned as spans.

Features are chosen by document counts over the labelled sample: the ``CANDIDATES`` that most toxic documents hold, then
the ``FEATURES`` of them whose counts in the two classes differ most (likelihood ratio). The sample is at most ``SAMPLE``
labelled documents, those of least hash among the ones not held out. Everything that is collected or broadcast is bounded
by these parameters.

Sentences end at ``.``, ``!``, ``?`` and line ends, and hold a word at least. Null and empty texts, and texts without
letters, have no sentence and score 0, whatever was learnt; with no labels of both kinds every sentence has the same small
score. Null and repeated ids are kept row by row, a null id is not held out and teaches nothing; repeated rows give
repeated rows; no rows give no rows; a text is read whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustspark.llm.textops import LOWER, Lookup, chunks, mix, prefix_hashes, range_hashes, release, utf8, words

SAMPLE, CANDIDATES, FEATURES, EPOCHS, FOLDS = 20_000, 32_768, 512, 300, 3
TOXIC_SCORE = 0.7
#: Sentences of at least this score are returned as spans.
OFFENDING = 0.5
#: Bytes of text whose features are held at once (some 40 bytes for each).
TEXT_BYTES = 500_000
#: Lengths in bytes of the word beginnings that are features beside the words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Toxic documents that must hold a feature.
LEAST_DOCS = 3
DECAY = 3e-5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True
_SALT = mix(np.arange(1, len(BEGINNINGS) + 2, dtype=np.uint64))


@dataclass
class Sentences:
    """The sentences of a chunk of texts, and the (sentence, feature hash) pairs of their words."""

    start: np.ndarray  # bytes within the chunk
    end: np.ndarray
    doc: np.ndarray
    of: np.ndarray
    feature: np.ndarray


def sentences(data: np.ndarray, off: np.ndarray) -> Sentences:
    """Cuts texts into sentences and lists the features of each; a word counts as often as it occurs."""
    s, e, at = words(data, off, _LETTER)
    if not len(s):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, np.zeros(0, np.uint64))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    ended = np.cumsum(_END[data])[s]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (ended[1:] != ended[:-1])])
    of = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(s)) - 1
    prefix = prefix_hashes(LOWER[data])
    kinds, sides = [mix(range_hashes(prefix, s, e) + _SALT[0])], [of]
    for k, size in enumerate(BEGINNINGS):
        long = e - s > size
        kinds.append(mix(range_hashes(prefix, s[long], s[long] + size) + _SALT[k + 1]))
        sides.append(of[long])
    return Sentences(s[begin], e[last], doc[begin], np.concatenate(sides), np.concatenate(kinds))


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of document and feature, once each."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of features, by chunk."""
    release()
    for whole in batches:
        for part in chunks(whole, "text", TEXT_BYTES):
            found = sentences(*utf8(part.column("text")))
            _, feature = _distinct(found.doc[found.of], found.feature)
            keys, n = np.unique(feature, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["feature", "n"])


def _counted(keys: np.ndarray):  # noqa: ANN202
    """Document counts of known features by label, one batch a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        lookup, total = Lookup(keys, np.arange(len(keys)), -1), np.zeros((2, len(keys)), np.int64)
        for whole in batches:
            for part in chunks(whole, "text", TEXT_BYTES):
                found = sentences(*utf8(part.column("text")))
                feature = lookup.get(found.feature)
                known = feature >= 0
                doc, feature = _distinct(found.doc[found.of[known]], feature[known])
                y = part.column("y").to_numpy()[doc]
                for k in (0, 1):
                    total[k] += np.bincount(feature[y == k], minlength=len(keys))
        label, feature = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(feature), pa.array(total[label, feature])], ["y", "feature", "n"])

    return run


def _bags(keys: np.ndarray):  # noqa: ANN202
    """Per document its label, its number of sentences, and the known features of those that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        lookup = Lookup(keys, np.arange(len(keys)), -1)
        for whole in batches:
            for part in chunks(whole, "text", TEXT_BYTES):
                found = sentences(*utf8(part.column("text")))
                feature = lookup.get(found.feature)
                known = np.flatnonzero(feature >= 0)
                order = known[np.argsort(found.of[known], kind="stable")]
                sentence, feature = found.of[order], feature[order]
                edges = np.searchsorted(found.doc[sentence], np.arange(part.num_rows + 1))
                rows = zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
                lists = [(sentence[a:b], feature[a:b]) for a, b in rows]
                sizes = np.bincount(found.doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array(sizes), pa.array([x for x, _ in lists], pa.list_(pa.int64())), pa.array([x for _, x in lists], pa.list_(pa.int64()))],
                    ["id", "y", "n", "sentence", "feature"],
                )

    return run


def likelihood_ratio(hit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per feature how far its share among toxic documents (row 1) is above that among others, in log likelihood; 0 if below."""
    share, both = (hit + 0.5) / (size[:, None] + 1), (hit.sum(0) + 1) / (size.sum() + 2)
    terms = hit * np.log(share / both) + (size[:, None] - hit) * np.log((1 - share) / (1 - both))
    return np.where(share[1] > share[0], terms.sum(0), 0.0)


@dataclass
class Model:
    """Hashes of the features, their weights, and the logit of a sentence without any."""

    keys: np.ndarray
    weight: np.ndarray
    bias: float


def sentence_logits(model: Model, count: int, of: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """The logits of ``count`` sentences from their (sentence, feature number) pairs."""
    return model.bias + np.bincount(of, model.weight[feature], count)


def noisy_or(logit: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Log probability that each of ``count`` documents is clean: the sum over its sentences."""
    return -np.bincount(doc, np.logaddexp(0, logit), count)


def loss_gradient(y: np.ndarray, clean: np.ndarray, logit: np.ndarray, doc: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss of the documents and its gradient by each sentence's logit; ``clean`` as from ``noisy_or``."""
    clean = np.minimum(clean, -1e-9)
    toxic = np.log(-np.expm1(clean))
    pull = np.where(y == 1, -np.exp(clean - toxic), 1.0)
    return float(-np.where(y == 1, toxic, clean).sum()), pull[doc] / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(keys: np.ndarray, y: np.ndarray, size: np.ndarray, doc: np.ndarray, of: np.ndarray, feature: np.ndarray, start: np.ndarray) -> Model:
    """A model for labels ``y`` of documents with ``size`` sentences.

    ``doc`` is the document of each sentence that has features, ``of`` and ``feature`` are those features; all other
    sentences of a document count through its ``size``. The same rows give the same model.
    """
    base = np.clip(y.mean() if len(y) else 0.0, 1e-4, 0.5)
    model = Model(keys, start.astype(float), float(np.log(base / max(1.0, size.mean() if len(size) else 1.0))) - 1)
    if len(np.unique(y)) < 2:
        model.weight[:] = 0
        return model
    plain = size - np.bincount(doc, minlength=len(y))
    slope, power = [np.zeros(len(keys) + 1) for _ in range(2)]
    for step in range(1, EPOCHS + 1):
        logit = sentence_logits(model, len(doc), of, feature)
        clean = noisy_or(logit, doc, len(y)) - plain * np.logaddexp(0, model.bias)
        _, back = loss_gradient(y, clean, logit, doc)
        _, rest = loss_gradient(y, clean, np.full(len(y), model.bias), np.arange(len(y)))
        grad = np.bincount(feature, back[of], len(keys)) / len(y) + DECAY * model.weight
        grad = np.append(grad, (back.sum() + (plain * rest).sum()) / len(y))
        slope, power = 0.9 * slope + 0.1 * grad, 0.99 * power + 0.01 * grad**2
        move = 0.05 * slope / (1 - 0.9**step) / (np.sqrt(power / (1 - 0.99**step)) + 1e-8)
        model.weight -= move[:-1]
        model.bias -= move[-1]
    return model


def fold(id_col: Column) -> Column:
    """The remainder by which documents are held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on the sample of ``docs (id, text)`` and ``labels (id, y)``."""
    known = labels.filter((fold(F.col("id")) != 1) & F.col("y").isNotNull()).groupBy("id").agg(F.max((F.col("y") >= 1).cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # at most SAMPLE rows of two numbers are broadcast
    rows = docs.join(F.broadcast(sample), "id").select("id", "y", F.coalesce("text", F.lit("")).alias("text"))
    common = rows.filter("y = 1").select("text").mapInArrow(_common, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    top = common.filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "feature").limit(CANDIDATES).toArrow()
    keys = np.sort(top.column("feature").to_numpy()).view(np.uint64)
    hit, size = np.zeros((2, len(keys))), np.zeros(2)
    for r in rows.groupBy("y").count().collect():
        size[r["y"]] = r["count"]
    for r in rows.mapInArrow(_counted(keys), "y long, feature long, n long").groupBy("y", "feature").agg(F.sum("n").alias("n")).collect():
        hit[r["y"], r["feature"]] = r["n"]
    worth = likelihood_ratio(hit, size)
    best = np.sort(np.argsort(-worth, kind="stable")[: min(FEATURES, int((worth > 0).sum()))])
    keys, start = keys[best], np.minimum(2.0, np.log((hit[1, best] + 0.5) / (hit[0, best] + 0.5) * (size[0] + 1) / (size[1] + 1)) / 2)
    bags = rows.mapInArrow(_bags(keys), "id long, y int, n long, sentence array<long>, feature array<long>").toArrow().sort_by("id")
    y, n = (bags.column(c).to_numpy() for c in ("y", "n"))
    lists = bags.column("sentence").combine_chunks()
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()) if len(y) else [])
    feature, sentence = (bags.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("feature", "sentence"))
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (sentence[1:] != sentence[:-1])
    return fit(keys, y, n, owner[new], np.cumsum(new) - 1, feature, start)


SPAN = "array<struct<start: long, end: long, score: double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scored(shipped):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shipped.value
        lookup = Lookup(model.keys, np.arange(len(model.keys)), -1)
        for whole in batches:
            for part in chunks(whole, "text", TEXT_BYTES):
                data, off = utf8(part.column("text"))
                found = sentences(data, off)
                feature = lookup.get(found.feature)
                known = feature >= 0
                logit = sentence_logits(model, len(found.doc), found.of[known], feature[known])
                score = -np.expm1(noisy_or(logit, found.doc, part.num_rows)) + 0.0
                own = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
                bad = np.flatnonzero(own >= OFFENDING)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                lead = points[off[found.doc[bad]]]
                spans = pa.StructArray.from_arrays([pa.array(points[found.start[bad]] - lead), pa.array(points[found.end[bad]] - lead), pa.array(own[bad])], ["start", "end", "score"])
                edges = np.searchsorted(found.doc[bad], np.arange(part.num_rows + 1)).astype(np.int32)
                n = np.bincount(found.doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(n), pa.ListArray.from_arrays(pa.array(edges), spans).cast(_SPAN)], ["id", "score", "n_sentences", "offending"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted, n_sentences, and ``offending``: the spans of the sentences
    that score ``OFFENDING`` or more, in code points with the end exclusive, in text order."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model = train(rows, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES pairs at most
    out = rows.mapInArrow(_scored(shipped), f"id long, score double, n_sentences long, offending {SPAN}")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"), "n_sentences", "offending")


def toxicity_digest(scored: DataFrame) -> DataFrame:
    """The spans of ``toxicity_scores`` as their number and the first worst one."""
    worst = F.aggregate("offending", F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(-1.0).alias("score")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return scored.withColumns({"n_offending": F.size("offending").cast("long"), "worst": worst}).select(*(c for c in scored.columns if c != "offending"), "n_offending", F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end"))
