"""Benchmark decontamination by BM25 with block-max WAND.

The benchmark's items are cut into entries of at most ``ENTRY`` words and put in an inverted index of pairs of
neighbouring words (single words are so common that their bounds would prune little), whose impacts are divided by the entry's own full score; so one threshold, ``RETRIEVE``, stands for that share of any entry. Every passage
of every document (``PASSAGE`` words, half overlapping) is a query. A passage whose terms' greatest impacts sum to less
than the threshold has no pivot and is done; the others go through block-max WAND, which returns all entries above the
threshold. A retrieved item leaks if the words around the passage hold ``VERIFY`` of the 3-grams of its question and of
its answer (the last quarter of its words). One changed word costs three 3-grams, so where a part falls short it counts by
the share of its words that are in order at the place of the item's 3-grams, if ``WHOLE`` of all the item's words are.
An item of one word has no pairs: it leaks where its word occurs.

Items are read in blocks of ``ITEMS``, one index a block, so what is broadcast is bounded by the block. Words are runs of
letters and digits, without regard to case. Null and empty texts, items without words and an empty benchmark give no
hits; null and repeated ids are kept row by row, repeated rows give repeated rows; no rows give no rows; a text is read
whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustspark.llm.common import fresh, row_key
from robustspark.llm.textops import ALNUM, chunks, mix, utf8, word_hashes

PASSAGE, ENTRY, BLOCK, ITEMS = 64, 48, 16, 20_000
RETRIEVE, VERIFY = 0.5, 0.6
WHOLE, DRIFT = 0.7, 8
K1, B = 1.2, 0.75


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the 3-grams of a sequence of word hashes; of the whole sequence if it is shorter."""
    if len(h) < 3:
        return np.array([np.add.reduce(mix(h + np.arange(len(h), dtype=np.uint64)))], np.uint64) if len(h) else h
    return mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])


def pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words: the terms of the index."""
    return mix(mix(h[:-1]) + h[1:])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by bits of a whole number."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for x in b.tolist():
        both = state & places.get(x, 0)
        state = (state + both | state - both) & full
    return len(a) - state.bit_count()


def aligned(words: np.ndarray, own: np.ndarray, answer: int) -> tuple[float, float]:
    """The shares of the question's and of the answer's words found in order where the item's 3-grams are, 0 if ``WHOLE`` is missed."""
    best = (0.0, 0.0)
    if len(words) < 3 or len(own) < 3:
        return best
    at, of = np.nonzero(grams(words)[:, None] == grams(own)[None, :])
    split, drift = len(own) - answer, 2 + len(own) // DRIFT
    starts, votes = np.unique(at - of, return_counts=True)
    for start in starts[np.argsort(-votes, kind="stable")].tolist():  # the places that most 3-grams speak for come first
        if min(best) >= VERIFY:
            break
        cut = [words[max(0, start + a - drift) : max(0, start + b + drift)] for a, b in ((0, len(own)), (0, split), (split, len(own)))]
        if common(own, cut[0]) >= WHOLE * len(own):
            best = max(best, (common(own[:split], cut[1]) / split, common(own[split:], cut[2]) / answer), key=min)
    return best


class Index:
    """Inverted index of benchmark items with normalised impacts and block maxima."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        data, off = utf8(pa.array([t for _, t in items], pa.string()))
        h, at = word_hashes(data, off, ALNUM)
        self.items = [(i, h[a:b]) for (i, _), a, b in zip(items, at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.parts = []
        for _, own in self.items:
            answer = max(1, len(own) // 4)
            self.parts.append((np.unique(grams(own[:-answer])), np.unique(grams(own[-answer:]))))
        entries = []
        for k, (_, own) in enumerate(self.items):
            pieces = max(1, -(-len(own) // ENTRY))
            entries += [(k, pairs(x)) for x in np.array_split(own, pieces) if len(x) > 1]
        self.item_of = [k for k, _ in entries]
        self.single: dict[int, list[int]] = {}
        for k, (_, own) in enumerate(self.items):
            if len(own) == 1:
                self.single.setdefault(int(own[0]), []).append(k)
        self.single_words = np.array(sorted(self.single), np.uint64)
        self.longest = max((len(own) for _, own in self.items), default=0)
        mean = max(1.0, sum(len(x) for _, x in entries) / max(1, len(entries)))
        counted = [np.unique(x, return_counts=True) for _, x in entries]
        self.terms, spread = np.unique(np.concatenate([t for t, _ in counted]) if counted else np.zeros(0, np.uint64), return_counts=True)
        idf = np.log(1 + (len(entries) - spread + 0.5) / (spread + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for e, ((_, x), (t, tf)) in enumerate(zip(entries, counted, strict=True)):
            place = np.searchsorted(self.terms, t)
            impact = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
            for p, w in zip(place.tolist(), (impact / impact.sum()).tolist(), strict=True):
                postings[p].append((e, w))
        self.postings = [([e for e, _ in x], [w for _, w in x]) for x in postings]
        self.block_max = [[max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)] for _, w in self.postings]
        self.most = np.array([max(w) for _, w in self.postings] or [0.0])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the terms, -1 for others."""
        if not len(self.terms):
            return np.full(len(h), -1)
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[place] == h, place, -1)

    def search(self, terms: list[int], threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """All entries whose score for the distinct ``terms`` is at least ``threshold``, by block-max WAND."""
        slack = threshold - 1e-9
        lists = [[0, *self.postings[t], self.block_max[t], float(self.most[t])] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[4]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == doc:
                pivot += 1
            shallow, ahead = 0.0, None
            for x in lists[: pivot + 1]:  # the blocks that would hold the pivot's document
                k = self._seek(x[1], x[0], doc) if x[1][-1] >= doc else len(x[1])
                if k < len(x[1]):
                    shallow += x[3][k // BLOCK]
                    end = min((k // BLOCK + 1) * BLOCK, len(x[1])) - 1
                    ahead = x[1][end] + 1 if ahead is None else min(ahead, x[1][end] + 1)
            if shallow >= slack and lists[0][1][lists[0][0]] == doc:
                score = sum(x[2][x[0]] for x in lists[: pivot + 1])
                if score >= slack:
                    out.append((doc, score))
                goal = doc + 1
            elif shallow >= slack:
                goal = doc
            else:
                goal = max(doc + 1 if ahead is None else ahead, doc + 1)
                if pivot + 1 < len(lists):
                    goal = min(goal, lists[pivot + 1][1][lists[pivot + 1][0]])
                goal = max(goal, doc + 1)
            for x in lists[: pivot + 1]:
                if x[1][x[0]] < goal:
                    x[0] = self._seek(x[1], x[0], goal)
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    @staticmethod
    def _seek(entries: list[int], at: int, goal: int) -> int:
        n = len(entries)
        while at < n and entries[at] < goal:
            at += 1
        return at

    def hits(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, list[tuple[int, float, float, float]]]]:
        """Per document of a chunk: passages, entries retrieved, and the leaks (item id, score, question, answer overlap)."""
        half = PASSAGE // 2
        size = np.diff(at)
        blocks = -(-size // half)
        first = np.concatenate([[0], np.cumsum(blocks)])
        place = np.append(self.lookup(pairs(h)), -1)[: len(h)]
        place[at[1:][size > 0] - 1] = -1
        weight = np.where(place >= 0, self.most[place], 0.0)
        doc_of = np.repeat(np.arange(len(size)), blocks)
        begin = at[doc_of] + half * (np.arange(first[-1]) - first[doc_of])
        sums = np.add.reduceat(weight, begin) if len(begin) else np.zeros(0)
        last = np.concatenate([doc_of[1:] != doc_of[:-1], [True]]) if len(begin) else np.zeros(0, bool)
        bound = sums + np.where(last, 0.0, np.append(sums[1:], 0.0))
        out = [(max(1, b - 1) if b else 0, 0, []) for b in blocks.tolist()]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        retrieved: dict[int, int] = {}
        for k in np.flatnonzero(bound >= RETRIEVE - 1e-9).tolist():
            d, lo = int(doc_of[k]), int(begin[k])
            own = place[lo : min(lo + PASSAGE, int(at[d + 1]))]
            found = self.search(np.unique(own[own >= 0]).tolist())
            retrieved[d] = retrieved.get(d, 0) + len(found)
            if found:
                near = np.unique(grams(h[max(int(at[d]), lo - self.longest) : min(int(at[d + 1]), lo + PASSAGE + self.longest)]))
                words = None
                for entry, score in found:
                    item = self.item_of[entry]
                    if words is None:
                        words = h[max(int(at[d]), lo - self.longest) : min(int(at[d + 1]), lo + PASSAGE + self.longest)]
                    shares = [self._share(x, near, words, y) for x, y in zip(self.parts[item], self._sequences(item), strict=True)]
                    if min(shares) < VERIFY:
                        shares = [max(x, y) for x, y in zip(shares, aligned(words, self.items[item][1], len(self._sequences(item)[1])), strict=True)]
                    if min(shares) >= VERIFY and score > best.get((d, item), (0.0,))[0]:
                        best[d, item] = (score, *shares)
        if len(self.single_words):
            place = np.minimum(np.searchsorted(self.single_words, h), len(self.single_words) - 1)
            for k in np.flatnonzero(self.single_words[place] == h).tolist():
                d = int(np.searchsorted(at, k, side="right")) - 1
                best.update({(d, item): (1.0, 1.0, 1.0) for item in self.single[int(h[k])]})
        for (d, item), x in sorted(best.items()):
            out[d][2].append((self.items[item][0], *x))
        return [(n, retrieved.get(d, 0), x) for d, (n, _, x) in enumerate(out)]

    def _sequences(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.items[item][1]
        answer = max(1, len(own) // 4)
        return own[:-answer], own[-answer:]

    @staticmethod
    def _share(part: np.ndarray, near: np.ndarray, words: np.ndarray | None, sequence: np.ndarray) -> float:
        """The share of a part's 3-grams that are near; a part of under three words is looked for as a sequence."""
        if not len(sequence):
            return 1.0
        if len(sequence) >= 3:
            return float(np.isin(part, near).mean())
        if words is None or len(words) < len(sequence):
            return 0.0
        match = words[: len(words) - len(sequence) + 1] == sequence[0]
        if len(sequence) == 2:
            match &= words[1:] == sequence[1]
        return float(match.any())


COLUMNS = "key long, id long, n_passages long, n_retrieved long, contaminated boolean, item_ids array<long>, best_score double, best_question double, best_answer double"


#: Bytes of text whose word hashes are held at once (some 60 bytes for each).
TEXT_BYTES = 500_000


def folded(text: Column) -> Column:
    """A text without case: in small letters, with ß as its capitals SS give it."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _search(docs: DataFrame, index: Index) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in chunks(whole, "text", TEXT_BYTES):
                found = shipped.value.hits(*word_hashes(*utf8(part.column("text")), ALNUM))
                top = [max(((s, q, a) for _, s, q, a in x), default=(None, None, None)) for _, _, x in found]
                columns = [
                    part.column("key"), part.column("id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([bool(x) for _, _, x in found]),
                    pa.array([sorted({i for i, *_ in x}) for _, _, x in found], pa.list_(pa.int64())), *(pa.array([t[k] for t in top], pa.float64()) for k in range(3)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.mapInArrow(find, COLUMNS)


def _indexes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Index]:
    """The index of each block of ``ITEMS`` items."""
    items = ((r[0], r[1]) for r in benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), folded(F.col(item_text_col))).toLocalIterator())
    while block := list(islice(items, ITEMS)):
        yield Index(block)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id, passages queried, entries retrieved, whether an item leaks, the leaking item ids and the best match."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), folded(F.col(text_col)).alias("text")).withColumn("key", row_key())
    parts = [_search(rows, index) for index in _indexes(benchmark, item_col, item_text_col)]
    if not parts:
        parts.append(_search(rows, Index([])))
    out = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            out = out.unionByName(more)
        # equal rows have one key and equal results: each block's is counted once, and as many rows come out
        times = (F.count("*") / len(parts)).cast("int")
        best = F.max(F.struct("best_score", "best_question", "best_answer"))
        out = out.groupBy("key").agg(F.max("id").alias("id"), times.alias("times"), F.max("n_passages").alias("n_passages"), (F.sum("n_retrieved") / times).cast("long").alias("n_retrieved"), F.max("contaminated").alias("contaminated"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best.alias("best")).withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("id", "n_passages", "n_retrieved", "contaminated", "item_ids", "best.*")
    return out.drop("key").withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item leaks, all columns kept; null and empty texts stay, and so do repeated rows.

    A leak is a matter of the text alone, so rows go where they are read and nothing is shuffled.
    """
    small = fresh(docs, "folded")
    rows = docs.withColumn(small, folded(F.col(text_col)))

    def clean(shipped):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in chunks(whole, small, TEXT_BYTES):
                    found = shipped.value.hits(*word_hashes(*utf8(part.column(small)), ALNUM))
                    yield part.filter(pa.array([not x for _, _, x in found], pa.bool_()))

        return run

    for index in _indexes(benchmark, item_col, item_text_col):
        rows = rows.mapInArrow(clean(docs.sparkSession.sparkContext.broadcast(index)), rows.schema)
    return rows.drop(small)
