"""Hard-negative mining: exact threshold joins of anchors with all rows (the L2AP scheme), rounds of falling thresholds.

A block of anchors becomes an inverted index over dimensions. For an anchor with threshold t, the dimensions are cut where
the norm of its remaining components times the largest norm of any row falls below t: the remainder cannot reach t by
itself and is left out of the index. Anchors stand in the order of their cuts, so the posting list of a dimension is a
leading part of the block, and partial scores of a batch of rows accumulate as narrowing matrix products. A pair is
dropped as soon as its partial score plus the product of the two remaining norms stays below the threshold; what is left
is completed from the components outside the index. A task keeps the best of each window and raises the anchor's
threshold to the worst of them when a window is full.

Windows that are not full after a round get a lower threshold, the last one the window's own floor, so results are exact
and whole. The anchors are a stated query set against all rows: they are taken in groups of ``GROUP``, each group's index
is broadcast (its size is bounded by GROUP and the dimension), and a scan of the rows serves the group. Only
thresholds and windows of a group come to the driver.

Rows with a null label, vector or component, or a component that is not finite, take no part, nor do rows without an id.
Rows repeated in full count once; different rows of one id are rows of their own, but no anchor meets its own id. Shorter
vectors end in zeros. Scores are exact: sums stay within the mantissa of the float type, wider ones are computed with
whole numbers of any size, and a score beyond 64 bits raises an error. No rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustspark.llm.common import cut
from robustspark.llm.textops import release

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: Anchors whose index is broadcast at once.
GROUP = 8192
#: Rows and anchors whose partial scores are held at once.
ROW_BLOCK, ANCHOR_BLOCK, DIMENSION_BLOCK = 512, 2048, 16
#: Thresholds of the rounds: of an anchor's squared norm for positives, of the positive's score for negatives; then the floor.
POSITIVE_ROUNDS, NEGATIVE_ROUNDS = (0.3, 0.15), (0.88, 0.75)
_LEAST = -(2**62)


@dataclass
class Windows:
    """Windows of a group, sorted by anchor: (anchor's place, lowest and highest score), and how many rows each takes."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    most: int
    same_label: bool


def _numbers(matrix: np.ndarray, bound: float) -> np.ndarray:
    """``matrix`` in the smallest type in which products that stay within ``bound`` are exact."""
    if bound < 2**53:
        return matrix.astype(np.float32 if bound < 2**24 else np.float64)
    return np.frompyfunc(int, 1, 1)(matrix).astype(object)


def _whole(values: pa.Array, wide: int) -> np.ndarray:
    """Vectors as rows of a matrix of whole numbers (floats, all integral), padded with zeros."""
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
    size = np.diff(ends)
    if (size == wide).all():
        return flat.reshape(len(values), wide)
    out = np.zeros((len(values), wide))
    at = np.arange(len(flat)) - np.repeat(ends[:-1], size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out


class Index:
    """The inverted index of a block of anchors for given thresholds."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, threshold: np.ndarray, most_norm: float) -> None:
        order = np.argsort(-np.square(matrix).sum(0), kind="stable")  # the dimensions with most energy first
        rest = np.sqrt(np.maximum(0, np.cumsum(np.square(matrix[:, order])[:, ::-1], axis=1)[:, ::-1]))
        rest = np.concatenate([rest, np.zeros((len(matrix), 1))], axis=1)  # norm of what follows each dimension
        cuts = np.where(threshold > 0, np.argmax(rest * most_norm * (1 + 1e-9) < threshold[:, None], axis=1), matrix.shape[1])
        by_cut = np.argsort(-cuts, kind="stable")
        self.place, self.order, self.cuts = by_cut, order, cuts[by_cut]
        self.ids, self.labels, self.rest, self.matrix = ids[by_cut], labels[by_cut], rest[by_cut], matrix[by_cut][:, order]
        self.steps = list(range(0, matrix.shape[1], DIMENSION_BLOCK))
        #: How many anchors, from the first, have a posting in a block of dimensions.
        self.listed = [int((self.cuts > d).sum()) for d in self.steps]

    def pairs(self, rows: np.ndarray, row_rest: np.ndarray, allowed: np.ndarray, threshold: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor's place in the index, score) of the allowed pairs that reach ``threshold``; ``rows`` in the index's order of dimensions."""
        wide = self.matrix.shape[1]
        partial = np.zeros((len(rows), len(self.ids)), rows.dtype)
        alive = allowed
        alive[:, int((self.cuts > 0).sum()) :] = False
        for d, n in zip(self.steps, self.listed, strict=True):
            if not n:  # no anchor of the block goes so far
                break
            to = min(d + DIMENSION_BLOCK, wide)
            partial[:, :n] += rows[:, d:to] @ kind[:n, d:to].T
            if to < wide and d % (2 * DIMENSION_BLOCK):
                alive[:, :n] &= partial[:, :n] + row_rest[:, to : to + 1] * self.rest[:n, to] * (1 + 1e-6) + 1 >= threshold[:n]
        r, a = np.nonzero(alive)
        score = partial[r, a]
        done = np.minimum(wide, (self.cuts[a] + DIMENSION_BLOCK - 1) // DIMENSION_BLOCK * DIMENSION_BLOCK)
        for at in np.unique(done[done < wide]):  # components outside the index
            own = done == at
            near = score[own] + row_rest[r[own], at] * self.rest[a[own], at] * (1 + 1e-6) + 1 >= threshold[a[own]]
            own = np.flatnonzero(own)[near]
            for lo in range(0, len(own), 65_536):
                part = own[lo : lo + 65_536]
                score[part] += (rows[r[part], at:] * kind[a[part], at:]).sum(1)
        keep = score >= threshold[a]
        return r[keep], a[keep], score[keep]


class _Best:
    """The best rows of each window, kept sorted by window, score and id."""

    def __init__(self, windows: Windows) -> None:
        self.windows = windows
        self.window, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = windows.low.copy()

    def add(self, window: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        window, score, row = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.row, row)))
        order = np.lexsort((row, -score, window))
        window, score, row = window[order], score[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
        rank = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
        keep = rank < self.windows.most
        self.window, self.score, self.row = window[keep], score[keep], row[keep]
        full = rank[keep] == self.windows.most - 1
        self.floor[self.window[full]] = np.maximum(self.windows.low[self.window[full]], self.score[full])


def _mined(shipped, wide: int, most_norm: float):  # noqa: ANN001, ANN202
    """Per task the best rows of every window of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ids, labels, matrix, windows = shipped.value
        best, count = _Best(windows), len(ids)
        opened = np.full(count, 2**62, np.int64)
        np.minimum.at(opened, windows.anchor, windows.low)
        starts, ends = np.searchsorted(windows.anchor, np.arange(count)), np.searchsorted(windows.anchor, np.arange(count), side="right")
        norms = np.sqrt(np.square(matrix).sum(1))
        bound = float(norms.max(initial=0) * most_norm)
        blocks = []
        for lo in range(0, count, ANCHOR_BLOCK):
            own = slice(lo, lo + ANCHOR_BLOCK)
            index = Index(ids[own], labels[own], matrix[own], opened[own].astype(float), most_norm)
            blocks.append((lo, index, _numbers(index.matrix, bound)))
        for whole in batches:
            for at in range(0, whole.num_rows, ROW_BLOCK):
                part = whole.slice(at, ROW_BLOCK)
                row_ids, row_labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                rows = _whole(part.column("vec"), wide)
                for lo, index, kind in blocks:
                    turned = rows[:, index.order]
                    rest = np.concatenate([np.sqrt(np.cumsum(np.square(turned)[:, ::-1], axis=1)[:, ::-1]), np.zeros((len(rows), 1))], axis=1)
                    place = index.place + lo
                    floor = np.full(count, 2**62, np.int64)
                    np.minimum.at(floor, windows.anchor, best.floor)
                    threshold = floor[place]
                    allowed = ((row_labels[:, None] == index.labels) == windows.same_label) & (row_ids[:, None] != index.ids) & (threshold < 2**62)
                    r, a, score = index.pairs(_numbers(turned, bound), rest, allowed, threshold.astype(float) if bound < 2**53 else threshold.astype(object), kind)
                    if not len(r):
                        continue
                    if bound >= 2**63 and max(map(abs, score)) >= 2**63:
                        raise OverflowError("a score is beyond 64 bits")
                    score, anchor = score.astype(np.int64), place[a]
                    each = ends[anchor] - starts[anchor]
                    pick = np.repeat(np.arange(len(r)), each)
                    window = np.repeat(starts[anchor], each) + np.arange(len(pick)) - np.repeat(np.cumsum(each) - each, each)
                    inside = (score[pick] >= best.floor[window]) & (score[pick] <= windows.high[window])
                    best.add(window[inside], score[pick[inside]], row_ids[r[pick[inside]]])
        yield pa.RecordBatch.from_arrays([pa.array(best.window), pa.array(best.score), pa.array(best.row)], ["window", "score", "id"])

    return run


def _best_of(rows: DataFrame, group: tuple, windows: Windows, wide: int, most_norm: float) -> DataFrame:
    """(window, rank, id, score) of the best rows of each window over all tasks."""
    shipped = rows.sparkSession.sparkContext.broadcast((*group, windows))
    found = rows.mapInArrow(_mined(shipped, wide, most_norm), "window long, score long, id long")
    # a task sends ``most`` rows a window at most, and there are few tasks
    merge = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, windows.most)
    lists = found.groupBy("window").agg(merge.alias("all"))
    return lists.select("window", F.posexplode("all").alias("rank", "x")).select("window", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))


def _sorted(found: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window, score and id of what a group has found, by window and rank: ``most`` rows a window."""
    got = found.select("window", "rank", "score", "id").toArrow().sort_by([("window", "ascending"), ("rank", "ascending")])
    return tuple(got.column(c).to_numpy() for c in ("window", "score", "id"))


def _in_rounds(rows: DataFrame, group: tuple, windows: Windows, starts: list[np.ndarray], wide: int, most_norm: float) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each window, by rounds of the thresholds ``starts`` and at last the windows' own floors."""
    out, left = None, np.arange(len(windows.low))
    found_so_far = [(np.zeros(0, np.int64),) * 3]
    for low in [*starts, windows.low]:
        if not len(left):
            break
        now = Windows(windows.anchor[left], np.maximum(windows.low, low)[left], windows.high[left], windows.most, windows.same_label)
        found = cut(_best_of(rows, group, now, wide, most_norm))
        window, score, row = _sorted(found)
        n = np.bincount(window, minlength=len(left))
        ready = (n == windows.most) | (now.low <= windows.low[left])
        names = found.sparkSession.createDataFrame(pa.table({"window": np.flatnonzero(ready), "own": left[ready]}))
        kept = found.join(F.broadcast(names), "window").select(F.col("own").alias("window"), "rank", "id", "score")  # a group's windows are bounded
        out = kept if out is None else out.unionByName(kept)
        keep = ready[window]
        found_so_far.append((left[window[keep]], score[keep], row[keep]))
        left = left[~ready]
    window, score, row = (np.concatenate(x) for x in zip(*found_so_far, strict=True))
    order = np.argsort(window, kind="stable")
    return out, window[order], score[order], row[order]


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vec): the rows that take part, once each, with whole components."""
    scaled = lambda x: x.cast("double") * SCALE
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y).otherwise(0.0)).cast("double")).otherwise(y)
    own = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("raw")).filter("id is not null and label is not null and raw is not null")
    finite = own.filter(F.forall("raw", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))))
    return finite.select("id", "label", F.transform("raw", lambda x: whole(scaled(x))).alias("vec")).dropDuplicates()


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", label: Column | None = None, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are the ``POSITIVES`` other rows of its
    label with the highest inner products, ties by smaller id; for each the first ``NEGATIVES`` rows of other labels whose
    score lies between half and 0.95 of the positive's. ``label`` may replace the label column.
    """
    spark = rows.sparkSession
    own = cut(prepared(rows, id_col, vector_col, F.col(label_col) if label is None else label))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    most = own.agg(F.max(F.size("vec")).alias("wide"), F.max(norm).alias("norm"), F.count_if(F.col("id") % every == 0).alias("anchors")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    groups = -(-2 * most["anchors"] // GROUP)  # half as many as GROUP each, so that none has more
    scanned = own.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism))  # a task's windows are kept over all that it reads
    for g in range(groups):
        block = own.filter((F.col("id") % every == 0) & (F.pmod(F.xxhash64("id", "label", "vec"), F.lit(groups)) == g)).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
        if block.num_rows:
            found = _group_negatives(scanned, block, most["wide"], most["norm"])
            out = out if found is None else out.unionByName(found)
    return out


def _group_negatives(rows: DataFrame, block: pa.Table, wide: int, most_norm: float) -> DataFrame | None:
    ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
    matrix = _whole(block.column("vec").combine_chunks(), wide)
    group, count = (ids, labels, matrix), len(ids)
    power = np.minimum(np.square(matrix).sum(1), 2.0**61)
    every = Windows(np.arange(count), np.full(count, _LEAST), np.full(count, -_LEAST), POSITIVES, same_label=True)
    _, anchor, score, positive = _in_rounds(rows, group, every, [(power * x).astype(np.int64) for x in POSITIVE_ROUNDS], wide, most_norm)
    low, high = -(-score // 2), score // 100 * 95 + score % 100 * 95 // 100
    some = low <= high
    anchor, score, positive = anchor[some], score[some], positive[some]
    if not len(anchor):
        return None
    near = Windows(anchor, low[some], high[some], NEGATIVES, same_label=False)
    found, *_ = _in_rounds(rows, group, near, [np.floor(score * x).astype(np.int64) for x in NEGATIVE_ROUNDS], wide, most_norm)
    names = rows.sparkSession.createDataFrame(pa.table({"window": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}))
    # at most GROUP x POSITIVES rows of four numbers are broadcast
    return found.join(F.broadcast(names), "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
