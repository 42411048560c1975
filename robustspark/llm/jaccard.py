"""Exact Jaccard join of 5-word shingle sets by PartEnum signatures.

Two sets with J >= 0.8 differ in at most (|u| + |v|) / 9 shingles. Sizes are cut into bands, so similar sets share a band
or are in neighbouring ones; a set signs for its band and, where a partner may be in the next, for that too. In a band,
the shingle domain is partitioned by hash:

* bands of small sets use two levels, n1 partitions of n2 parts each, and enumerate all choices of n2 - k2 parts. One of
  the n1 partitions holds at most k2 of the differences, so some choice of its parts has none: the sets agree there;
* bands of larger sets use one level of n1 > k partitions. At most k of them hold a difference, so two sets agree on
  n1 - k or more projections, and so share one of the first k + 1 in any common order of projections. The order takes
  the projections with the most shingles first, which are the most selective.

A projection that holds none of a set's shingles says nothing, and its signature would be shared by unrelated sets. So it
is left out, and a set that leaves one out signs its first shingles by hash in its place: two sets that agree on an empty
projection both do, and of two similar sets one of the first n - ceil(0.8 n) + 1 shingles of each is the same.

Sets that are equal become one class first, and each task signs a class once. Classes that share a signature are tried
against the least and the greatest class of that signature (not all pairs); connected components follow. Only where other
members of a signature are then still in different components are pairs of these tried. Every pair has to pass an exact
bound first: hashing the shingles to ``PARITY`` slots, the slots whose counts differ in parity are at most the shingles
that differ. So no link between components is lost, and few pairs fetch their sets.

Null or empty texts, and texts of spaces, have no shingles and stand alone; repeated rows give repeated rows; null ids are
kept row by row and come last; no rows give no rows; a text is read whole, however long; extra columns are ignored by the
report and kept by the filter. Identities are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustspark.llm.common import cut, fresh, row_key
from robustspark.llm.graph import connected_components
from robustspark.llm.textops import chunks, mix, shingle_sets, utf8

#: J >= 0.8, as 100 * intersection >= 80 * union.
PERCENT = 80
SMALL = (4, 9, 14, 18, 27, 41)
RATIO, SLACK = 1.6, 1.15
PARITY = 1024


def band_starts(limit: int) -> list[int]:
    """First sizes of the bands; sets of fewer than 4 shingles are only similar to equal ones."""
    starts = list(SMALL)
    while starts[-1] <= limit:
        starts.append(int(starts[-1] * RATIO) + 1)
    return starts


STARTS = np.array(band_starts(2**40), np.int64)


@lru_cache(maxsize=None)
def level(band: int) -> tuple[int, int, int, np.ndarray | None]:
    """Of a band: most differences, n1, parts per partition (1: one level), and the choices of parts as a 0/1 matrix."""
    most = 2 * (int(STARTS[band + 1]) - 1) // 9
    if most > 8:
        return most, int(SLACK * (most + 1)) + 2, 1, None
    n1 = -(-(most + 1) // 3)
    k2 = most // n1
    n2 = k2 + 3
    choices = list(combinations(range(n2), n2 - k2))
    matrix = np.zeros((n1 * len(choices), n1 * n2), np.uint64)
    for p in range(n1):
        for c, parts in enumerate(choices):
            matrix[p * len(choices) + c, [p * n2 + x for x in parts]] = 1
    return most, n1, n2, matrix


def signatures(items: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of a set of hashes (sorted, distinct)."""
    size = len(items)
    if size < SMALL[0]:
        return np.zeros(0, np.uint64)
    partner = 5 * size // 4
    own = int(np.searchsorted(STARTS, size, side="right")) - 1
    out = []
    for band in (own, own + 1):
        if band > own and partner < STARTS[band]:
            break
        most, n1, n2, matrix = level(band)
        salt = np.uint64((band + 1) * 0x5851F42D4C957F2D % 2**64)
        spread = mix(items ^ salt)
        part = ((spread >> np.uint64(33)) % np.uint64(n1 * n2)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums, count = np.zeros(n1 * n2, np.uint64), np.zeros(n1 * n2, np.int64)
        sums[part[first]] = np.add.reduceat(mix(spread[order] + salt), first)
        count[part[first]] = np.diff(np.append(first, size))
        if matrix is not None:
            sums, count = matrix @ sums, matrix.astype(np.int64) @ count
        tokens = mix(mix(sums + salt) + np.arange(len(sums), dtype=np.uint64))
        if matrix is None:
            top = min(partner, int(STARTS[band + 1]) - 1)
            order = np.lexsort((tokens, -count))[: (size + top) // 9 + 1]
            tokens, count = tokens[order], count[order]
        out.append(tokens[count > 0])
        if not count.all():
            out.append(mix(np.sort(spread)[: size - -(-PERCENT * size // 100) + 1] + salt))
    return np.unique(np.concatenate(out))


def class_of(items: np.ndarray) -> int:
    """The identity of a set."""
    return int(mix(np.array([np.add.reduce(mix(items)) + np.uint64(len(items))], np.uint64)).view(np.int64)[0])


def parity(items: np.ndarray) -> np.ndarray:
    """Of every slot whether it holds an odd number of shingles, as 64-bit numbers."""
    odd = np.bincount((items >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: Bytes of text whose word hashes are held at once (some 60 bytes for each).
TEXT_BYTES = 500_000


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in chunks(batch, "text", TEXT_BYTES):
        yield part, shingle_sets(*utf8(part.column("text")))


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part, sets in _sets(whole):
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array([class_of(x) if len(x) else None for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())], ["id", "key", "cls", "n"])


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for whole in batches:
        for _, sets in _sets(whole):
            tokens, classes = [], []
            for items in sets:
                if len(items) and (own := class_of(items)) not in seen:
                    seen.add(own)
                    tokens.append(signatures(items))
                    classes.append(np.full(len(tokens[-1]), own, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(classes))], ["token", "cls"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # repeated rows share a key and so, mostly, a task
    for whole in batches:
        for part, sets in _sets(whole):
            rows = []
            for c, x in zip(part.column("cls").to_pylist(), sets, strict=True):
                if len(x) and c not in seen and class_of(x) == c:
                    seen.add(c)
                    rows.append((c, len(x), x.view(np.int64), parity(x)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["cls", "n", "items", "odd"])


def _near(n_a: str, n_b: str, odd_a: str, odd_b: str) -> Column:
    """Whether sizes and parities leave it open that two sets link."""
    apart = sum((F.bit_count(F.col(odd_a)[k].bitwiseXOR(F.col(odd_b)[k])) for k in range(1, PARITY // 64)), F.bit_count(F.col(odd_a)[0].bitwiseXOR(F.col(odd_b)[0])))
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (9 * apart <= F.col(n_a) + F.col(n_b))


def _side(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    return sets.select(F.col("cls").alias(f"cls_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in columns))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    open_ = pairs.join(_side(sets, "a", "n", "odd"), F.col("a") == F.col("cls_a")).join(_side(sets, "b", "n", "odd"), F.col("b") == F.col("cls_b"))
    open_ = open_.filter(_near("n_a", "n_b", "odd_a", "odd_b")).select("a", "b")
    both = open_.join(_side(sets, "a", "n", "items"), F.col("a") == F.col("cls_a")).join(_side(sets, "b", "n", "items"), F.col("b") == F.col("cls_b"))
    common = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("common"))
    return common.filter(100 * F.col("common") >= PERCENT * (F.col("total") - F.col("common"))).select("a", "b")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, key, n, comp (null without shingles)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", row_key())
    of = cut(rows.mapInArrow(_class_rows, "id long, key long, cls long, n long"))
    classes = of.filter("cls is not null").groupBy("cls").agg(F.min("key").alias("rep"))

    signed = rows.select("text").mapInArrow(_signature_rows, "token long, cls long")
    same = Window.partitionBy("token")
    members = signed.select("token", "cls", F.min("cls").over(same).alias("low"), F.max("cls").over(same).alias("high"))
    members = cut(members.filter("low <> high").distinct())

    wanted = members.select("cls").distinct().join(classes, "cls").select(F.col("rep").alias("key"), "cls")
    texts = rows.select("key", "text").join(wanted, "key").select("cls", "text")
    sets = cut(texts.mapInArrow(_set_rows, "cls long, n long, items array<long>, odd array<long>"))

    ends = [F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("low", "cls"), ("cls", "high"), ("low", "high"))]
    tried = cut(members.select(F.explode(F.array(*ends)).alias("p")).select("p.a", "p.b").filter("a <> b").distinct())
    links = cut(_checked(tried, sets))
    found = cut(connected_components(links))

    middle = members.filter("cls <> low and cls <> high").select("token", "cls")
    middle = middle.join(found, F.col("cls") == F.col("node"), "left").select("token", "cls", F.coalesce("component", "cls").alias("comp"))
    split = middle.withColumn("least", F.min("comp").over(same)).withColumn("most", F.max("comp").over(same)).filter("least <> most")
    split = cut(split.select("token", "cls", "comp").join(sets.select("cls", "n", "odd"), "cls"))
    one, two = (split.select(*(F.col(c).alias(f"{c}_{side}") for c in ("token", "cls", "comp", "n", "odd"))) for side in "ab")
    across = one.join(two, (F.col("token_a") == F.col("token_b")) & (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & _near("n_a", "n_b", "odd_a", "odd_b"))
    across = across.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
    more = _checked(across.join(tried, ["a", "b"], "left_anti"), sets)
    final = cut(connected_components(links.unionByName(more)))

    return of.join(final, F.col("cls") == F.col("node"), "left").select("id", "key", "n", F.coalesce("component", "cls").alias("comp"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, the smallest id that links reach (null if none has one)."""
    grouped = _components(docs, id_col, text_col).select("id", "n", "comp")
    least = grouped.filter("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id")).withColumnRenamed("comp", "c")
    out = grouped.join(least, F.col("comp") == F.col("c"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns kept: of the smallest id, null ids last. Rows without shingles stand alone and stay."""
    grouped = _components(docs, id_col, text_col)
    least = grouped.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "key")).alias("first"))
    key, kept, alone, place = (fresh(docs, x) for x in ("__key", "__kept", "__alone", "__place"))
    stay = least.select(F.col("first.key").alias(kept), F.lit(False).alias(alone)).unionByName(grouped.filter("comp is null").select(F.col("key").alias(kept), F.lit(True).alias(alone)).distinct())
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))
    placed = keyed.join(stay, F.col(key) == F.col(kept)).withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return placed.filter(F.col(alone) | (F.col(place) == 1)).select(*docs.columns)
