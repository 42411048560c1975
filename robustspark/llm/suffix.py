"""Removal of repeated 100-byte strings by suffix sorting.

1. Winnowing: every window of ``WINDOW`` bytes has a minimiser, its leftmost k-gram of least hash. Equal windows have
   equal minimisers, so only windows whose minimiser occurs elsewhere can repeat. Counting is partially aggregated.
2. The windows of one minimiser occurrence are neighbours and form a segment of the text. Digests of segments travel to
   the task of their minimiser: segments equal as a whole are settled there. A minimiser that very many documents share
   (``HOT``) sends its windows one by one, dealt by their digest, so that no task gets them all.
3. Where a minimiser has segments that differ, their bytes follow. A task sorts the suffixes that start a window in two stages: those smaller than their successor are sorted directly,
   the others are induced by bucket scans. Adjacent suffixes with a common prefix of ``WINDOW`` bytes are one string;
   all its occurrences but the first (smaller id, then earlier start) are removed.

Null texts are empty; texts under ``WINDOW`` bytes keep all; a row that repeats another's id and text is the same
document, takes nothing from it and gets the same result; rows that share an id but not the text are documents of their
own, in the order of their digests; a null id comes last; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustspark.llm.common import cut
from robustspark.llm.textops import chunks, mix, prefix_hashes, range_hashes, utf8

WINDOW, GRAM = 100, 40
HOT = 3000
SORT_BYTES = 4_000_000


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a big-endian number; zeros follow the end."""
    out = np.zeros(len(text), np.uint64)
    for k in range(min(8, len(text))):
        out[: len(text) - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last is not."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    out = np.zeros(n, bool)
    if len(change):
        up = text[change] < text[change + 1]
        out[: change[-1] + 1] = np.repeat(up, np.diff(np.concatenate([[-1], change])))
    return out


def _sorted_directly(word: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their ``depth`` bytes; only ties are compared further."""
    order = at[np.argsort(word[at], kind="stable")]
    key = word[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
    for d in range(8, depth, 8):
        if not len(same):
            break
        tied = np.unique(np.concatenate([same, same + 1]))
        ahead = order[tied] + d
        key = np.where(ahead < len(word), word[np.minimum(ahead, len(word) - 1)], 0)
        rank = np.lexsort((key, group[tied]))
        order[tied], key, own = order[tied][rank], key[rank], group[tied]
        equal = (own[1:] == own[:-1]) & (key[1:] == key[:-1]) & (tied[1:] == tied[:-1] + 1)
        same = tied[:-1][equal]
        fresh = np.concatenate([[True], ~equal])
        group[tied] = group[tied[fresh]][np.cumsum(fresh) - 1] * 0 + tied[fresh][np.cumsum(fresh) - 1]
    return order


def two_stage_order(text: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The suffixes of ``text`` at ``starts`` in the order of at least their first ``depth`` bytes."""
    n = len(text)
    small = smaller_than_next(text)
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    edge = starts
    while len(edge):  # an induced suffix needs its successor, up to one that is sorted directly
        edge = edge[~small[edge] & (edge < n - 1)] + 1
        edge = edge[~wanted[edge]]
        wanted[edge] = True
    direct = _sorted_directly(words_at(text), np.flatnonzero(wanted & small), depth)
    by_first = np.searchsorted(text[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and wanted[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Sends the predecessors with a larger first byte to their buckets; returns those of this bucket."""
        before = found[found > 0] - 1
        before = before[wanted[before]]
        first = text[before]
        up = first > c
        if up.any():
            higher, where = first[up], before[up]
            order = np.argsort(higher, kind="stable")
            higher, where = higher[order], where[order]
            cuts = np.flatnonzero(np.concatenate([[True], higher[1:] != higher[:-1]]))
            for part, x in zip(np.split(where, cuts[1:]), higher[cuts].tolist(), strict=True):
                pending[x].append(part)
        return before[(first == c) & ~small[before]]

    for c in range(256):
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        pending[c] = []
        bucket = []
        while len(wave):
            bucket.append(wave)
            wave = induce(wave, c)
        own = direct[by_first[c] : by_first[c + 1]]
        if len(own):
            bucket.append(own)
            induce(own, c)
        out += bucket
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    keep[starts] = True
    return order[keep[order]]


def repeats(text: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of ``starts`` begin a ``WINDOW``-byte string that another of smaller ``rank`` begins too."""
    word, order = words_at(text), two_stage_order(text, starts)
    equal = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for d in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        left = left[word[order[left] + d] == word[order[left - 1] + d]]
    equal[left] = True
    heads = np.flatnonzero(~equal)
    at = np.full(len(text), -1, np.int64)
    at[starts] = rank
    ranks = at[order]
    first = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, len(order)))) if len(order) else ranks
    out = np.zeros(len(text), bool)
    out[order[ranks > first]] = True
    return out[starts]


class Anchors:
    """Minimisers of a chunk of texts: per run of windows with one minimiser its document, first and last window, and hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.prefix = prefix_hashes(data)
        n = len(data) - GRAM + 1
        empty = np.zeros(0, np.int64)
        self.doc = self.low = self.high = empty
        self.hash = np.zeros(0, np.uint64)
        if n < WINDOW - GRAM + 1:
            return
        at = np.arange(n)
        grams = range_hashes(self.prefix, at, at + GRAM)
        value, place, step = (grams >> np.uint64(32)).astype(np.uint32), at.astype(np.int32), 1
        span = WINDOW - GRAM + 1
        while 2 * step <= span:
            value, place = self._least(value, place, step)
            step *= 2
        value, place = self._least(value, place, span - step) if span > step else (value, place)
        valid = np.zeros(len(place) + 1, np.int8)
        size = np.diff(off)
        long = size >= WINDOW
        np.add.at(valid, off[:-1][long], 1)
        np.add.at(valid, off[1:][long] - WINDOW + 1, -1)
        start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        doc = np.searchsorted(off, start, side="right") - 1
        head = np.flatnonzero(np.concatenate([[True], (place[start[1:]] != place[start[:-1]]) | (doc[1:] != doc[:-1])])) if len(start) else empty
        self.doc, self.low = doc[head], start[head]
        self.high = start[np.append(head[1:], len(start)) - 1] if len(start) else empty
        self.hash = grams[place[self.low]]

    @staticmethod
    def _least(value: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[step:] < value[:-step]
        return np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            found = Anchors(*utf8(part.column("text")))
            order = np.lexsort((found.hash, found.doc))
            doc, own = found.doc[order], found.hash[order]
            head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])) if len(doc) else order
            ids = part.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(own[head].view(np.int64)), pa.array(ids[doc[head]], pa.int64()), pa.array(np.diff(np.append(head, len(doc))), pa.int32())], ["gram", "id", "times"])


def _pieces(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The byte ranges as a binary column."""
    size = high - low
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(low - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])


DIGESTS = "gram long, digest long, id long, at long, windows int"
SEGMENT = "gram long, id long, at long, windows int, bytes binary"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text", 1_000_000):
            data, off = utf8(part.column("text"))
            found = Anchors(data, off)
            grams = part.column("grams")
            hot = part.column("hot").flatten().to_numpy(zero_copy_only=False).astype(bool)
            size = np.diff(grams.offsets.to_numpy())
            known = mix(grams.flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(size), dtype=np.uint64), size) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            own = mix(found.hash + found.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            hit = np.flatnonzero(known[place] == own) if len(known) else np.zeros(0, np.int64)
            doc, low, high, gram, single = found.doc[hit], found.low[hit], found.high[hit], found.hash[hit], hot[place[hit]] if len(known) else np.zeros(0, bool)
            count = np.where(single, high - low + 1, 1)
            index = np.repeat(np.arange(len(hit)), count)
            inner = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
            doc, gram, single = doc[index], gram[index], single[index]
            start = low[index] + inner
            last = np.where(single, start, high[index])
            digest = range_hashes(found.prefix, start, last + WINDOW)
            gram = np.where(single, mix(gram ^ digest), gram)
            ids, windows = part.column("id").to_numpy(zero_copy_only=False)[doc], last - start + 1
            at = start - off[doc]
            order = np.lexsort((at, ids, digest))
            pick, owner, place = digest[order], ids[order], at[order]
            first = np.concatenate([[True], pick[1:] != pick[:-1]]) if len(order) else np.zeros(0, bool)
            again = np.concatenate([[False], (pick[1:] == pick[:-1]) & (owner[1:] == owner[:-1]) & (place[1:] == place[:-1])]) if len(order) else first
            keep = order[first | ~again]
            lead = np.isin(keep, order[first])
            key = np.where(lead, gram[keep], mix(gram[keep] + keep.astype(np.uint64)))
            columns = [pa.array(key.view(np.int64)), pa.array(digest[keep].view(np.int64), pa.int64(), mask=~lead), pa.array(ids[keep], pa.int64()), pa.array(at[keep]), pa.array(windows[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])


def _resolve_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimiser, digest, id and place. Equal segments are resolved: all but the first are removed
    (a null minimiser says so); firsts of a minimiser with several different segments stay open."""
    held: pa.Table | None = None

    def resolved(table: pa.Table) -> pa.RecordBatch:
        gram, ids, at, windows = (table.column(c).to_numpy() for c in ("gram", "id", "at", "windows"))
        column = table.column("digest").combine_chunks()
        null = column.is_null().to_numpy(zero_copy_only=False)
        digest = column.fill_null(0).to_numpy(zero_copy_only=False)
        head = np.concatenate([[True], gram[1:] != gram[:-1]])
        lead = ~null & np.concatenate([[True], head[1:] | (digest[1:] != digest[:-1]) | null[:-1]])
        owner = np.maximum.accumulate(np.where(lead | null, np.arange(len(gram)), 0))
        gone = null | (~lead & ((ids != ids[owner]) | (at != at[owner])))
        group = np.cumsum(head) - 1
        opened = lead & (np.bincount(group, lead)[group] > 1)
        keep = np.flatnonzero(gone | opened)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(at[keep], pa.int64()), pa.array(windows[keep], pa.int32()), pa.array(gram[keep], pa.int64(), mask=gone[keep])], ["id", "at", "windows", "gram"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        gram = table.column("gram").to_numpy()
        done = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
        if done:
            yield resolved(table.slice(0, done))
        held = table.slice(done)
    if held is not None and held.num_rows:
        yield resolved(held)


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open segments; what is removed already goes along as merged ranges without bytes."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    for whole in batches:
        for part in chunks(whole, "text", 1_000_000):
            data, off = utf8(part.column("text"))
            lists = part.column("found")
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            fields = lists.flatten()
            at, windows = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "windows"))
            gone = fields.field("gram").is_null().to_numpy(zero_copy_only=False)
            gram = fields.field("gram").fill_null(0).to_numpy(zero_copy_only=False)
            ids = part.column("id").to_numpy(zero_copy_only=False)
            k = np.flatnonzero(~gone)
            if len(k):
                low = off[doc[k]] + at[k]
                yield pa.RecordBatch.from_arrays([pa.array(gram[k], pa.int64()), pa.array(ids[doc[k]], pa.int64()), pa.array(at[k]), pa.array(windows[k], pa.int32()), _pieces(data, low, low + windows[k] + WINDOW - 1)], names)
            k = np.flatnonzero(gone)
            if len(k):
                k = k[np.lexsort((at[k], doc[k]))]
                low, d = off[doc[k]] + at[k], doc[k]
                reach = np.maximum.accumulate(low + windows[k] + WINDOW - 1)
                head = np.flatnonzero(np.concatenate([[True], (low[1:] > reach[:-1]) | (d[1:] != d[:-1])]))
                end = reach[np.append(head[1:], len(k)) - 1]
                d, low = d[head], low[head]
                key = mix(ids[d].astype(np.int64).view(np.uint64) + low.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[d], pa.int64()), pa.array(low - off[d]), pa.array(end - low - WINDOW + 1, pa.int32()), pa.nulls(len(d), pa.binary())], names)


def _removed(table: pa.Table) -> pa.RecordBatch:
    """Removed byte ranges of whole groups of segments; a segment without bytes is removed wholly."""
    table = table.combine_chunks()
    ids, at, windows = (table.column(c).to_numpy() for c in ("id", "at", "windows"))
    order = np.lexsort((at, ids))
    table, ids, at, windows = table.take(order), ids[order], at[order], windows[order].astype(np.int64)
    raw = table.column("bytes").to_pylist()
    first: dict[bytes, int] = {}
    owner = np.array([-1 if x is None else first.setdefault(x, k) for k, x in enumerate(raw)], np.int64)
    lead = owner == np.arange(len(raw))
    gone = ~lead & ((owner < 0) | (ids != ids[owner]) | (at != at[owner]))
    out_id, out_at, out_end = [ids[gone]], [at[gone]], [(at + windows + WINDOW - 1)[gone]]
    if lead.any():
        text = np.frombuffer(b"".join(x for x, keep in zip(raw, lead, strict=True) if keep), np.uint8)
        own, size = np.flatnonzero(lead), windows[lead]
        base = np.concatenate([[0], np.cumsum(size + WINDOW - 1)])[:-1]
        segment = np.repeat(np.arange(len(own)), size)
        inner = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size)
        gone = np.flatnonzero(repeats(text, base[segment] + inner, np.arange(len(segment))))
        if len(gone):
            s, i = segment[gone], inner[gone]
            head = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1] + 1)]))
            tail = np.append(head[1:], len(gone)) - 1
            out_id.append(ids[own[s[head]]])
            out_at.append(at[own[s[head]]] + i[head])
            out_end.append(at[own[s[head]]] + i[tail] + WINDOW)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_id, out_at, out_end)], ["id", "low", "high"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimiser; whole groups are gathered up to ``SORT_BYTES``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for lo in range(0, whole.num_rows, 4096):
            batch = whole.slice(lo, 4096)
            held.append(batch)
            size += batch.get_total_buffer_size() if batch.num_rows == whole.num_rows else batch.nbytes
            if size < SORT_BYTES:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            done = int(np.searchsorted(gram, gram[-1]))
            if done:
                yield _removed(table.slice(0, done))
                held = table.slice(done).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
    if held:
        yield _removed(pa.Table.from_batches(held))


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            rows = []
            for key, text, ranges in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, at, removed, spans = hashlib.sha256(), 0, 0, 0
                end = -1
                for r in sorted(((r["low"], r["high"]) for r in ranges or ())):
                    if r[0] > end:
                        spans += 1
                        kept.update(raw[at : r[0]])
                        removed += r[1] - r[0]
                    elif r[1] > end:
                        removed += r[1] - end
                    end = at = max(end, r[1])
                kept.update(raw[at:])
                rows.append((key, len(raw), removed, spans, kept.hexdigest()))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if c == "kept_sha256" else pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names)


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows (id, text)`` with a number of each document for its id, in the order of the ids; and (id, given) of the numbers.

    Where no id is null or repeated, ids stay and there is no second table. Else documents, told apart by id and text, are
    numbered in the order of id (null last), then of the text's digest; a checkpoint fixes the numbers, so that all uses of
    them agree.
    """
    if rows.groupBy("id").agg(F.count("*").alias("n")).filter("id is null or n > 1").isEmpty():
        return rows.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), "text"), None  # for Spark, never null: the joins can share an exchange
    rows = rows.withColumnRenamed("id", "given").withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    order = [F.col("given").asc_nulls_last(), F.col("digest")]
    documents = rows.select("given", "digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = cut(documents.select(F.col("given").alias("same"), F.col("digest").alias("own"), F.monotonically_increasing_id().alias("id")))
    numbered = rows.join(numbers, F.col("given").eqNullSafe(F.col("same")) & (F.col("digest") == F.col("own"))).select("id", "text")
    return numbered, numbers.select("id", F.col("same").alias("given"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, and the digest of the bytes that stay."""
    rows, numbers = _numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    anchors = rows.filter(f"octet_length(text) >= {WINDOW}").mapInArrow(_anchor_rows, "gram long, id long, times int")
    shared = cut(anchors.groupBy("gram").agg(F.sum("times").alias("n")).filter("n > 1").select("gram", (F.col("n") > HOT).alias("hot")))
    mine = anchors.select("gram", "id").join(shared, "gram").groupBy("id").agg(F.collect_list(F.struct("gram", "hot")).alias("s"))
    mine = mine.select("id", F.col("s.gram").alias("grams"), F.col("s.hot").alias("hot"))
    digests = rows.join(mine, "id").mapInArrow(_segment_rows, DIGESTS).repartition("gram").sortWithinPartitions("gram", "digest", "id", "at")
    found = digests.mapInArrow(_resolve_groups, "id long, at long, windows int, gram long").groupBy("id").agg(F.collect_list(F.struct("at", "windows", "gram")).alias("found"))
    segments = rows.join(found, "id").mapInArrow(_open_rows, SEGMENT)
    ranges = segments.repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort_groups, "id long, low long, high long")
    ranges = ranges.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    out = rows.join(ranges, "id", "left").mapInArrow(_kept_rows, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if numbers is not None:
        out = out.join(numbers, "id").select(F.col("given").alias("id"), *(c for c in out.columns if c != "id"))
    return out.withColumnRenamed("id", id_col)
