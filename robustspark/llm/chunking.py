"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where it has ``CUT`` zero bits, but holds ``LEAST`` to ``MOST`` bytes.
The cut depends on the last 16 bytes only, so chunks fall in step again soon after an insertion. Digests that occur
more than once are counted with partial aggregation; a chunk is removed if an equal one starts earlier (smaller id, then
earlier start) and the removed chunks around it run to ``least_run`` bytes or are the whole text. Its default ``RUN`` (two
least chunks) leaves short common phrases; 0 removes every repeated chunk. A shared passage loses its head and tail before
chunks fall in step, so a greater ``least_run`` would lose passages of some 50 words.

Null texts are empty and have no chunks; repeated rows of one id and text are the same document; extra columns are ignored.
A null id comes after all others and is not listed as an origin; rows of one id with other texts are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustspark.llm.common import cut, row_key
from robustspark.llm.textops import BYTE, chunks, utf8

LEAST, MOST, RUN = 32, 512, 64
#: Bits 11 to 15 of the hash, which depend on the last 16 bytes.
CUT = np.uint32(0xF800)
GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: h = 2 h + gear of the byte, here by doubling the span."""
    h, span = GEAR[data], 1
    while span < 16:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, 2 * span
    return h


def chunk_ends(cuts: list[int], size: int) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes, given the possible ends in order."""
    out, at, k, n = [], 0, 0, len(cuts)
    while size - at > MOST or (k < n):
        while k < n and cuts[k] < at + LEAST:
            k += 1
        end = cuts[k] if k < n else size
        if end > at + MOST:
            end = at + MOST
        if end >= size:
            break
        out.append(end)
        at = end
    if size > at:
        out.append(size)
    return out


def text_chunks(raw: bytes) -> list[bytes]:
    """The chunks of one text."""
    cuts = (np.flatnonzero((gear(np.frombuffer(raw, np.uint8)) & CUT) == 0) + 1).tolist()
    ends = chunk_ends(cuts, len(raw))
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            data, off = utf8(part.column("text"))
            cuts = np.flatnonzero((gear(data) & CUT) == 0) + 1
            at = np.searchsorted(cuts, off, side="right")
            raw, digests, docs, starts, sizes = data.tobytes(), [], [], [], []
            for d, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                begin = 0
                for end in chunk_ends((cuts[at[d] : at[d + 1]] - lo).tolist(), hi - lo):
                    digests.append(hashlib.blake2b(raw[lo + begin : lo + end], digest_size=16).digest())
                    docs.append(d)
                    starts.append(begin)
                    sizes.append(end - begin)
                    begin = end
            ids, keys = (part.column(c).take(pa.array(docs, pa.int64())) for c in ("id", "key"))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), ids, keys, pa.array(starts, pa.int64()), pa.array(sizes, pa.int32())], ["digest", "id", "key", "at", "size"])


def _runs(places: set[tuple[int, int]], size: int, least_run: int) -> list[list[tuple[int, int]]]:
    """The chunks of each run of neighbours that holds ``least_run`` bytes, or the whole text of ``size`` bytes."""
    runs: list[list[tuple[int, int]]] = []
    for low, high in sorted(places):
        if runs and runs[-1][-1][1] == low:
            runs[-1].append((low, high))
        else:
            runs.append([(low, high)])
    return [x for x in runs if x[-1][1] - x[0][0] >= min(least_run, size)]


def _report(batches: Iterator[pa.RecordBatch], least_run: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in chunks(whole, "text"):
            rows = []
            for key, text, found in zip(*(part.column(c).to_pylist() for c in ("id", "text", "found")), strict=True):
                raw = (text or "").encode()
                later = {(x["at"], x["at"] + x["size"]): x["origin"] for x in found or () if not x["lead"]}
                gone = _runs(set(later), len(raw), least_run)
                shared = _runs({(x["at"], x["at"] + x["size"]) for x in found or ()}, len(raw), least_run)
                origins = {later[x] for run in gone for x in run} - {None}
                runs = [(run[0][0], run[-1][1]) for run in gone]
                kept, at = hashlib.sha256(), 0
                for low, high in runs:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                rows.append((key, len(raw), sum(map(len, shared)), sum(b - a for a, b in runs), len(runs), ",".join(f"{a}:{b}" for a, b in runs), sorted(origins), kept.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], REPORT)


REPORT = ["id", "n_bytes", "n_shared_chunks", "n_removed", "n_spans", "removed_spans", "origin_ids", "kept_sha256"]


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = RUN) -> DataFrame:
    """One row per document: id, n_bytes, chunks in shared runs (first or later), removed bytes and spans (byte offsets),
    the ids of the first documents with the removed chunks, and the digest of what stays."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", row_key())
    found = rows.filter("octet_length(text) > 0").mapInArrow(_chunk_rows, "digest binary, id long, key long, at long, size int")
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "key", "at")).alias("first"))
    first = cut(first.filter("n > 1").select("digest", F.col("first.id").alias("origin"), F.col("first.key").alias("origin_key"), F.col("first.at").alias("origin_at")))
    shared = found.drop("id").join(first, "digest").select("key", "at", "size", "origin", ((F.col("key") == F.col("origin_key")) & (F.col("at") == F.col("origin_at"))).alias("lead"))
    per_doc = shared.groupBy("key").agg(F.collect_set(F.struct("at", "size", "origin", "lead")).alias("found"))
    schema = "id long, n_bytes long, n_shared_chunks long, n_removed long, n_spans long, removed_spans string, origin_ids array<long>, kept_sha256 string"
    return rows.join(per_doc, "key", "left").mapInArrow(lambda batches: _report(batches, least_run), schema).withColumnRenamed("id", id_col)
