"""Byte-level BPE encoding and decoding.

1. A task cuts its texts into pretokens and numbers the distinct ones, as long as it knows fewer than ``WORDS``. It sends
   rows of at most ``SLICE`` distinct words each, as they are met, with the places where pieces occur in them, and after
   every ``CHUNK_BYTES`` of text rows of at most ``SLICE`` documents with their ids and codes. So no row is large, however
   many words a task has, and a word is merged once for all chunks of a task.
2. Spark's higher-order functions fold the ranked merges over every distinct word. A literal map gives each occurrence its
   piece's rank and how long the piece's two parts are; sorted by rank and place, an occurrence is merged if just these two
   parts stand there. The state is a string with a 1 where a piece starts. One pass is enough, as ranks never fall from one
   merge to the next (``Ranks.merges`` checks that of a rank file).
3. The same task gathers the ids of the pieces that are left, puts them in the places of the codes, and decodes by
   concatenating the ids' binary pieces.

Nothing is shuffled. A pretoken that is a piece as a whole needs no merges. The fold costs a word's length times its
occurrences; a pretoken of over ``LONG`` bytes (no word of a language) merges by a heap in the first task, with the same
result.

Null texts are empty and have no ids; a text is never cut (one longer than a chunk is a chunk of its own); null and
repeated ids are kept row by row; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustspark.llm.textops import chunks, release, utf8

CHUNK_BYTES, SLICE, WORDS = 8_000_000, 1000, 500_000
LONG = 512
#: An occurrence's start in its word takes ``PLACE`` bits; ranks and ids take 16.
PLACE, LOW = 9, 0xFFFF


def _ranges(*codes: tuple[int, int]) -> str:
    """The inside of a character class."""
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in codes)


#: Code points of Unicode's White_Space property, and the letters and numbers below U+0250.
_SPACE = _ranges((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_LETTER = _ranges((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F))
_NUMBER = _ranges((0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE))


def _pattern(letter: str, number: str) -> str:
    """The split pattern of the rank files with its classes spelled out."""
    return rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


#: Below U+0250 and in most of the punctuation block, letters and numbers are known ranges, which the faster module can scan.
NARROW, WIDE = re.compile(_pattern(_LETTER, _NUMBER)), regex.compile(_pattern(r"\p{L}", r"\p{N}"))
BEYOND = re.compile(f"[{_ranges((0x250, 0x200F), (0x2028, 0x202F), (0x205F, 0x10FFFF))}]")


def pretokens(text: str) -> list[str]:
    """The pieces of ``text`` that are merged separately."""
    return (WIDE if BEYOND.search(text) else NARROW).findall(text)


class Ranks:
    """A rank file: pieces, ids of single bytes, and the pairs that merge."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        if max(self.ranks.values()) >= LOW:
            raise ValueError("ranks take 16 bits")
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.ends = np.cumsum([0, *map(len, pieces)])

    def pairs(self) -> dict[tuple[int, int], int]:
        """The rank of every pair of pieces that makes a piece."""
        known, out = self.ranks, {}
        for piece, rank in known.items():
            for k in range(1, len(piece)):
                if (a := known.get(piece[:k])) is not None and (b := known.get(piece[k:])) is not None:
                    out[a, b] = rank
        return out

    def parts(self, piece: bytes, rank: int) -> list[bytes]:
        """What merges of less than a rank make of a piece."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, LOW) for a, b in itertools.pairwise(parts)]
            if (least := min(ranks)) >= rank:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def merges(self) -> list[tuple[bytes, int, int]]:
        """Pieces that merges make, in the order of their bytes, with their ranks and the bytes of their left parts.

        A piece is made from the same two parts wherever it is made, as nothing beside it matters until then. If no
        part has a greater rank than the piece, ranks never fall from one merge to the next.
        """
        out = []
        for piece, rank in sorted(self.ranks.items()):
            parts = self.parts(piece, rank)
            if len(parts) == 2:
                out.append((piece, rank, len(parts[0])))
            elif len(parts) > 2 and self.parts(piece, LOW) == [piece]:
                raise ValueError("a piece has a lower rank than its parts")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces of the ids, concatenated."""
        return gathered(self.bytes, self.ends[ids], self.ends[ids + 1]).tobytes()


def gathered(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The ranges [low, high) of ``data``, one after the other."""
    size = high - low
    ends = np.cumsum(size)
    return data[np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Occurrences:
    """Finds the pieces of ``Ranks.merges`` in words, by a tree of their bytes; a piece's number is its place in that list."""

    def __init__(self, merges: list[tuple[bytes, int, int]]) -> None:
        self.rank = np.array([rank for _, rank, _ in merges], np.int32)
        self.length = np.array([len(piece) for piece, _, _ in merges], np.int64)
        nodes, number = {}, {}
        for k, (piece, _, _) in enumerate(merges):
            node = 0
            for b in piece:
                node = nodes.setdefault(node << 8 | b, len(nodes) + 1)
            number[node] = k
        self.steps = np.array(sorted(nodes) or [-1])
        self.node = np.array([nodes.get(step, 0) for step in self.steps.tolist()])
        self.number = np.array([number.get(node, -1) for node in range(len(nodes) + 1)])

    def found(self, data: np.ndarray, size: np.ndarray) -> pa.Array:
        """The occurrences in each word of ``size`` bytes: the piece's number and the place where it starts, in ``PLACE`` bits."""
        ends = np.cumsum(size)
        word = np.repeat(np.arange(len(size)), size)
        left = ends[word] - np.arange(len(data))
        at, node, length, places, numbers = np.arange(len(data)), np.zeros(len(data), np.int64), 0, [], []
        while len(at):
            step = node << 8 | data[at + length]
            k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            hit = self.steps[k] == step
            at, node, length = at[hit], self.node[k[hit]], length + 1
            ends_here = self.number[node] >= 0
            places.append(at[ends_here])
            numbers.append(self.number[node[ends_here]])
            more = left[at] > length
            at, node = at[more], node[more]
        place, number = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, numbers))
        order = np.argsort(word[place], kind="stable")
        place, number = place[order], number[order]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(word[place], minlength=len(size)))])
        values = number << PLACE | place - (ends - size)[word[place]]
        return pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(values.astype(np.int32)))


def _literal(values: list, kind: str) -> Column:
    """A literal array: Spark folds the constant once, when it plans."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def merged(words: Column, sizes: Column, merges: list[tuple[bytes, int, int]]) -> Column:
    """Where pieces start (1, also at the end; else 0) in each word of an array, by folding ranked merges over its occurrences."""
    shapes = [(left, len(piece) - left) for piece, _, left in merges]
    kinds = {shape: k for k, shape in enumerate(sorted(set(shapes)))}
    ranks = [rank << 16 | kinds[shape] for (_, rank, _), shape in zip(merges, shapes, strict=True)]
    parts = ["1".ljust(a, "0") + "1".ljust(b, "0") + "1" for a, b in kinds]
    tables = F.struct(_literal(ranks, "bigint").alias("ranks"), _literal(parts, "string").alias("parts"), _literal([a for a, _ in kinds], "int").alias("left"))

    def fold(t: Column, word: Column, size: Column) -> Column:
        def ranked(x: Column) -> Column:
            return F.shiftleft(t["ranks"][F.shiftright(x, PLACE)], PLACE) + x.bitwiseAND(F.lit((1 << PLACE) - 1))

        def step(starts: Column, x: Column) -> Column:
            place, kind = x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"), F.shiftright(x, PLACE).bitwiseAND(F.lit(LOW))
            parts = t["parts"][kind]
            return F.call_function("if", F.substring(starts, place + 1, F.length(parts)) == parts, F.overlay(starts, F.lit("0"), place + t["left"][kind] + 1, F.lit(1)), starts)

        return F.aggregate(F.sort_array(F.transform(word, ranked)), F.repeat(F.lit("1"), size + 1), step)

    return F.get(F.transform(F.array(tables), lambda t: F.transform(words, lambda word, k: fold(t, word, sizes[k]))), F.lit(0))


def merge_long(raw: bytes, byte_id: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one very long pretoken by a heap of pairs, in n log n."""
    ids = [byte_id[x] for x in raw]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (new := pairs.get((rank, ids[after[i]]))) is not None:
                heapq.heappush(heap, (new, i, rank, ids[after[i]]))
        if (p := before[i]) >= 0 and (new := pairs.get((ids[p], rank))) is not None:
            heapq.heappush(heap, (new, p, ids[p], rank))
    return [x for x in ids if x >= 0]


class Coder(dict):
    """Numbers pretokens as they are met: whole pieces by their rank, other words after them."""

    def __init__(self, ranks: Ranks, first: int) -> None:
        super().__init__()
        self.ranks, self.next = ranks, first
        #: Words that no row has taken yet, and the long ones with their numbers.
        self.words, self.long = [], {}

    def __missing__(self, token: str) -> int:
        raw = token.encode()
        code = self.ranks.ranks.get(raw)
        if code is None:
            code = self.next
            self.next += 1
            if len(raw) > LONG:
                self.long[code] = raw
                raw = b""
            self.words.append(raw)
        self[token] = code
        return code


CHUNK_ROW = "ids array<long>, codes array<binary>, bytes binary, sizes array<int>, words array<array<int>>, long array<binary>, last boolean"
_ROW = pa.schema([("ids", pa.list_(pa.int64())), ("codes", pa.list_(pa.binary())), ("bytes", pa.binary()), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.list_(pa.int32()))), ("long", pa.list_(pa.binary())), ("last", pa.bool_())])


def bpe_columns(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, digests of the ids and of the decoded bytes, and the ids as ``token_ids``.

    The rank file (of fixed size) is read once by the driver and sent to the workers.
    """
    with open(rank_path, "rb") as file:
        ranks = Ranks(file.read())
    merges = ranks.merges()
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, Occurrences(merges)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        (model, pieces), pairs = shipped.value, None
        first = len(model.ends) - 1
        ids, codes, size, coder = [], [], 0, Coder(model, first)

        def row(**columns) -> pa.RecordBatch:  # noqa: ANN003
            columns = {"ids": [], "codes": [], "bytes": b"", "sizes": [], "words": [], "long": [], "last": False} | columns
            return pa.RecordBatch.from_arrays([pa.array([columns[f.name]], f.type) for f in _ROW], schema=_ROW)

        def word_row() -> pa.RecordBatch:
            joined, sizes = b"".join(coder.words[:SLICE]), list(map(len, coder.words[:SLICE]))
            del coder.words[:SLICE]
            found = pieces.found(np.frombuffer(joined, np.uint8), np.array(sizes))
            words = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
            return row(bytes=joined, sizes=sizes).set_column(_ROW.get_field_index("words"), _ROW.field("words"), words)

        def chunk_end(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pairs
            if coder.words:
                yield word_row()
            if coder.long and pairs is None:
                pairs = model.pairs()
            long = [np.array([k, *merge_long(raw, model.byte_id, pairs)], "<i4").tobytes() for k, raw in coder.long.items()]
            coder.long.clear()
            for lo in range(0, len(ids), SLICE):
                yield row(ids=ids[lo : lo + SLICE], codes=codes[lo : lo + SLICE], long=long if lo == 0 else [], last=last and lo + SLICE >= len(ids))

        for whole in batches:
            for part in chunks(whole, "text"):
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids.append(key)
                    codes.append(np.fromiter(map(coder.__getitem__, pretokens(text or "")), "<i4").tobytes())
                    size += len(text or "")
                    while len(coder.words) >= SLICE:
                        yield word_row()
                full = len(coder) >= WORDS
                if full or size >= CHUNK_BYTES:
                    yield from chunk_end(full)
                    ids, codes, size = [], [], 0
                if full:
                    coder = Coder(model, first)
        if ids:
            yield from chunk_end(True)
        del ids, codes, coder
        release()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, pieces = shipped.value
        first = len(model.ends) - 1
        byte_id = np.array(model.byte_id, np.int32)
        flats, sizes, longs, table = [], [], [], None

        def spelled(data: np.ndarray, size: np.ndarray, starts: pa.Array, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
            """The ids of words, one after the other, and how many each has."""
            flags, off = utf8(starts)
            at = np.flatnonzero(np.delete(flags, off[1:] - 1) == ord("1"))
            length, ids = np.zeros(len(data), np.int64), byte_id[data]
            length[at] = np.diff(at, append=len(data))
            values = found.flatten().to_numpy()
            word = np.repeat(np.arange(len(size)), found.value_lengths().to_numpy())
            place, number = (np.cumsum(size) - size)[word] + (values & (1 << PLACE) - 1), values >> PLACE
            hit = length[place] == pieces.length[number]
            ids[place[hit]] = pieces.rank[number[hit]]
            return ids[at], np.bincount(np.repeat(np.arange(len(size)), size)[at], minlength=len(size))

        def built(long: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """All ids one after the other, and where those of each code start and end."""
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int64)
            low, high = np.concatenate([np.arange(first), first + ends[:-1]]), np.concatenate([np.arange(1, first + 1), first + ends[1:]])
            data = [np.arange(first, dtype=np.int32), *flats]
            at = first + int(ends[-1])
            for x in long:
                got = np.frombuffer(x, "<i4")
                low[got[0]], high[got[0]] = at, at + len(got) - 1
                at += len(got) - 1
                data.append(got[1:])
            return np.concatenate(data), low, high

        for whole in batches:
            for k in range(whole.num_rows):
                size = whole.column("sizes")[k].values.to_numpy().astype(np.int64)
                if len(size):
                    data = np.frombuffer(whole.column("bytes")[k].as_py(), np.uint8)
                    flat, own = spelled(data, size, whole.column("starts")[k].values, whole.column("words")[k].values)
                    flats.append(flat)
                    sizes.append(own)
                    table = None
                ids, codes = (whole.column(c)[k].values for c in ("ids", "codes"))
                if not len(ids):
                    continue
                if len(long := whole.column("long")[k].values):
                    longs += long.to_pylist()
                    table = None
                if table is None:
                    table = built(longs)
                data, low, high = table
                rows = []
                for raw in codes.to_pylist():
                    own = np.frombuffer(raw, "<i4")
                    out = gathered(data, low[own], high[own])
                    rows.append((len(out), hashlib.sha256(out.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(out)).hexdigest(), *((out,) if keep_ids else ())))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([ids, *columns], NAMES)
                if whole.column("last")[k].as_py():
                    flats, sizes, longs, table = [], [], [], None
        release()

    NAMES = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(("token_ids",) if keep_ids else ())]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    coded = rows.mapInArrow(code, CHUNK_ROW)
    folded = coded.select(*_ROW.names, merged(F.col("words"), F.col("sizes"), merges).alias("starts"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return folded.mapInArrow(assemble, schema).withColumnRenamed("id", id_col)
