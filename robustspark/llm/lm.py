"""Language-model scores of documents.

``score`` is a subword lattice likelihood: the pieces of an existing vocabulary, weighted by their scores, span a lattice
over each word, and a forward recursion in log space sums over all segmentations. Pieces don't cross words, so a text's
marginal is the product over its words and the end; a worker computes each distinct word once. The vocabulary's scores
are merge ranks, so a piece of rank r weighs 1 / (r + ``OFFSET``), normalised, at first; single bytes cover the rest.
Weights are then the expected uses in all training words, however long. Each training word is an edge of its own over the
whole word: all edges' counts are discounted by the same part of one, and what that frees (all, without training words) is
the weight of the smaller pieces; as every distinct word frees the same, it teaches once, however often it occurs. The share
of ends is learned from the training documents.

``base_score`` is the smoothed unigram of words, counted over all training documents: counts are merged per task, words
that make up a 2^-22 of all tokens or more (so at most 2^22 of them) are sent to the tasks, and the rest is joined by
word. Words are identified by 64-bit hashes; a distinct word's bytes go along with its count, so that it is taught from once.

Null and empty texts are the end alone; rows that repeat an id and text are counted each and give one row; a null id stays
null, is in training and does not merge with others unless the texts are equal; no rows give no rows; a text is scored
whole, however long; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustspark.llm.common import cut, row_key
from robustspark.llm.quality import fold
from robustspark.llm.textops import CHUNK, LOWER, Lookup, chunks, mix, prefix_hashes, range_hashes, utf8, words

TRAIN_FOLD_OUT, HEAD = 1, 2**22
OFFSET, ROUNDS = 10.0, 2
END = np.uint64(0x5DEECE66D1234567)
#: The uses that the file's own weights stand for.
PRIOR = 1000.0
#: Ranges of words that are looked up at once, places of a long word that are, and distinct words that are taught from at once.
ARCS, PLACES, TAUGHT = 250_000, 65_536, 131_072
MERGE, CACHE, BATCH = 1_000_000, 1_000_000, 16_384
NONE, LN10 = -1e30, math.log(10)
MARK = np.uint64(0xD1B54A32D192ED03)


class Lattice:
    """Log probabilities of words under the pieces of a vocabulary."""

    def __init__(self, model: bytes, taught: np.ndarray | None = None) -> None:
        """``taught`` are expected uses of the pieces in training, as ``expected`` gives them."""
        vocab = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = vocab.get_piece_size()
        starts, inner = [], []
        opening = rare = 1 / (OFFSET + size)
        for k in range(size):
            if not (vocab.is_byte(k) or vocab.is_control(k) or vocab.is_unknown(k) or vocab.is_unused(k)) and vocab.get_score(k) > -1e8:
                piece, weight = vocab.id_to_piece(k), 1 / (OFFSET - vocab.get_score(k))
                if piece == "\u2581":
                    opening = max(weight, rare)
                elif "\u2581" not in piece[1:]:
                    (starts if piece[0] == "\u2581" else inner).append((piece.replace("\u2581", "").encode(), weight))
        # the pieces that begin a word, those inside, the opening mark alone, and all bytes together
        share = np.array([w for _, w in starts + inner] + [opening, 256 * rare])
        share /= share.sum()
        if taught is not None and taught.sum():
            share = (taught + PRIOR * share) / (taught.sum() + PRIOR)
        self.logs = np.append(np.log(share), NONE)
        self.logs[-2] -= math.log(256)
        self.opening, self.byte = self.logs[-3], self.logs[-2]
        self.widest = max(len(p) for p, _ in starts + inner)
        keys = [self._keys(x) for x in (starts, inner)]
        at = np.arange(len(self.logs)), np.arange(len(starts), len(self.logs))
        self.starts, self.inner = (Lookup(k, self.logs[x[: len(k)]], NONE) for k, x in zip(keys, at, strict=True))
        # the places in ``logs``, of which the last is of what is no piece
        self.start_at, self.inner_at = (Lookup(k, x[: len(k)], -1) for k, x in zip(keys, at, strict=True))
        self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)

    @staticmethod
    def _keys(pieces: list[tuple[bytes, float]]) -> np.ndarray:
        joined = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
        ends = np.cumsum([len(p) for p, _ in pieces])
        return range_hashes(prefix_hashes(joined), np.concatenate([[0], ends[:-1]]), ends)

    def expected(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How often each piece is used in the words [s, e), over all segmentations by their probability."""
        out = np.zeros(len(self.logs))
        size = e - s
        # longer ones might leave the range of floating numbers, and are taken one by one in log space
        most = int(1000 / abs(self.byte))
        for n in np.unique(size[(size > 0) & (size <= most)]).tolist():
            every = s[size == n]
            step = max(1, ARCS // (n * min(n, self.widest)))
            for k in range(0, len(every), step):
                out += self._expected(prefix, every[k : k + step], n)
        for k in np.flatnonzero(size > most):
            out += self._expected_long(prefix, int(s[k]), int(size[k]))
        return out[:-1]

    def _expected(self, prefix: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The uses in words of ``n`` bytes that begin at ``at``; probabilities are scaled by a factor for each byte."""
        scale = -self.byte / 2
        i, j = np.array([(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.widest), j)]).T
        ends = np.arange(1, min(n, self.widest) + 1)
        found = lambda table, i, j: table.get(range_hashes(prefix, (at + i[:, None]).ravel(), (at + j[:, None]).ravel())).reshape(len(i), -1)
        first, arcs = found(self.start_at, 0 * ends, ends), found(self.inner_at, i, j)
        weight = np.exp(self.logs[arcs] + scale * (j - i)[:, None])
        begin = np.exp(self.logs[first] + scale * ends[:, None])
        opening, byte = math.exp(self.opening), math.exp(self.byte + scale)
        ahead, behind = np.zeros((n + 1, len(at))), np.zeros((n + 1, len(at)))
        ahead[0], behind[n] = opening, 1.0
        ahead[ends] = begin
        for k in range(1, n + 1):
            ahead[k] += ahead[k - 1] * byte + (ahead[max(0, k - self.widest) : k] * weight[j == k]).sum(0)
        for k in range(n - 1, -1, -1):
            behind[k] = behind[k + 1] * byte + (behind[k + 1 : k + 1 + self.widest] * weight[i == k]).sum(0)
        whole = ahead[n]
        out = np.zeros(len(self.logs))
        for index, uses in ((first, begin * behind[ends]), (arcs, ahead[i] * weight * behind[j])):
            met = index >= 0
            out += np.bincount(index[met], (uses / whole)[met], len(out))
        out[-3] += (opening * behind[0] / whole).sum()
        out[-2] += (ahead[:-1] * byte * behind[1:] / whole).sum()
        return out

    def _expected_long(self, prefix: np.ndarray, at: int, n: int) -> np.ndarray:
        """The uses in one long word; what its places look up is not kept for the way back."""

        def arcs(lo: int) -> np.ndarray:
            """The inner pieces that begin at the places from ``lo``, by length."""
            i = np.arange(lo, min(n, lo + PLACES))
            found = np.full((len(i), self.widest), -1)
            for size in range(1, self.widest + 1):
                own = i[i + size <= n]
                found[: len(own), size - 1] = self.inner_at.get(range_hashes(prefix, at + own, at + own + size))
            return found

        ends = np.arange(1, min(n, self.widest) + 1)
        first = self.start_at.get(range_hashes(prefix, np.full(len(ends), at), at + ends))
        ahead, behind = np.full(n + 1 + self.widest, NONE), np.full(n + 1 + self.widest, NONE)
        ahead[0], behind[n] = self.opening, 0.0
        ahead[ends] = self.logs[first]
        for lo in range(0, n, PLACES):
            weight = self.logs[arcs(lo)]
            weight[:, 0] = np.logaddexp(weight[:, 0], self.byte)
            for k, own in enumerate(weight, lo):
                ahead[k + 1 : k + 1 + self.widest] = np.logaddexp(ahead[k + 1 : k + 1 + self.widest], ahead[k] + own)
        whole, out = ahead[n], np.zeros(len(self.logs))
        for lo in range((n - 1) // PLACES * PLACES, -1, -PLACES):
            index = arcs(lo)
            weight = self.logs[index]
            both = weight.copy()
            both[:, 0] = np.logaddexp(both[:, 0], self.byte)
            for k in range(len(both) - 1, -1, -1):
                ways = behind[lo + k + 1 : lo + k + 1 + self.widest] + both[k]
                top = ways.max()
                behind[lo + k] = top + math.log(np.exp(ways - top).sum())
            place, size = np.nonzero(index >= 0)
            out += np.bincount(index[place, size], np.exp(ahead[lo + place] + weight[place, size] + behind[lo + place + size + 1] - whole), len(out))
            own = slice(lo, lo + len(both))
            out[-2] += np.exp(ahead[own] + self.byte + behind[lo + 1 : lo + 1 + len(both)] - whole).sum()
        met = first >= 0
        out += np.bincount(first[met], np.exp(self.logs[first] + behind[ends] - whole)[met], len(out))
        out[-3] += math.exp(self.opening + behind[0] - whole)
        return out

    def forward(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Natural-log marginals of the words [s, e), some thousand at a time to bound the memory."""
        return np.concatenate([self._forward(prefix, s[k : k + BATCH], e[k : k + BATCH]) for k in range(0, len(s), BATCH)]) if len(s) else np.zeros(0)

    def _forward(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The forward recursion over all words at once, position by position."""
        order = np.argsort(s - e, kind="stable")  # longest first
        s, size = s[order], (e - s)[order]
        width = int(size[0]) if len(size) else 0
        band = self.widest + 1
        alpha = np.full((len(s), band), NONE)  # a ring of the last positions; position 0 is after the opening mark
        alpha[:, 0] = self.opening
        out = np.where(size == 0, self.opening, 0.0)
        for j in range(1, width + 1):
            n = int(np.searchsorted(-size, -j, side="right"))
            at = s[:n]
            terms = [alpha[:n, (j - 1) % band] + self.byte]
            if j <= self.widest:
                terms.append(self.starts.get(range_hashes(prefix, at, at + j)))
            for i in range(max(0, j - self.widest), j):
                weight = self.inner.get(range_hashes(prefix, at + i, at + j))
                terms.append(np.where(weight > NONE, alpha[:n, i % band] + weight, NONE))
            stack = np.stack(terms)
            top = stack.max(0)
            alpha[:n, j % band] = top + np.log(np.exp(stack - top).sum(0))
            last = int(np.searchsorted(-size, -j, side="left"))
            out[last:n] = alpha[last:n, j % band]
        back = np.empty(len(out))
        back[order] = out
        return back

    def word_logs(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Natural-log marginals of distinct words with hashes ``h``, those met before from the worker's memory."""
        place = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        hit = self.known[place] == h if len(self.known) else np.zeros(len(h), bool)
        out = np.where(hit, self.values[place], 0.0) if len(self.known) else np.zeros(len(h))
        new = np.flatnonzero(~hit)
        if len(new):
            out[new] = self.forward(prefix, s[new], e[new])
            if len(self.known) + len(new) > CACHE:
                self.known, self.values = np.zeros(0, np.uint64), np.zeros(0)
            keys, values = np.concatenate([self.known, h[new]]), np.concatenate([self.values, out[new]])
            order = np.argsort(keys)
            self.known, self.values = keys[order], values[order]
        return out


_lattices: dict[int, Lattice] = {}


def lattice(model: bytes, taught: np.ndarray | None = None) -> Lattice:
    """The lattice of a vocabulary file with what training taught it, kept by the worker process."""
    key = hash((model, b"" if taught is None else taught.tobytes()))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(model, taught)
    return _lattices[key]


def _word_parts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = utf8(part.column("text"))
    s, e, at = words(data, off)
    prefix = prefix_hashes(LOWER[data])
    return prefix, s, e, range_hashes(prefix, s, e), at


def _bytes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """The byte ranges [s, e)."""
    off = np.concatenate([[0], np.cumsum(e - s)])
    own = data[np.arange(off[-1]) + np.repeat(s - off[:-1], e - s)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(off), pa.py_buffer(own)])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the training words of a task with their bytes, and of its training documents' ends."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    docs = 0

    def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        keys, values = np.concatenate([k for k, *_ in held]), np.concatenate([v for _, v, _ in held])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[head], np.add.reduceat(values, head), pa.concat_arrays([t for *_, t in held]).take(pa.array(order[head]))

    def batch(keys: np.ndarray, values: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values), texts.cast(pa.binary())], ["word", "c", "bytes"])

    for whole in batches:
        for part in chunks(whole, "text", 2 * CHUNK):
            data, off = utf8(part.column("text"))
            s, e, _ = words(data, off)
            data = LOWER[data]
            own, first, counts = np.unique(range_hashes(prefix_hashes(data), s, e), return_index=True, return_counts=True)
            docs += part.num_rows
            if len(own):
                held.append((own, counts, _bytes(data, s[first], e[first])))
            if sum(len(k) for k, *_ in held) > MERGE or sum(t.nbytes for *_, t in held) > 16 * CHUNK:
                held = [merged()]
                if len(held[0][0]) > MERGE // 2 or held[0][2].nbytes > 8 * CHUNK:
                    yield batch(*held[0])
                    held = []
    held.append((np.array([END]), np.array([docs]), pa.array([None], pa.large_binary())))
    yield batch(*merged())


ROWS = "word long, key long, id long, times int, n long, known long, head double, score double, pieces double"


def lm_scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The vocabulary file (of fixed size) is read once by the driver and sent to the workers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", row_key())
    held_out = F.coalesce(fold(F.col("id")) == TRAIN_FOLD_OUT, F.lit(False))
    counted = rows.filter(~held_out).select("text").mapInArrow(_count_rows, "word long, c long, bytes binary")
    end_word = int(END.view(np.int64))
    counts = cut(counted.groupBy("word", "bytes").agg(F.sum("c").alias("c")).filter("c > 0"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == end_word, F.col("c"))), F.lit(0)).alias("ends")).first()
    tokens, kinds, ends = total["n"], total["v"], total["ends"]
    single = counts.filter(F.col("word") != end_word).agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    discount = single["once"] / (single["once"] + 2 * single["twice"]) if single["once"] and single["twice"] else 0.5
    word_tokens, word_kinds = tokens - ends, kinds - (1 if ends else 0)
    pieces_log = math.log10(discount * word_kinds / word_tokens) if word_tokens else 0.0
    least = max(1, -(-tokens // HEAD))
    # counts sum to ``tokens``, so at most HEAD of them reach ``least``
    head = counts.filter(F.col("c") >= least).select("word", "c").toArrow() if tokens else pa.table({"word": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    order = np.argsort(keys := head.column("word").to_numpy().view(np.uint64))
    context = docs.sparkSession.sparkContext
    with open(model_path, "rb") as file:
        shipped = context.broadcast((keys[order], head.column("c").to_numpy()[order], file.read()))
    taught = None

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, uses = lattice(shipped.value[2], learned.value), 0.0
        held: list[pa.Array] = []
        for part in itertools.chain(batches, [None]):
            held += [part.column("bytes")] if part else []
            if held and (part is None or sum(map(len, held)) >= TAUGHT or sum(x.nbytes for x in held) >= CHUNK):
                _, off, data = pa.concat_arrays([x.cast(pa.large_binary()) for x in held]).buffers()
                data, off = np.frombuffer(data, np.uint8), np.frombuffer(off, np.int64)[: 1 + sum(map(len, held))]
                uses, held = uses + pieces.expected(prefix_hashes(data), off[:-1], off[1:]), []
        if not np.isscalar(uses):
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(uses[some])], ["piece", "uses"])

    for _ in range(ROUNDS if word_tokens else 0):
        learned = context.broadcast(taught)
        uses = counts.filter(F.col("bytes").isNotNull()).select("bytes").mapInArrow(teach, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # a row for each piece at most
        taught = np.zeros(len(lattice(shipped.value[2]).logs) - 1)
        taught[uses.column("piece").to_numpy()] = uses.column("uses").to_numpy()
    learned = context.broadcast(taught)
    share = (ends + 0.5) / (tokens + 1)
    end_log, stay_log = math.log10(share), math.log10(1 - share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, model = shipped.value
        pieces = lattice(model, learned.value)
        logs = np.log10(count + 0.5)
        edges = np.log10(np.maximum(count - discount, 1e-9) / max(1, word_tokens))
        for whole in batches:
            for part in chunks(whole, "text"):
                prefix, s, e, h, at = _word_parts(part)
                own, first, back = np.unique(h, return_index=True, return_inverse=True)
                marginal = pieces.word_logs(prefix, s[first], e[first], own) / LN10 + pieces_log
                place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                hit = known[place] == own if len(known) else np.zeros(len(own), bool)
                value = np.where(hit, logs[place], 0.0) if len(known) else np.zeros(len(own))
                # a word that is not at hand may have an edge among the counts that are joined
                whole_word = np.where(hit, np.logaddexp(edges[place] * LN10, marginal * LN10) / LN10 + stay_log, 0.0) if len(known) else np.zeros(len(own))
                doc = np.repeat(np.arange(part.num_rows), np.diff(at))
                keys = part.column("key").to_numpy()
                # without any word numpy would count in whole numbers
                sums = [np.bincount(doc, x[back], part.num_rows).astype(float) for x in (whole_word, hit.astype(float), value)]
                size = np.diff(at) + 1
                spread = mix(keys.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(keys), part.column("id"), pa.nulls(len(keys), pa.int32()), pa.array(size), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[0] + end_log), pa.nulls(len(keys), pa.float64())], NAMES)
                tail = np.flatnonzero(~hit[back])
                pair = back[tail] * np.int64(part.num_rows) + doc[tail]
                pair, times = np.unique(pair, return_counts=True)
                if len(pair):
                    n = len(pair)
                    yield pa.RecordBatch.from_arrays([pa.array(own[pair // part.num_rows].view(np.int64)), pa.array(keys[pair % part.num_rows]), pa.nulls(n, pa.int64()), pa.array(times.astype(np.int32)), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())), pa.array(marginal[pair // part.num_rows])], NAMES)

    NAMES = [c.split()[0] for c in ROWS.split(", ")]
    scored = rows.mapInArrow(score, ROWS)
    seen = counts.filter(F.col("c") < least).select(F.col("word").alias("counted"), "c")
    joined = scored.join(seen, (F.col("word") == F.col("counted")) & F.col("times").isNotNull(), "left")
    part = F.coalesce(F.col("head"), F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    # the joined edge plus the pieces: 10^x + 10^y without underflow of the greater
    edge = F.log10((F.col("c") - discount) / max(1, word_tokens))
    top = F.greatest("pieces", F.coalesce(edge, F.col("pieces")))
    both = F.when(F.col("c").isNull(), F.col("pieces")).otherwise(top + F.log10(F.pow(F.lit(10.0), edge - top) + F.pow(F.lit(10.0), F.col("pieces") - top)))
    sums = joined.groupBy("key").agg(F.max("id").alias("id"), F.count("n").alias("k"), F.sum("n").alias("n"), F.sum(F.coalesce(F.col("known"), F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("known"), F.sum(part).alias("base"), F.sum(F.coalesce(F.col("score"), F.col("times") * (both + stay_log))).alias("score"))
    n = (F.col("n") / F.col("k")).cast("long")
    base = F.col("base") / F.col("k") + math.log10(ends + 0.5) - n * math.log10(tokens + 0.5 * (kinds + 1))
    known = (F.col("known") / F.col("k")).cast("long") + (1 if ends else 0)
    return sums.select(F.col("id").alias(id_col), held_out.alias("held_out"), n.alias("n_tokens"), known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") / F.col("k")).alias("score"))
