"""The trie of conversation prefixes, by the van Emde Boas recursion over depth.

A turn's name is a digest of its role and text. Sequences are cut at half depth: the name of the cut prefix becomes the
top of its lower sequences, so upper trie and lower forests are named independently of each other, down to single turns.
The first cuts, down to pieces of ``PIECE`` turns, are joins over the pieces of all conversations; within a piece the same
recursion runs over an array. A node's name is the name of its prefix; its owner is the smallest conversation that starts
with it, which also owns everything below it on its own path.

Totals are grafted upward in as many rounds as depth has binary digits. After round k every node knows the total of its
subtree within its block of 2^k depths; in the next round each root of a lower block sends its total to its ancestors in
the upper block, found on the owner's path. A node sends 2^k rows in one round only, so all rounds together make
N log H rows instead of the N H of sending to every ancestor. Sums are partially aggregated, so a prefix that all
conversations share is no hot key.

A conversation is ranked in pieces of ``PIECE`` turn numbers, so that one with very many turns is spread out; member lists
are digested from pieces of ``ENDS`` consecutive ids, in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustspark.llm.common import cut

PIECE, ENDS = 256, 256
#: The name of the empty prefix.
ROOT = hashlib.md5(b"").digest()
HEAD = 6


def _both(a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat(a, b)))


def ranked(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place from 1, name, n_chars) of every turn of a conversation with an id.

    Order is by turn, null first; turns of one number stand in the order of their names, so the texts are not shuffled.
    Null role and text are empty. Repeated rows are turns of their own; a null conversation's rows take no part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), name.alias("name"), F.length(text).cast("long").alias("n_chars"))
    bucket = F.coalesce(F.floor(F.col("turn") / PIECE), F.lit(-(2**62)))
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy("conv", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("conv", "bucket").orderBy("turn", "name"))
    placed = rows.withColumn("inner", inner).join(sizes, ["conv", "bucket"])
    return placed.select("conv", (F.col("before") + F.col("inner")).alias("place"), "name", "n_chars")


def rebuilt(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): every conversation c with the first h turns of conversation c - c % 100 in place of its own
    first h, h being the checksum of its id modulo 6. A rebuilt conversation may have no turn."""
    own = cut(ranked(turns, **columns))
    convs = own.filter("place = 1").select("conv", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD)).alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    heads = own.filter((F.col("conv") % 100 == 0) & (F.col("place") < HEAD))  # a few rows for each hundred conversations
    length = heads.groupBy(F.col("conv").alias("base")).agg(F.max("place").alias("length"))
    convs = cut(convs.join(length, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("length", F.lit(0))).alias("lead")))
    lead = convs.filter("lead > 0").join(heads.withColumnRenamed("conv", "base"), "base").filter("place <= lead").select("conv", "place", "name", "n_chars")
    tail = own.join(convs.select("conv", "h", "lead"), "conv").filter("place > h").select("conv", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "name", "n_chars")
    return convs.select("conv"), lead.unionByName(tail)


def _half(count: int) -> int:
    """The largest power of two below ``count``, 1 at least."""
    return 1 << max(0, (count - 1).bit_length() - 1)


def _digest(names: list[bytes], lo: int, hi: int) -> bytes:
    """The name of a sequence of turns, from those of its halves."""
    if hi - lo == 1:
        return names[lo]
    mid = lo + _half(hi - lo)
    return hashlib.md5(_digest(names, lo, mid) + _digest(names, mid, hi)).digest()


def _prefixes(names: list[bytes], lo: int, size: int, top: bytes, out: list[bytes]) -> None:
    """Appends the names of the prefixes that end within ``names[lo : lo + size]``, below the prefix named ``top``.

    ``size`` is a power of two; the sequence may end before. Upper and lower half need nothing of each other but the name
    of the cut prefix.
    """
    if lo >= len(names):
        return
    if size == 1:
        out.append(hashlib.md5(top + names[lo]).digest())
        return
    half = size // 2
    _prefixes(names, lo, half, top, out)
    if lo + half <= len(names):
        out.pop()
        cut_name = hashlib.md5(top + _digest(names, lo, lo + half)).digest()
        out.append(cut_name)
        _prefixes(names, lo + half, half, cut_name, out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        names = [_digest(x, 0, len(x)) for x in part.column("names").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("piece"), pa.array(names, pa.binary())], ["conv", "piece", "name"])


def _piece_tops(pieces: DataFrame, full: int, size: int) -> DataFrame:
    """(conv, piece, top): the name of the prefix before each piece but the first, and after the last if that is full.

    The recursion over the first cuts: names of spans of 2^k pieces upward, then names of cut prefixes downward. ``full`` is
    the most full pieces that a conversation has.
    """
    spans = [cut(pieces.filter(F.size("names") == size).mapInArrow(_digests, "conv long, piece long, name binary"))]
    while full >> len(spans):
        pairs = spans[-1].groupBy("conv", F.shiftright("piece", 1).alias("piece")).agg(F.count("*").alias("n"), F.min_by("name", "piece").alias("a"), F.max_by("name", "piece").alias("b"))
        spans.append(cut(pairs.filter("n = 2").select("conv", "piece", _both(F.col("a"), F.col("b")).alias("name"))))
    tops = spans[0].filter("piece = 0").select("conv", F.lit(0).cast("long").alias("piece"), F.lit(ROOT).alias("top"))
    for k in reversed(range(len(spans))):
        span = spans[k].withColumn("piece", F.shiftleft("piece", k))
        lower = tops.filter(F.col("piece") % (2 << k) == 0).join(span, ["conv", "piece"])
        tops = cut(tops.unionByName(lower.select("conv", (F.col("piece") + (1 << k)).alias("piece"), _both(F.col("top"), F.col("name")).alias("top"))))
    return tops.filter("piece > 0")


def _named(size: int):  # noqa: ANN202
    """Every prefix that ends within a piece of ``size`` turns: its name, its parent's, and what its last turn holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                conv, depth, node, parent, chars, length = ([] for _ in range(6))
                for r in whole.slice(at, 1000).to_pylist():
                    top, out = r["top"] or ROOT, []
                    _prefixes(r["names"], 0, size, top, out)
                    if r["bottom"] is not None:
                        out[-1] = r["bottom"]
                    n = len(out)
                    conv += [r["conv"]] * n
                    depth += range(r["piece"] * size + 1, r["piece"] * size + n + 1)
                    node += out
                    parent += [top, *out[:-1]]
                    chars += r["sizes"]
                    length += [r["length"]] * n
                columns = zip((conv, depth, node, parent, chars, length), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["conv", "depth", "node", "parent", "n_chars", "length"])

    return run


def paths(convs: DataFrame, turns: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv, depth, node, parent, n_chars, length): every prefix of every conversation, the empty one included."""
    pieces = turns.groupBy("conv", F.floor((F.col("place") - 1) / size).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("place", "name", "n_chars"))).alias("all"))
    pieces = cut(pieces.select("conv", "piece", F.col("all.name").alias("names"), F.col("all.n_chars").alias("sizes")))
    lengths = pieces.groupBy("conv").agg(F.max(F.col("piece") * size + F.size("names")).alias("length"))
    full = pieces.filter(F.size("names") == size).agg(F.max("piece")).first()[0]
    rows = pieces.join(lengths, "conv")
    if full is None:
        rows = rows.withColumns({"top": F.lit(None).cast("binary"), "bottom": F.lit(None).cast("binary")})
    else:
        tops = _piece_tops(pieces, full + 1, size)
        rows = rows.join(tops, ["conv", "piece"], "left").join(tops.select("conv", (F.col("piece") - 1).alias("piece"), F.col("top").alias("bottom")), ["conv", "piece"], "left")
    below = rows.select("conv", "piece", "names", "sizes", "length", "top", "bottom").mapInArrow(_named(size), "conv long, depth long, node binary, parent binary, n_chars long, length long")
    tops = convs.join(lengths, "conv", "left").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_chars"), F.coalesce("length", F.lit(0)).alias("length"))
    return tops.unionByName(below)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each node's list, of which the pieces come one after the other."""
    now, state = None, None
    for part in batches:
        done = []
        for node, ids in zip(part.column("node").to_pylist(), part.column("ids").to_pylist(), strict=True):
            if node != now:
                if state:
                    done.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["node", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends"])


def member_lists(rows: DataFrame) -> DataFrame:
    """(node, ends): the digest of the comma-joined ``conv`` of each node, in numeric order."""
    pieces = rows.groupBy("node", F.shiftright("conv", ENDS.bit_length() - 1).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(_listed, "node binary, ends string")


#: Binary digits of depth within which ancestors are looked up by one key.
SPAN = 16


def grafted(nodes: DataFrame, path: DataFrame, deepest: int, digits: int = SPAN) -> DataFrame:
    """(node, leaves, saved): the sums of ``nodes (node, owner, depth, leaves, saved)`` over their subtrees.

    A node sends its total, complete but for its own block, in the round of its depth's lowest binary digit.
    """
    lowest = F.col("depth").bitwiseAND(-F.col("depth"))
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    received = None
    for k in range(deepest.bit_length()):
        low = min(k, digits)
        rows = nodes.select("node", "owner", "depth", "leaves", "saved")
        if received is not None:
            rows = rows.unionByName(received, allowMissingColumns=True)
        senders = rows.filter(lowest == 1 << k).groupBy("node").agg(F.max("owner").alias("conv"), F.max("depth").alias("from"), *sums)
        senders = senders.withColumn("span", F.explode(F.sequence(F.shiftright(F.col("from") - (1 << k), low), F.shiftright(F.col("from") - 1, low)))).drop("node")
        upper = path.filter((F.shiftright("depth", k) % 2 == 0) & ((F.shiftright("depth", k) + 1) * (1 << k) <= F.col("length")))
        sent = upper.select("conv", "node", "depth", F.shiftright("depth", low).alias("span")).join(senders, ["conv", "span"])
        # only the k-th digit's own block matches: the owner's path has one sender for each block
        sent = sent.groupBy("node").agg(F.max("depth").alias("depth"), *sums)
        received = cut(sent) if received is None else received.unionByName(cut(sent))
    every = nodes.select("node", "depth", "leaves", "saved")
    return (every if received is None else every.unionByName(received)).groupBy("node").agg(*sums)


def prefix_trie(conversations: tuple[DataFrame, DataFrame], size: int = PIECE, digits: int = SPAN) -> DataFrame:
    """One row per distinct prefix of the conversations: (convs ``conv``; turns ``conv, place, name, n_chars``).

    Columns: conv_id, the smallest conversation that starts with it; depth; parent_conv_id, that of its parent (null for
    the empty prefix); n_convs, conversations that start with it; n_children; n_leaves, nodes of its subtree without
    children; saved_tokens, code points of last turns that all but one conversation need not store, over its subtree;
    ends_sha256, the digest of the ids of the conversations that end with it. No conversations give no rows.
    ``size`` is the number of turns that are held as one array, a power of two.
    """
    path = cut(paths(*conversations, size))
    first = lambda c: F.any_value(c).alias(c)
    nodes = cut(path.groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), first("depth"), first("parent"), first("n_chars")))
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = cut(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    worth = nodes.select("node", "owner", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    totals = grafted(worth, path, deepest, digits)
    ends = member_lists(path.filter("depth = length").select("node", "conv"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(totals, "node").join(ends, "node", "left").join(parents, "parent", "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
