"""Boxes that hold a label (the patient rule induction method): a step counts all columns of the box in ranges, mostly in one
pass over the rows for all labels that are peeled together: where a cut will lie is guessed from the step before, and the
values near it are counted one by one. No column is sorted or gathered.

A box keeps, by column and in the order in which columns were first restricted, a pair of strict limits; a pair of equal
limits is the one value of a binary column that is left. Nothing but one row per candidate comes to the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustspark.sources.files import scratch, written

Box = dict[str, tuple[float | None, float | None]]


def inside(box: Box) -> Column:
    """The box as a predicate."""
    out = F.lit(True)
    for name, (low, high) in box.items():
        if low is not None and low == high:
            out = out & (F.col(name) == low)
            continue
        out = out & (F.col(name) > low) if low is not None else out
        out = out & (F.col(name) < high) if high is not None else out
    return out


def box_stats(rows: DataFrame, box: Box, label: str) -> DataFrame:
    """One row: n, inside, hits, coverage, density."""
    hit = F.when(inside(box), F.col(label))
    out = rows.agg(F.count("*").alias("n"), F.count(hit).alias("inside"), F.sum(hit).alias("hits"), F.sum(label).alias("all"))
    return out.select("n", "inside", "hits", (F.col("hits") / F.col("all")).alias("coverage"), (F.col("hits") / F.col("inside")).alias("density"))


#: Parts in which a pass counts the values of a column's range, and the distinct values that a task lists of a short one.
PARTS, LISTED = 256, 4096
#: Parts of a column whose cuts are guessed.
FEW = 32
#: Rows that are stored as one.
BLOCK = 16_384


@dataclass
class Peeling:
    """One label that is peeled for: its columns, the box so far, and what the steps took."""

    label: str
    columns: Sequence[str]
    binary: Sequence[str] = ()
    box: Box = field(default_factory=dict)
    kept: int = 0
    hits: float = 0.0
    ends: dict[str, tuple[float, float]] = field(default_factory=dict)
    #: Of the last step: each column's parts, and the column, side, limit and number of rows it started from.
    parts: dict[str, list] = field(default_factory=dict)
    last: tuple[str, str, float, int] | None = None


@dataclass
class _Cut:
    """A place sought in a column of a peeling: the range that holds it, and the rows and hits below the range."""

    owner: int
    column: str
    place: int
    low: float
    high: float
    below: int = 0
    below_hits: float = 0.0
    count: int = 0
    count_hits: float = 0.0


def packed(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Blocks of up to ``BLOCK`` rows, a column's numbers as bytes (null as NaN), stored and read back.

    All steps read these rows again, and need neither plan how they came about nor turn them one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            held += [batch] if batch else []
            if held and (batch is None or sum(x.num_rows for x in held) >= BLOCK):
                columns = [np.concatenate([x.column(c).to_numpy(zero_copy_only=False).astype(float) for x in held]).tobytes() for c in names]
                held = []
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], list(names))

    blocks = rows.select(*names).mapInArrow(run, ", ".join(f"`{c}` binary" for c in names))
    return written(blocks, scratch(rows.sparkSession, "peeled"), compression="none")


@dataclass(frozen=True)
class _Range:
    """Values of a column of a peeling that a pass counts, in parts or, if ``listed``, one by one."""

    owner: int
    column: str
    low: float
    high: float
    listed: bool = False
    n_parts: int = PARTS


@dataclass
class _Counts:
    """What a pass found in a range: (part, rows, hits, least and greatest value) in order; of a listed one also the rows and hits below it."""

    parts: list[tuple[int, int, float, float, float]] = field(default_factory=list)
    below: int = 0
    below_hits: float = 0.0
    whole: bool = True


def _counted(rows: DataFrame, owners: Sequence[Peeling], ranges: Sequence[_Range]) -> list[_Counts]:
    """What the rows of each range's owner's box have in it.

    The rows are read once for all ranges; a task sends a row for each part that it meets, and for each value that it
    lists. A listed range in which a task meets over ``LISTED`` values is not whole.
    """
    own_ranges: dict[int, list[tuple[int, _Range]]] = {k: [] for k in range(len(owners))}
    for r, x in enumerate(ranges):
        own_ranges[x.owner].append((r, x))
    used = dict.fromkeys(c for k, own in own_ranges.items() if own for c in (*owners[k].box, owners[k].label, *(x.column for _, x in own)))
    rows = rows.select(*used)
    wanted = [(o.label, dict(o.box)) for o in owners]
    below, over = PARTS, PARTS + 1
    slots = PARTS + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ranges) * slots
        n, hits, least, most = np.zeros(size, np.int64), np.zeros(size), np.full(size, np.inf), np.full(size, -np.inf)
        lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(r: int) -> None:
            v, y = (np.concatenate(x) for x in zip(*waiting.pop(r), strict=True))
            old = lists.get(r, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0)))
            values, at = np.unique(np.concatenate([old[0], v]), return_inverse=True)
            lists[r] = values, np.bincount(at, np.concatenate([old[1], np.ones(len(v), np.int64)]), len(values)).astype(np.int64), np.bincount(at, np.concatenate([old[2], y]), len(values))
            if len(values) > LISTED:
                n[r * slots + over] = 1
                del lists[r]

        for columns in ({c: np.frombuffer(batch.column(c)[i].as_buffer()) for c in batch.schema.names} for batch in batches for i in range(batch.num_rows)):
            for k, (label, box) in enumerate(wanted):
                if not own_ranges[k]:
                    continue
                there = np.ones(len(columns[label]), bool)
                for name, (low, high) in box.items():
                    v = columns[name]
                    there &= v == low if low is not None and low == high else (v > (-np.inf if low is None else low)) & (v < (np.inf if high is None else high))
                if not there.any():
                    continue
                kept_rows = np.flatnonzero(there)
                y = columns[label][kept_rows]
                taken: dict[str, np.ndarray] = {}
                for r, x in own_ranges[k]:
                    if x.column not in taken:
                        taken[x.column] = columns[x.column][kept_rows]
                    v, hit = taken[x.column], y
                    if x.listed:
                        under = v < x.low
                        n[r * slots + below] += np.count_nonzero(under)
                        hits[r * slots + below] += hit[under].sum()
                    within = (v >= x.low) & (v <= x.high)
                    if not within.all():
                        v, hit = v[within], y[within]
                    if not len(v):
                        continue
                    if x.listed:
                        if not n[r * slots + over]:
                            waiting.setdefault(r, []).append((v, hit))
                            if sum(len(v) for v, _ in waiting[r]) > 4 * LISTED:
                                merge(r)
                        continue
                    part = np.minimum(x.n_parts - 1, (v / 2 - x.low / 2) / (x.high / 2 - x.low / 2) * x.n_parts).astype(np.int64) if x.low < x.high else np.zeros(len(v), np.int64)
                    # only the range's own parts are touched
                    own = slice(r * slots, r * slots + PARTS)
                    n[own] += np.bincount(part, minlength=PARTS)
                    hits[own] += np.bincount(part, hit, PARTS)
                    np.minimum.at(least[own], part, v)
                    np.maximum.at(most[own], part, v)
        for r in list(waiting):
            merge(r)
        some = np.flatnonzero(n)
        # a listed value is a group of its own
        out = [(some, np.zeros(len(some)), n[some], hits[some], least[some], most[some])]
        out += [(np.full(len(v), r * slots), v, c, h, v, v) for r, (v, c, h) in lists.items()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["slot", "value", "n", "hits", "least", "most"])

    parts = rows.mapInArrow(run, "slot long, value double, n long, hits double, least double, most double")
    parts = parts.groupBy("slot", "value").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("least").alias("least"), F.max("most").alias("most"))
    out = [_Counts() for _ in ranges]
    table = parts.drop("value").toArrow()  # at most PARTS for each range, or the values listed
    slot, least = table.column("slot").to_numpy(), table.column("least").to_numpy()
    order = np.lexsort((least, slot))
    for at, n, hits, low, high in zip(slot[order].tolist(), *(table.column(c).to_numpy()[order].tolist() for c in ("n", "hits", "least", "most")), strict=True):
        own, part = out[at // slots], at % slots
        if part == below:
            own.below, own.below_hits = n, hits
        elif part == over:
            own.whole = False
        else:
            own.parts.append((part, n, hits, low, high))
    return out


def _guess(o: Peeling, name: str, place: int) -> tuple[float, float] | None:
    """Where the value at a place of a column should lie, from the parts of the step before.

    The peel took all rows beyond its limit of its own column, and of another column's parts about the same share each. The
    range is wide enough for a few times the error of that; a guess that fails costs a pass.
    """
    if o.last is None or not o.parts.get(name):
        return None
    column, side, limit, before = o.last
    parts = [(n, low, high) for _, n, _, low, high in o.parts[name]]
    if name == column:
        parts = [(n, max(low, limit), high) for n, low, high in parts if high > limit] if side == "low" else [(n, low, min(high, limit)) for n, low, high in parts if low < limit]
        if not parts:
            return None
        edge = 0 if side == "low" else -1
        parts[edge] = (o.kept - sum(p[0] for p in parts) + parts[edge][0], *parts[edge][1:])
    else:
        parts = [(n * o.kept / before, low, high) for n, low, high in parts]
    below = 0.0
    for n, low, high in parts:
        if place < below + n or (n, low, high) == parts[-1]:
            n = max(n, 1.0)
            error = 4 * (math.sqrt(0.05 * (before - o.kept)) + math.sqrt(n) / 2) + 16
            middle, half = low + (high - low) * min(1.0, (place - below + 0.5) / n), (high - low) * error / n
            return middle - half, middle + half
        below += n
    return None


def candidates(rows: DataFrame, owners: Sequence[Peeling], alpha: float) -> list[list[tuple[str, str, float, int, float]]]:
    """Per peeling the peels it may take: column, side, where it cuts, and the rows and hits that stay.

    A column is cut at its order statistics within the box; a binary column loses one of its two values (side ``drop``).
    ``rows`` are ``packed``. All peelings share each pass over them; a range is counted again only where a place still lies among several values,
    which are listed then if they are few.
    """
    # with a guess at hand, the parts of a whole column only serve the next guess
    first = [_Range(k, c, *o.ends[c], n_parts=FEW if o.last else PARTS) for k, o in enumerate(owners) for c in o.columns if c in o.ends and o.kept]
    places = lambda n: {"low": math.floor((n - 1) * alpha + 1e-9), "high": math.ceil((n - 1) * (1 - alpha) - 1e-9)}
    guessed = {(x.owner, x.column, side): g for x in first if x.column not in owners[x.owner].binary for side, place in places(owners[x.owner].kept).items() if (g := _guess(owners[x.owner], x.column, place))}
    near = [_Range(k, c, *g, True) for (k, c, _), g in guessed.items()]
    counted = _counted(rows, owners, [*first, *near])
    listed = dict(zip(guessed, counted[len(first) :], strict=True))
    out: list[list] = [[] for _ in owners]
    cuts: dict[tuple[int, str, str], _Cut] = {}
    totals: dict[tuple[int, str], tuple[int, float]] = {}
    whole: dict[tuple[int, str], list] = {}
    for x, found in zip(first, counted, strict=False):
        k, c, parts = x.owner, x.column, found.parts
        n, hits = sum(p[1] for p in parts), sum(p[2] for p in parts)
        if not n:
            continue
        totals[k, c], whole[k, c] = (n, hits), parts
        owners[k].ends[c] = (parts[0][3], parts[-1][4])
        owners[k].parts[c] = parts
        if c in owners[k].binary:
            continue
        for side, place in places(n).items():
            cut = _narrowed(_Cut(k, c, place, x.low, x.high), parts)
            own = listed.get((k, c, side))
            if cut.low < cut.high and own and own.whole and own.below <= place < own.below + sum(p[1] for p in own.parts):
                cut = _narrowed(_Cut(k, c, place, x.low, x.high, own.below, own.below_hits), own.parts)
            cuts[k, c, side] = cut
    while open_ := sorted({(x.owner, x.column, x.low, x.high, x.count <= LISTED) for x in cuts.values() if x.low < x.high}):
        counted = _counted(rows, owners, [_Range(*x) for x in open_])
        number = {x[:4]: i for i, x in enumerate(open_)}
        cuts = {key: _narrowed(x, counted[number[x.owner, x.column, x.low, x.high]].parts) if x.low < x.high else x for key, x in cuts.items()}
    for k, c in ((x.owner, x.column) for x in first):
        if (k, c) not in totals:
            continue
        n, hits = totals[k, c]
        if c in owners[k].binary:
            # the two values are the first and the last part
            out[k] += [(c, "drop", p[3], n - p[1], hits - p[2]) for p in sorted({whole[k, c][0], whole[k, c][-1]})]
            continue
        low, high = cuts[k, c, "low"], cuts[k, c, "high"]
        out[k].append((c, "low", low.low, n - low.below - low.count, hits - low.below_hits - low.count_hits))
        out[k].append((c, "high", high.low, high.below, high.below_hits))
    return out


def _narrowed(x: _Cut, parts: Sequence[tuple[int, int, float, float, float]]) -> _Cut:
    """The cut with the part that holds its place for a range."""
    below, below_hits = x.below, x.below_hits
    for _, n, hits, least, most in parts:
        if x.place < below + n:
            return _Cut(x.owner, x.column, x.place, least, most, below, below_hits, n, hits)
        below, below_hits = below + n, below_hits + hits
    raise AssertionError("a place lies within its range")


def medians(rows: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """The exact median of each column of numbers, NaN and null left out; between the middle two in proportion. A column without numbers has none."""
    blocks = packed(rows.withColumn("y", F.lit(0.0)), [*names, "y"])
    one = [Peeling("y", list(names))]
    # the ends of the range are the finite ones; a pass then tells what occurs
    counted = _counted(blocks, one, ranges := [_Range(0, c, -1.7e308, 1.7e308) for c in names])
    cuts = {}
    for x, found in zip(ranges, counted, strict=True):
        if n := sum(p[1] for p in found.parts):
            for place in {(n - 1) // 2, n // 2}:
                cuts[x.column, place] = _narrowed(_Cut(0, x.column, place, x.low, x.high), found.parts)
    while open_ := sorted({(0, x.column, x.low, x.high, x.count <= LISTED) for x in cuts.values() if x.low < x.high}):
        counted = _counted(blocks, one, [_Range(*x) for x in open_])
        number = {x[1:4]: i for i, x in enumerate(open_)}
        cuts = {key: _narrowed(x, counted[number[x.column, x.low, x.high]].parts) if x.low < x.high else x for key, x in cuts.items()}
    out = {}
    for c in names:
        own = [x.low for (name, _), x in sorted(cuts.items()) if name == c]
        if own:
            out[c] = own[0] + (own[-1] - own[0]) * (0.5 if len(own) > 1 else 0.0)
    return out


def peel_candidates(rows: DataFrame, columns: Sequence[str], label: str, alpha: float, n: int, binary: Sequence[str] = ()) -> DataFrame:
    """Per column and side of ``n`` rows: where a peel would cut, and the count and mean of what it keeps."""
    one = _started(rows, [Peeling(label, columns, binary)])
    found = candidates(packed(rows, list(dict.fromkeys([*columns, label]))), one, alpha)[0] if n else []
    return rows.sparkSession.createDataFrame([(c, s, float(x), k, h / k if k else None) for c, s, x, k, h in found], "name string, side string, limit_value double, kept long, mean double")


def _started(rows: DataFrame, owners: list[Peeling]) -> list[Peeling]:
    """The peelings with the counts of all rows and the ends of their columns, from one pass."""
    names = list(dict.fromkeys(c for o in owners for c in o.columns))
    labels = list(dict.fromkeys(o.label for o in owners))
    ends = [F.struct(F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")).alias(f"e{i}") for i, c in enumerate(names)]
    r = rows.agg(F.count("*").alias("n"), *ends, *(F.sum(F.col(y).cast("double")).alias(f"h{i}") for i, y in enumerate(labels))).first()
    for o in owners:
        o.kept, o.hits = r["n"], r[f"h{labels.index(o.label)}"] or 0.0
        o.ends = {c: (e["lo"], e["hi"]) for c in o.columns if (e := r[f"e{names.index(c)}"])["lo"] is not None}
    return owners


@dataclass(frozen=True)
class Found:
    """A box with the share of rows it holds, of the label's total it covers, and the label's mean in it."""

    box: Box
    kept: int
    support: float
    coverage: float
    density: float


def measured(rows: DataFrame, box: Box, label: str, n: int, hits: float) -> Found:
    """A box's figures, as shares of ``n`` rows and of ``hits``."""
    r = rows.filter(inside(box)).agg(F.count("*").alias("kept"), F.sum(label).alias("hits")).first()
    return Found(box, r["kept"], r["kept"] / n if n else 0.0, (r["hits"] or 0) / hits if hits else 0.0, (r["hits"] or 0) / r["kept"] if r["kept"] else 0.0)


def prim_all(rows: DataFrame, owners: Sequence[Peeling], alpha: float = 0.05, least_support: float = 0.05, n: int | None = None, hits: Sequence[float] | None = None) -> list[list[dict]]:
    """The trajectories of peels of some labels over the same kept rows, one pass or few for each step of all.

    A peel takes the largest gain in mean per removed row, then the most rows kept, then the first column. ``n`` and ``hits``
    (a number for each label) are the totals that support and coverage refer to, if not those of ``rows``. Some 60 peels end it.
    """
    names = list(dict.fromkeys([c for o in owners for c in (*o.columns, o.label)]))
    owners = _started(rows, list(owners))
    rows = packed(rows, names) if names else rows
    base = owners[0].kept if n is None else n
    all_hits = [o.hits for o in owners] if hits is None else list(hits)
    out: list[list[dict]] = [[] for _ in owners]
    live = [k for k, o in enumerate(owners) if o.kept]
    while live:
        found = candidates(rows, [owners[k] for k in live], alpha)
        going = []
        for k, choices in zip(live, found, strict=True):
            o, best = owners[k], None
            mean = o.hits / o.kept
            for name, side, limit, kept, own_hits in choices:
                if not 0 < kept < o.kept or (side != "drop" and kept < math.ceil(least_support * base)):
                    continue
                key = ((own_hits / kept - mean) / (o.kept - kept), kept)
                if best is None or key > best[0]:
                    best = (key, name, side, limit, kept, own_hits)
            if best is None or best[0][0] <= 0:
                continue
            _, name, side, limit, kept, own_hits = best
            low, high = o.box.get(name, (None, None))
            if side == "drop":
                low = high = next(x for x in o.ends[name] if x != limit)
            elif side == "low":
                low = limit
            else:
                high = limit
            o.last = (name, side, limit, o.kept)
            o.box, o.kept, o.hits = {**o.box, name: (low, high)}, kept, own_hits
            out[k].append({"step": len(out[k]) + 1, "name": name, "side": side, "limit_value": float(limit), "kept": kept, "density": own_hits / kept, "coverage": own_hits / all_hits[k] if all_hits[k] else 0.0, "box": o.box, "support": kept / base})
            going.append(k)
        live = going
    return out


def prim(rows: DataFrame, columns: Sequence[str], label: str, alpha: float = 0.05, least_support: float = 0.05, binary: Sequence[str] = (), n: int | None = None, hits: float | None = None) -> list[dict]:
    """The trajectory of one label."""
    return prim_all(rows, [Peeling(label, columns, binary)], alpha, least_support, n, None if hits is None else [hits])[0]


def pick_box(trajectory: list[dict], most_columns: int = 3) -> Found | None:
    """The densest box of a trajectory with at most ``most_columns`` restricted columns, then the one of most coverage."""
    fit = [x for x in trajectory if len(x["box"]) <= most_columns]
    best = max(fit, key=lambda x: (x["density"], x["coverage"]), default=None)
    return best and Found(best["box"], best["kept"], best["support"], best["coverage"], best["density"])


def prune_all(rows: DataFrame, found: Sequence[tuple[Found, str, float]], n: int, tolerance: float = 0.01) -> list[Found]:
    """Each box (with its label and the label's total) without restrictions, last first, while the density stays within ``tolerance`` of the box given; one stays.

    All boxes share the passes over the rows, one for each restriction of the longest box.
    """
    now = [x for x, *_ in found]
    for turn in range(max((len(x.box) for x in now), default=0)):
        trials = []
        for k, (x, label, _) in enumerate(found):
            names = list(reversed(x.box))
            if turn < len(names) and len(now[k].box) > 1:
                trials.append((k, {c: v for c, v in now[k].box.items() if c != names[turn]}, label))
        if not trials:
            break
        r = rows.agg(*(f(inside(box), label).alias(f"{kind}{k}") for k, box, label in trials for kind, f in (("k", lambda there, _: F.count_if(there)), ("h", lambda there, label: F.sum(F.when(there, F.col(label))))))).first()
        for k, box, _ in trials:
            kept, own, all_hits = r[f"k{k}"], r[f"h{k}"] or 0, found[k][2]
            trial = Found(box, kept, kept / n if n else 0.0, own / all_hits if all_hits else 0.0, own / kept if kept else 0.0)
            if trial.density >= found[k][0].density - tolerance:
                now[k] = trial
    return now


def prune_box(rows: DataFrame, found: Found, label: str, n: int, hits: float, tolerance: float = 0.01) -> Found:
    """``prune_all`` of one box."""
    return prune_all(rows, [(found, label, hits)], n, tolerance)[0]


def find_boxes(rows: DataFrame, columns: Sequence[str], label: str, binary: Sequence[str] = (), most_boxes: int = 3, **options) -> list[Found]:
    """Boxes one after the other, each over the rows that those before it leave; a box must be denser than what is left."""
    rows = rows.select(*columns, label).persist()
    total = rows.agg(F.count("*").alias("n"), F.sum(label).alias("hits")).first()
    n, hits = total["n"], total["hits"] or 0.0
    left, out = rows, []
    for _ in range(most_boxes):
        rest = left.agg(F.sum(label).alias("hits"), F.avg(label).alias("mean")).first()
        if (rest["hits"] or 0) < max(1, 0.05 * hits):
            break
        picked = pick_box(prim(left, columns, label, binary=binary, n=n, hits=hits, **options))
        found = picked and prune_box(left, picked, label, n, hits)
        if found is None or found.density <= rest["mean"]:
            break
        out.append(found)
        left = left.filter(~inside(found.box))
    rows.unpersist()
    return out


def box_conditions(spark: SparkSession, boxes: Sequence[Found], specs: DataFrame) -> DataFrame:
    """One row per box and restricted column, in order: its bounds, and what ``specs (name, evidence, gaps)`` says of the parameter."""
    rows = [(k + 1, p + 1, name, low, high) for k, x in enumerate(boxes) for p, (name, (low, high)) in enumerate(x.box.items())]
    bounds = spark.createDataFrame(rows, "box_no int, place int, name string, low double, high double")
    return bounds.join(specs.select("name", "evidence", "gaps"), "name", "left").withColumn("exploratory", F.coalesce(F.col("evidence") == "exploratory", F.lit(False)))


def box_gaps(conditions: DataFrame) -> DataFrame:
    """Per box its distinct gaps in the order of the conditions, and whether any condition is exploratory."""
    listed = F.array_sort(F.collect_list(F.struct("place", F.coalesce("gaps", F.array().cast("array<string>")).alias("gaps"))))
    return conditions.groupBy("box_no").agg(F.count("*").alias("n_conditions"), F.array_join(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["gaps"]))), ",").alias("gap_list"), F.bool_or("exploratory").alias("exploratory"))


def as_rows(spark: SparkSession, trajectory: list[dict]) -> DataFrame:
    """A trajectory as a table."""
    names = ("step", "name", "side", "limit_value", "kept", "density", "coverage")
    return spark.createDataFrame([tuple(x[c] for c in names) for x in trajectory], "step int, name string, side string, limit_value double, kept long, density double, coverage double")


def boxes_as_rows(spark: SparkSession, boxes: Sequence[Found]) -> DataFrame:
    """Boxes as a table: a row per box and restricted column."""
    rows = [(k + 1, p + 1, name, low, high, x.kept, x.support, x.coverage, x.density) for k, x in enumerate(boxes) for p, (name, (low, high)) in enumerate(x.box.items())]
    return spark.createDataFrame(rows, "box_no int, place int, name string, low double, high double, kept long, support double, coverage double, density double")
