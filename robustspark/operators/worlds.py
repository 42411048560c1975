"""Many worlds: sampling, terms per world, and the score of every set in every world.

The worlds-by-sets table is never stored in long form: a batch of worlds is scored against the space of sets (which is
small and sent to the tasks) and only what is asked for leaves the batch. Scores are whole micro-units.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustspark.operators.cells import class_score, micro, shifted

#: Scores held at once by a batch: 8 MB.
TABLE_CELLS = 1_000_000


#: Rounds of a keyed permutation, and the prime below which its coefficients are drawn.
ROUNDS, PRIME = 32, 2**31 - 1


def round_keys(key: int) -> list[tuple[int, int, int, int]]:
    """Of each round: the sum (taken modulo n) of the values that it pairs, and the coefficients of the bit that says whether it swaps them."""
    rng = np.random.default_rng(key)
    return [(int(rng.integers(0, 2**62)), *(int(x) for x in rng.integers(1, PRIME, 3))) for _ in range(ROUNDS)]


def permuted(x: Column, n: int, key: int) -> Column:
    """A keyed bijection of 0..n-1 for any ``n``, without a sort or shuffle.

    Every round pairs each value with its mirror image and swaps the two or not, as a bit of the larger one says; both
    partners see the same bit, so a round is a bijection whatever the bits are.
    """
    rounds = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for v, c in zip(r, "kabc", strict=True))) for r in round_keys(key)))

    def swap(v: Column, r: Column) -> Column:
        mirror = F.pmod(r["k"] % n - v, F.lit(n))
        top = F.greatest(v, mirror)
        bit = F.shiftright(F.pmod(F.pmod(top, F.lit(PRIME)) * r["a"] + F.floor(top / PRIME) * r["b"] + r["c"], F.lit(PRIME)), 15).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(v)

    return F.aggregate(rounds, x.cast("long"), swap)


def latin_hypercube(spark: SparkSession, n: int, dims: int, seed: int) -> DataFrame:
    """``n`` points with one in each stratum of every dimension: world_id, strata s0.. and coordinates u0..; narrow."""
    points = spark.range(n).withColumnRenamed("id", "world_id")
    points = points.select("world_id", *(permuted(F.col("world_id"), n, seed * 100 + d).alias(f"s{d}") for d in range(dims)))
    offset = lambda d: F.pmod(F.xxhash64("world_id", F.lit(seed * 1000 + d)), F.lit(1_000_000)) / 1e6
    return points.select("*", *(((F.col(f"s{d}") + offset(d)) / n).alias(f"u{d}") for d in range(dims)))


def dirichlet(uniforms: list[Column]) -> Column:
    """Weights that average 1: exponentials over their sum."""
    draws = F.array(*(-F.log1p(-u) for u in uniforms))
    total = F.aggregate(draws, F.lit(0.0), lambda s, x: s + x)
    return F.transform(draws, lambda x: x * len(uniforms) / total)


def emphasised(uniforms: list[Column], emphasis: Column, first: int, second: int) -> Column:
    """Weights that average 1; with emphasis the two named places take the two largest, and the others keep their order.

    Of the named places the one with the larger draw (the first if equal) takes the largest weight.
    """
    weights = dirichlet(uniforms)

    def placed(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
        top, next_ = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        rest = F.filter(w, lambda x, i: (i != top["i"]) & (i != next_["i"]))
        lead = F.get(w, F.lit(first)) >= F.get(w, F.lit(second))
        own = [F.when(lead, -top["x"]).otherwise(-next_["x"]), F.when(lead, -next_["x"]).otherwise(-top["x"])]
        others = iter(range(len(uniforms)))
        return F.array(*(own[0] if d == first else own[1] if d == second else F.get(rest, F.lit(next(others))) for d in range(len(uniforms))))

    return F.get(F.transform(F.array(weights), lambda w: F.when(emphasis, placed(w)).otherwise(w)), F.lit(0))


def world_terms(worlds: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per world with the arrays, by measure_no, of vulnerability and of recurrence plus co-benefit.

    ``terms`` is the small catalogue with class_no, rec_share, cob_class and mismatch; an unknown class is worth nothing.
    With ``by``, it has a row for each measure and value of these columns, and the arrays are in that order.
    """
    catalogue = terms.agg(F.array_sort(F.collect_list(F.struct("measure_no", *by, "dimension_id", "class_no", "rec_share", "cob_class", "mismatch"))).alias("all"))
    w = F.col

    def vuln(m: Column) -> Column:
        flag = (w("scenario") == 1) & ((m["measure_no"] + w("world_id")) % 3 == 0)
        weight = 0.5 + 0.1 * ((w("world_id") * 5 + F.length(m["dimension_id"])) % 11)
        effect = 0.7 + 0.03 * ((w("world_id") * 7 + m["measure_no"] * 3) % 11)
        score = class_score(shifted(m["class_no"], flag), w("gamma"))
        return F.coalesce(micro(w("w_vuln") * weight * score * effect * F.when(m["mismatch"], w("mismatch_w")).otherwise(1.0)), F.lit(0))

    flat = lambda m: F.coalesce(micro(w("w_rec") * m["rec_share"]), F.lit(0)) + F.coalesce(micro(w("cob_w") * (m["cob_class"] / 5.0)), F.lit(0))
    return worlds.crossJoin(F.broadcast(catalogue)).select("world_id", "scenario", "penalty", F.transform("all", vuln).alias("vuln"), F.transform("all", flat).alias("flat"))


class Terms:
    """Worlds with the catalogue of ``world_terms``, whose arrays are worked out by the tasks that use them, a batch at a time.

    The same figures as ``world_terms`` gives, in the same order of operations; neither expressions are interpreted for each
    world and measure, nor are the arrays sent from Spark to Python.
    """

    COLUMNS = ("world_id", "scenario", "penalty", "w_vuln", "w_rec", "gamma", "cob_w", "mismatch_w")

    def __init__(self, worlds: DataFrame, terms: DataFrame, by: tuple[str, ...] = ()) -> None:
        rows = terms.select("measure_no", *by, "dimension_id", "class_no", "rec_share", "cob_class", "mismatch").collect()  # a row for each measure and value of ``by``
        rows.sort(key=lambda r: tuple(r[: 1 + len(by)]))
        number = lambda c: np.array([np.nan if r[c] is None else float(r[c]) for r in rows])
        self.worlds = worlds.select(*self.COLUMNS)
        self.measure = np.array([r["measure_no"] for r in rows], np.int64)
        self.length = np.array([len(r["dimension_id"]) for r in rows], np.int64)
        self.class_no, self.rec_share, self.cob_class = number("class_no"), number("rec_share"), number("cob_class")
        self.mismatch = np.array([bool(r["mismatch"]) for r in rows])

    def split(self) -> tuple[DataFrame, Terms]:
        """The worlds, and what the tasks take along."""
        catalogue = copy.copy(self)
        catalogue.worlds = None
        return self.worlds, catalogue

    def arrays(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Worlds by terms: vulnerability, and recurrence plus co-benefit, in micro-units; unknown shares are worth nothing."""
        world, scenario, _, w_vuln, w_rec, gamma, cob_w, mismatch_w = (part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in self.COLUMNS)
        micros = lambda x: np.nan_to_num(np.floor(x * 1e6 + 0.5)).astype(np.int64)
        flag = (scenario == 1) & ((self.measure + world) % 3 == 0)
        score = np.fmin(5.0, self.class_no + flag) / 5.0  # as least() in the SQL, an unknown class counts as the highest
        score = np.where(gamma == 2, score * score, score)
        weight = 0.5 + 0.1 * ((world * 5 + self.length) % 11)
        effect = 0.7 + 0.03 * ((world * 7 + self.measure * 3) % 11)
        vuln = micros(w_vuln * weight * score * effect * np.where(self.mismatch, mismatch_w, 1.0))
        return vuln, micros(w_rec * self.rec_share) + micros(cob_w * (self.cob_class / 5.0))


def term_arrays(part: pa.RecordBatch, terms: Terms | None) -> tuple[np.ndarray, np.ndarray]:
    """A row for each world of a batch: of its own arrays, or worked out."""
    if terms is not None:
        return terms.arrays(part)
    return tuple(part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("vuln", "flat"))


def with_shifts(worlds: DataFrame, units: DataFrame) -> DataFrame:
    """The worlds with the units whose cells rise one class there, as an array; the units are few and go along as one row."""
    every = units.agg(F.array_sort(F.collect_list("unit_id")).alias("units"))
    up = lambda unit: (F.col("scenario") == 1) & ((F.col("u_dim") < 0.3 * F.col("u_eff") + 0.01 * unit) | (unit == 0))
    return worlds.crossJoin(F.broadcast(every)).withColumn("shifted", F.filter("units", up)).drop("units")


class Space:
    """The sets as arrays: which measures are in, and the place of each set in the order of ties."""

    def __init__(self, sets: list[tuple[int, int, str]], dimensions: list[str], ids: list[str]) -> None:
        self.set_id = np.array([s for s, _, _ in sets], np.int64)
        k = len(ids)
        self.members = (self.set_id[:, None] >> np.arange(k)) & 1
        order = sorted(range(len(sets)), key=lambda i: (sets[i][1], sets[i][2]))
        self.tie_rank = np.empty(len(sets), np.int64)
        self.tie_rank[order] = np.arange(len(sets))
        by_id = np.argsort(np.array(ids), kind="stable")
        self.groups = [[int(j) for j in by_id if dimensions[j] == d] for d in sorted(set(dimensions))]
        self.patterns = [sum(self.members[:, j] << i for i, j in enumerate(g)) for g in self.groups]

    def scores(self, vuln: np.ndarray, flat: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """Worlds by sets: the first of a dimension by total, then id, keeps its full term."""
        kept = np.floor(vuln * penalty[:, None] + 0.5).astype(np.int64)
        table = (flat + kept).astype(float) @ self.members.T.astype(float)  # whole numbers below 2^53, so exact
        table = table.astype(np.int64)
        total, gain, row = vuln + flat, vuln - kept, np.arange(len(vuln))
        for group, pattern in zip(self.groups, self.patterns, strict=True):
            bonus = np.zeros((len(vuln), 1 << len(group)), np.int64)
            for p in range(1, 1 << len(group)):
                own = [j for i, j in enumerate(group) if p >> i & 1]
                first = np.array(own)[np.argmax(total[:, own], axis=1)]
                bonus[:, p] = gain[row, first]
            table += bonus[:, pattern]
        return table

    def best(self, table: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Per world the winning set (of the sets ``among``): highest score, then cost, then ids."""
        if among is None:
            return (table * len(self.set_id) - self.tie_rank).argmax(1)
        own = np.flatnonzero(among)
        return own[(table[:, own] * len(self.set_id) - self.tie_rank[own]).argmax(1)]

    def contribution(self, vuln: np.ndarray, flat: np.ndarray, penalty: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
        """What member k adds to the set chosen in each world."""
        group = next(g for g in self.groups if k in g)
        there = self.members[chosen][:, group] == 1
        total = np.where(there, (vuln + flat)[:, group], np.iinfo(np.int64).min)
        first = np.array(group)[total.argmax(1)] == k
        return np.where(first, vuln[:, k], np.floor(vuln[:, k] * penalty + 0.5).astype(np.int64)) + flat[:, k]


def scored_parts(batches: Iterator[pa.RecordBatch], space: Space, own: Terms | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded parts of a task's worlds, with their arrays, and the score table of each."""
    step = max(1, TABLE_CELLS // max(1, len(space.set_id)))
    for whole in batches:
        for lo in range(0, whole.num_rows, step):
            part = whole.slice(lo, step)
            vuln, flat = term_arrays(part, own)
            if own:
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]) for x in (vuln, flat)]
                part = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("world_id", "scenario", "penalty")), *lists], ["world_id", "scenario", "penalty", "vuln", "flat"])
            yield part, space.scores(vuln, flat, part.column("penalty").to_numpy())


def fold_worlds(terms: DataFrame | Terms, space: Space, state: Callable[[Space], np.ndarray], add: Callable[[Space, pa.RecordBatch, np.ndarray, np.ndarray], None], emit: Callable[[Space, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Folds the score tables of all worlds of a task into one state: ``add`` takes a part's table in, ``emit`` gives the task's rows."""
    rows, own = terms.split() if isinstance(terms, Terms) else (terms, None)
    shipped = rows.sparkSession.sparkContext.broadcast((space, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, own = shipped.value
        held = None
        for part, table in scored_parts(batches, space, own):
            held = state(space) if held is None else held
            add(space, part, table, held)
        if held is not None:
            yield from emit(space, held)

    return rows.mapInArrow(run, schema)


def score_worlds(terms: DataFrame | Terms, space: Space, reduce: Callable[[Space, pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``reduce`` to the score table of each bounded batch of worlds; ``reduce`` finds the arrays in its batch."""
    rows, own = terms.split() if isinstance(terms, Terms) else (terms, None)
    shipped = rows.sparkSession.sparkContext.broadcast((space, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, own = shipped.value
        for part, table in scored_parts(batches, space, own):
            out = reduce(space, part, table)
            if out is not None:
                yield out

    return rows.mapInArrow(run, schema)
