"""What information is worth: switching distances, corrected value of a parameter, gaps, entry signals and sites."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from robustspark.operators import boxes, ranks
from robustspark.operators.portfolios import member
from robustspark.operators.worlds import Space, fold_worlds, score_worlds

#: Worlds whose labels are held at once, a row for each bin.
LABELLED = 2048
#: Labelings of worlds: the first is their own, the others are affine bijections of their numbers.
SHUFFLES = ((1, 0), (7351, 13), (6529, 26), (5869, 39), (4877, 52), (3911, 65))


def stratum_bin(world_id: Column, n: int, bins: int, a: int, b: int) -> Column:
    """The equal-count bin of a world in a Latin hypercube column; its stratum is its rank, so nothing is sorted."""
    return F.floor(((F.lit(a) * world_id + b) % n) * bins / n).cast("long")


def world0_switching(measures: DataFrame, best: DataFrame, containing: DataFrame, without: DataFrame, parts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per measure: whether the best set has it, how far the best set without (or with) it falls behind, and that relative to its contribution.

    ``best`` is one row, ``containing`` and ``without`` one per measure; ``parts_of`` gives the contributions in some sets.
    """
    one = best.select(F.col("set_id").alias("best_set"), F.col("score").alias("best_score"))
    rows = measures.select("measure_id", "measure_no").crossJoin(F.broadcast(one)).withColumn("inside", member(F.col("best_set"), F.col("measure_no")))
    side = lambda df, name: df.select("measure_id", F.col("set_id").alias(f"{name}_set"), F.col("score").alias(f"{name}_score"))
    rows = rows.join(side(containing, "with"), "measure_id", "left").join(side(without, "without"), "measure_id", "left")
    rows = rows.select("measure_id", "inside", (F.col("best_score") - F.when(F.col("inside"), F.col("without_score")).otherwise(F.col("with_score"))).alias("delta"), F.when(F.col("inside"), F.col("best_set")).otherwise(F.col("with_set")).alias("set_id"))
    own = parts_of(rows.select("set_id").distinct()).select("set_id", "measure_id", F.col("part").alias("own"))
    out = rows.join(own, ["set_id", "measure_id"], "left")
    return out.select("measure_id", "inside", "delta", "own", F.when(F.col("own") > 0, F.col("delta") / F.col("own")).alias("distance"))


#: What switching tells of a world and measure, by the worlds that count.
READINGS = ("distance", "out_distance", "in_distance", "delta", "star_delta", "star_distance")


def switching_rows(terms: DataFrame, space: Space, star: int) -> DataFrame:
    """(measure_no, reading, value): how far each measure is from entering or leaving the best set of each world.

    ``delta`` is what the best set without (or with) the measure falls behind, ``distance`` that as a ratio of the measure's
    own contribution (null unless positive), ``out_`` and ``in_`` its worlds outside and inside; ``star_`` the same against
    the set ``star``. Reading ``inside`` is 1 or 0, ``star_beaten`` whether another set is best.
    """
    names = (*READINGS, "inside", "star_beaten")

    def reduce(space: Space, part: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
        vuln, flat = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("vuln", "flat"))
        penalty, row = part.column("penalty").to_numpy(), np.arange(part.num_rows)
        best, at = space.best(table), int(np.flatnonzero(space.set_id == star)[0])
        top, own_star = table[row, best], table[:, at]
        out: list[tuple[int, int, np.ndarray]] = []
        for k in range(space.members.shape[1]):
            has, none = space.members[:, k] == 1, np.full(part.num_rows, np.nan)
            with_k = space.best(table, has) if has.any() else None
            without = space.best(table, ~has) if not has.all() else None
            score = lambda x: none if x is None else table[row, x].astype(float)
            adds = lambda x: none if x is None else space.contribution(vuln, flat, penalty, x, k).astype(float)
            inside, in_star = has[best], bool(has[at])
            delta = top - np.where(inside, score(without), score(with_k))
            own = np.where(inside, adds(best), adds(with_k))
            star_delta = own_star - score(without if in_star else with_k)
            star_own = adds(np.full(part.num_rows, at) if in_star else with_k)
            ratio = lambda d, c: np.divide(d, c, out=np.full(len(d), np.nan), where=c > 0)
            distance = ratio(delta, own)
            values = (distance, np.where(inside, np.nan, distance), np.where(inside, distance, np.nan), delta, star_delta, ratio(star_delta, star_own), inside.astype(float), (best != at).astype(float))
            out += [(k, i, v) for i, v in enumerate(values)]
        column = np.concatenate([v for _, _, v in out])
        reading = pa.DictionaryArray.from_arrays(pa.array(np.repeat([i for _, i, _ in out], part.num_rows), pa.int32()), pa.array(names)).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([k for k, _, _ in out], part.num_rows)), reading, pa.array(column, mask=np.isnan(column))], ["measure_no", "reading", "value"])

    return score_worlds(terms, space, reduce, "measure_no long, reading string, value double")


def switching_values(rows: DataFrame, measures: DataFrame, star: int) -> DataFrame:
    """A row per measure from ``switching_rows``: shares and exact quantiles, without sorting or gathering a column."""
    rows = rows.withColumn("k", F.concat_ws(":", "measure_no", "reading")).persist()
    means = {r["k"]: r["m"] for r in rows.filter("reading in ('inside', 'star_beaten')").groupBy("k").agg(F.avg("value").alias("m")).collect()}
    found = ranks.quantiles(rows.filter(F.col("reading").isin(*READINGS)), "k", "value", (0.05, 0.5, 0.95))
    rows.unpersist()
    names = [f"{r}_{n}" for r in READINGS for n in ("p5", "median", "p95")]
    out = []
    for m in measures.select("measure_id", "measure_no").collect():  # the catalogue
        k = m["measure_no"]
        quantile = [found.get((f"{k}:{r}", q)) for r in READINGS for q in (0.05, 0.5, 0.95)]
        out.append((m["measure_id"], bool(star >> k & 1), means.get(f"{k}:inside"), means.get(f"{k}:star_beaten"), *quantile))
    return rows.sparkSession.createDataFrame(out, "measure_id string, in_star boolean, share_in_best double, star_beaten_share double, " + ", ".join(f"{n} double" for n in names))


def median_distances(terms: DataFrame, space: Space, measures: DataFrame) -> DataFrame:
    """(measure_id, distance): the medians of the reading ``distance`` of ``switching_rows``, without its other readings.

    A world is one row with a column for each measure, stored as packed blocks, which each pass over all measures reads.
    """
    k = space.members.shape[1]

    def reduce(space: Space, part: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
        vuln, flat = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in ("vuln", "flat"))
        penalty, row = part.column("penalty").to_numpy(), np.arange(part.num_rows)
        best = space.best(table)
        out = []
        for j in range(k):
            has = space.members[:, j] == 1
            inside = has[best]
            with_j, without = (None if not x.any() else space.best(table, x) for x in (has, ~has))
            score = lambda x: np.full(part.num_rows, np.nan) if x is None else table[row, x].astype(float)
            adds = lambda x: np.full(part.num_rows, np.nan) if x is None else space.contribution(vuln, flat, penalty, x, j).astype(float)
            delta = table[row, best] - np.where(inside, score(without), score(with_j))
            own = np.where(inside, adds(best), adds(with_j))
            out.append(np.divide(delta, own, out=np.full(len(delta), np.nan), where=own > 0))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    names = [f"d{j}" for j in range(k)]
    found = boxes.medians(score_worlds(terms, space, reduce, ", ".join(f"{c} double" for c in names)), names)
    rows = [(m["measure_id"], found.get(f"d{m['measure_no']}")) for m in measures.select("measure_id", "measure_no").collect()]  # the catalogue
    return measures.sparkSession.createDataFrame(rows, "measure_id string, distance double")


def evppi_corrected(terms: DataFrame, space: Space, n: int, bins: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Per parameter (a, b and number of bins of its stratum) the value of knowing it, less the mean over shuffled worlds.

    A task sends sums per labeling, bin and set; they are whole micro-units, so their order does not matter.
    """
    labelings = [(shuffle_no, x, y, name, a, b, k) for shuffle_no, (x, y) in enumerate(SHUFFLES) for name, (a, b, k) in bins.items()]
    starts = np.cumsum([0, *(k for *_, k in labelings)])

    def add(space: Space, part: pa.RecordBatch, table: np.ndarray, sums: np.ndarray) -> None:
        """A product with the worlds of each bin; the sums of a part are whole numbers below 2^53, so exact."""
        world = part.column("world_id").to_numpy()
        for lo in range(0, len(world), LABELLED):
            own = world[lo : lo + LABELLED]
            there = np.zeros((starts[-1], len(own)))
            for start, (_, x, y, _, a, b, k) in zip(starts, labelings, strict=False):
                there[start + ((a * ((x * own + y) % n) + b) % n) * k // n, np.arange(len(own))] = 1.0
            sums += (there @ table[lo : lo + LABELLED].astype(float)).astype(np.int64)

    def emit(space: Space, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start, (shuffle_no, _, _, name, _, _, k) in zip(starts, labelings, strict=False):
            own = sums[start : start + k]
            yield pa.RecordBatch.from_arrays([pa.array([name] * own.size), pa.array(np.full(own.size, shuffle_no)), pa.array(np.repeat(np.arange(k), own.shape[1])), pa.array(np.tile(space.set_id, k)), pa.array(own.ravel())], ["parameter", "shuffle_no", "bin", "set_id", "s"])

    start = lambda space: np.zeros((starts[-1], len(space.set_id)), np.int64)
    sums = fold_worlds(terms, space, start, add, emit, "parameter string, shuffle_no long, bin long, set_id long, s long").groupBy("parameter", "shuffle_no", "bin", "set_id").agg(F.sum("s").alias("s"))
    # one labeling of one parameter holds every world once, so its sums per set are the overall sums
    whole = sums.groupBy("parameter", "shuffle_no", "set_id").agg(F.sum("s").alias("s")).groupBy("parameter", "shuffle_no").agg(F.max("s").alias("u"))
    informed = sums.groupBy("parameter", "shuffle_no", "bin").agg(F.max("s").alias("m")).groupBy("parameter", "shuffle_no").agg(F.sum("m").alias("i")).join(whole, ["parameter", "shuffle_no"])
    own, others = F.max(F.when(F.col("shuffle_no") == 0, F.col("i"))), F.sum(F.when(F.col("shuffle_no") > 0, F.col("i")))
    gain, k = (len(SHUFFLES) - 1) * own - others, len(SHUFFLES) - 1
    return informed.groupBy("parameter").agg(((own - F.max("u")) / n).alias("raw"), (gain / (k * n)).alias("corrected"), (gain / (k * F.max("u"))).alias("corrected_pct"))


def gap_links(gaps: DataFrame, gap_measures: DataFrame, spec_gaps: DataFrame) -> DataFrame:
    """(parameter, gap_id): what the specs name; model gaps that no spec names act through the effect of their measures."""
    named = spec_gaps.select("parameter", "gap_id").distinct()
    loose = gaps.filter("kind = 'model'").select("gap_id").join(named.select("gap_id").distinct(), "gap_id", "left_anti")
    return named.unionByName(gap_measures.join(loose, "gap_id").select(F.concat(F.lit("eff["), "measure_id", F.lit("]")).alias("parameter"), "gap_id").distinct())


def gap_ranking(gaps: DataFrame, gap_measures: DataFrame, distances: DataFrame, links: DataFrame, values: DataFrame) -> DataFrame:
    """Gaps in order within their kind: model gaps by the most valuable linked parameter, others by their closest measure; unknown ones last."""
    near = gap_measures.join(distances.filter("distance is not null"), "measure_id").groupBy("gap_id").agg(F.min_by("measure_id", F.struct("distance", "measure_id")).alias("closest_measure"), F.min("distance").alias("closest_distance"))
    worth = links.join(gaps.filter("kind = 'model'").select("gap_id"), "gap_id").join(values, "parameter")
    worth = worth.groupBy("gap_id").agg(F.min_by("parameter", F.struct(-F.col("corrected"), "parameter")).alias("top_parameter"), F.max("corrected_pct").alias("top_pct"))
    rows = gaps.select("gap_id", "kind").join(near, "gap_id", "left").join(worth, "gap_id", "left")
    key = F.when(F.col("kind") == "model", -F.coalesce("top_pct", F.lit(0.0))).otherwise(F.coalesce("closest_distance", F.lit(1e300)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(key, "gap_id")))


def entry_signals(rows: DataFrame, labels: dict[str, str], columns: Sequence[str], observable: Sequence[str], binary: Sequence[str] = ()) -> DataFrame:
    """The boxes that drive labels: (name, role, place, parameter, low, high, kept, support, coverage, density).

    ``labels`` maps a name to its 0/1 column of ``rows``. Role ``driver`` is the first box over all columns, ``signal`` the
    one over those that information could settle; all are peeled over the same passes. A label has no box where it is too
    rare, or where none is denser than all rows.
    """
    spark = rows.sparkSession
    kept = rows.select(*dict.fromkeys([*columns, *labels.values()])).persist()
    owners = [(name, role, boxes.Peeling(label, own, [c for c in binary if c in own])) for name, label in labels.items() for role, own in (("driver", list(columns)), ("signal", list(observable))) if own]
    out = []
    totals = kept.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in dict.fromkeys(labels.values()))).first() if owners else None
    trails = boxes.prim_all(kept, [o for *_, o in owners]) if owners else []
    picked = [(name, role, box, owner.label, float(totals[owner.label])) for (name, role, owner), trail in zip(owners, trails, strict=True) if (totals[owner.label] or 0) >= 1 and (box := boxes.pick_box(trail))]
    n = totals["n"] if totals else 0
    for (name, role, *_, hits), found in zip(picked, boxes.prune_all(kept, [x[2:] for x in picked], n), strict=True):
        if found.density > hits / n:
            out += [(name, role, k + 1, c, low, high, found.kept, found.support, found.coverage, found.density) for k, (c, (low, high)) in enumerate(found.box.items())]
    kept.unpersist()
    return spark.createDataFrame(out, "name string, role string, place int, parameter string, low double, high double, kept long, support double, coverage double, density double")


def reserve_lists(decided: DataFrame) -> DataFrame:
    """(decision, n, measures): the measures to reserve for, to watch, and to spend on, of ``reserve_rule``; a catalogue's rows."""
    return decided.groupBy("decision").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("measure_id")), ",").alias("measures"))


def reserve_rule(signals: DataFrame, delay_cost: float) -> DataFrame:
    """``signals`` with a decision: a value of waiting above its cost is reserved for, or watched if it is exploratory."""
    above = F.coalesce(F.col("value_of_waiting") > delay_cost, F.lit(False))
    return signals.withColumn("decision", F.when(above & ~F.col("exploratory"), "reserve").when(above, "watch").otherwise("spend"))
