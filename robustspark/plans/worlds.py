"""Registered queries on worlds and the analyses over them, with their SQL twins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from robustspark.operators import boxes, information, sites
from robustspark.operators import cells as C
from robustspark.operators import portfolios as P
from robustspark.operators import worlds as W
from robustspark.plans import cells, portfolios

QUERIES, ORACLES = {}, {}
NEAR = (0.01, 0.02, 0.05)
#: Sets that are held as arrays, on the driver and by the tasks.
MOST_SETS = 1 << 20

CTES = portfolios.CTES | {
    "facts": "select m.measure_id, m.measure_no, m.dimension_id, top_class as class_no, rec_share, cob_class, mismatch from measures m join (select measure_id, max(class_no) as top_class from placed group by all) t using (measure_id) left join rec_terms using (measure_id) left join cob_terms using (measure_id) left join fits using (measure_id)",
    "wbase": "select w.*, f.*, least(5, class_no + case when scenario = 1 and (measure_no + world_id) % 3 = 0 then 1 else 0 end) / 5.0 as cs from worlds w cross join facts f",
    "wterms": """select world_id, scenario, penalty, measure_id, measure_no, dimension_id, cast(floor(w_vuln * (0.5::double + 0.1::double * ((world_id * 5 + length(dimension_id)) % 11)) * (case when gamma = 2 then cs * cs else cs end)
        * (0.7::double + 0.03::double * ((world_id * 7 + measure_no * 3) % 11)) * (case when mismatch then mismatch_w else 1.0 end) * 1e6 + 0.5) as bigint) as vuln,
        coalesce(cast(floor(w_rec * rec_share * 1e6 + 0.5) as bigint), 0) + coalesce(cast(floor(cob_w * (cob_class / 5.0) * 1e6 + 0.5) as bigint), 0) as flat from wbase""",
    "wparts": "select world_id, scenario, set_id, cost, ids, measure_id, case when row_number() over (partition by world_id, set_id, dimension_id order by vuln + flat desc, measure_id) = 1 then vuln else cast(floor(vuln * penalty + 0.5) as bigint) end + flat as part from sets s join wterms t on (s.set_id >> measure_no) & 1 = 1",
    "wscores": "select world_id, scenario, set_id, cast(sum(part) as bigint) as score, any_value(cost) as cost, any_value(ids) as ids from wparts group by world_id, scenario, set_id",
    "wbest": "select world_id, scenario, set_id as best_set, score as best_score from wscores qualify row_number() over (partition by world_id order by score desc, cost, ids) = 1",
    "star0": "select set_id as star from best",
    "wstar": "select b.*, s.score as star_score, (b.best_score - s.score) / b.best_score as regret from wbest b join (select world_id, score from wscores where set_id = (select star from star0)) s using (world_id)",
    "scen": "select * from (values ('all'), ('0'), ('1')) v(scenario_name)",
    "nears": "select scenario_name, set_id, count(*) as n, count(*) filter (where s.set_id = b.best_set) as wins, count(*) filter (where (b.best_score - s.score) / b.best_score <= 0.01::double + 1e-12) as n1, count(*) filter (where (b.best_score - s.score) / b.best_score <= 0.02::double + 1e-12) as n2, count(*) filter (where (b.best_score - s.score) / b.best_score <= 0.05::double + 1e-12) as n5 from wscores s join wbest b using (world_id) join scen on scenario_name = 'all' or scenario_name = cast(b.scenario as varchar) group by all",
}


def upto(*names: str) -> dict[str, str]:
    """The common expressions up to the last of some."""
    keys = list(CTES)
    return {k: CTES[k] for k in keys[: max(keys.index(n) for n in names) + 1]}


class Many(portfolios.Sets):
    """The model with its worlds."""

    @cells.once
    def facts(self):
        placed = self.placed()
        top = placed.groupBy("measure_id").agg(F.max("class_no").alias("class_no"))
        rows = self.measures.select("measure_id", "measure_no", "dimension_id").join(top, "measure_id").join(C.recurrence_term(placed, self.model, self.denominator()), "measure_id", "left")
        return cells.small(rows.join(C.cobenefit_term(placed, self.measures, self.cells()), "measure_id", "left").join(C.lever_fit(placed, self.measures, self.profiles()), "measure_id", "left"))

    @cells.once
    def world_terms(self):
        # a small file has fewer splits than there are cores
        cores = self.spark.sparkContext.defaultParallelism
        spread = self.worlds if self.events.rdd.getNumPartitions() >= cores else self.worlds.repartition(cores)
        return W.Terms(spread, self.facts())

    def space(self):
        """The sets as arrays on the driver; a catalogue with more than ``MOST_SETS`` of them is refused, not cut."""
        catalogue = self.measures.orderBy("measure_no").collect()
        sets = [(r["set_id"], r["cost"], r["ids"]) for r in self.sets().limit(MOST_SETS + 1).collect()]
        if len(sets) > MOST_SETS:
            raise ValueError(f"over {MOST_SETS} sets fit the budget; lower it or the number of measures")
        return W.Space(sorted(sets), [r["dimension_id"] for r in catalogue], [r["measure_id"] for r in catalogue])

    def best_per_world(self):
        def reduce(space, part, table):
            best = space.best(table)
            return pa.RecordBatch.from_arrays([part.column("world_id"), part.column("scenario"), pa.array(space.set_id[best]), pa.array(table[np.arange(len(best)), best])], ["world_id", "scenario", "best_set", "best_score"])

        return W.score_worlds(self.world_terms(), self.space(), reduce, "world_id long, scenario int, best_set long, best_score long")

    def star_regret(self):
        star = self.best().first()["set_id"]

        def reduce(space, part, table):
            top = table.max(1)
            best, own = space.best(table), table[:, np.flatnonzero(space.set_id == star)[0]]
            return pa.RecordBatch.from_arrays([part.column("world_id"), part.column("scenario"), pa.array(space.set_id[best]), pa.array(top), pa.array(own), pa.array((top - own) / top)], ["world_id", "scenario", "best_set", "best_score", "star_score", "regret"])

        return W.score_worlds(self.world_terms(), self.space(), reduce, "world_id long, scenario int, best_set long, best_score long, star_score long, regret double")

    def near_counts(self):
        """Per set and scenario: worlds, wins, and worlds within each threshold; batches send one row per set and scenario."""

        def reduce(space, part, table):
            best, top = space.best(table), table.max(1)
            regret = (top[:, None] - table) / top[:, None]
            scenario = part.column("scenario").to_numpy()
            rows = []
            for name, mask in (("all", np.ones(len(best), bool)), ("0", scenario == 0), ("1", scenario == 1)):
                wins = np.bincount(best[mask], minlength=len(space.set_id))
                near = [(regret[mask] <= t + 1e-12).sum(0) for t in NEAR]
                rows.append((np.full(len(space.set_id), name), space.set_id, np.full(len(space.set_id), mask.sum()), wins, *near))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], ["scenario_name", "set_id", "n", "wins", "n1", "n2", "n5"])

        parts = W.score_worlds(self.world_terms(), self.space(), reduce, "scenario_name string, set_id long, n long, wins long, n1 long, n2 long, n5 long")
        return parts.groupBy("scenario_name", "set_id").agg(*(F.sum(c).alias(c) for c in ("n", "wins", "n1", "n2", "n5")))


def query(sql=None, ctes=None):
    def wrap(f):
        def run(model):
            return f(Many(model.spark, model.sf_dir))

        run.__name__ = f.__name__
        return cells.query(sql, ctes, into=(QUERIES, ORACLES))(run)

    return wrap


@query("select d.dim, count(*) as n_points, count(*) as n_strata from events cross join (values (0), (1), (2)) d(dim) group by all")
def w1_latin_hypercube(t):
    n = t.events.count()
    points = W.latin_hypercube(t.spark, n, 3, 7)
    rows = points.select(F.posexplode(F.array(*(F.floor(F.col(f"u{d}") * n).cast("long") for d in range(3)))).alias("dim", "stratum"))
    return rows.groupBy("dim").agg(F.count("*").alias("n_points"), F.countDistinct("stratum").alias("n_strata"))


def _round_ctes(seed: int, dims: int) -> dict[str, str]:
    """The keyed permutations of the worlds' numbers in SQL, round by round."""
    out = {}
    for d in range(dims):
        out[f"p{d}_0"] = "select event_id as x, event_id as v, n from events cross join (select count(*) as n from events)"
        for k, (m, a, b, c) in enumerate(W.round_keys(seed * 100 + d), 1):
            bit = f"(((t % {W.PRIME}) * {a} + (t // {W.PRIME}) * {b} + {c}) % {W.PRIME} >> 15) & 1"
            out[f"p{d}_{k}"] = f"select x, case when {bit} = 1 then m else v end as v, n from (select x, v, n, m, greatest(v, m) as t from (select x, v, n, ({m} % n - v + n) % n as m from p{d}_{k - 1}))"
    return out


@query(f"select world_id, s0, s1, s2, 0.5 + 0.4 * ((s0 + 0.5) / n) as w_vuln, 0.05 + 0.25 * ((s1 + 0.5) / n) as w_rec, case when (s2 + 0.5) / n < 0.5 then 1 else 2 end as gamma from (select x as world_id, v as s0, n from p0_{W.ROUNDS}) join (select x as world_id, v as s1 from p1_{W.ROUNDS}) using (world_id) join (select x as world_id, v as s2 from p2_{W.ROUNDS}) using (world_id)", _round_ctes(11, 3))
def w1_sampled_design(t):
    """As many worlds as events, each with its own stratum of every parameter."""
    n = t.events.count()
    points = W.latin_hypercube(t.spark, n, 3, 11)
    mid = lambda d: (F.col(f"s{d}") + 0.5) / n
    return points.select("world_id", "s0", "s1", "s2", (0.5 + 0.4 * mid(0)).alias("w_vuln"), (0.05 + 0.25 * mid(1)).alias("w_rec"), F.when(mid(2) < 0.5, 1).otherwise(2).alias("gamma"))


@query("select world_id, w_vuln, w_rec, gamma, penalty, cob_w, mismatch_w from worlds")
def w2_scale_params(t):
    n = t.events.count()
    u = lambda a, b: (((F.lit(a) * F.col("world_id") + b) % n) + 0.5) / n
    w = t.events.select(F.col("event_id").alias("world_id"))
    return w.select("world_id", (0.1 + 0.8 * u(7919, 3)).alias("w_vuln"), (0.6 * u(6607, 11)).alias("w_rec"), F.when(u(5417, 29) < 0.5, 1).otherwise(2).alias("gamma"), u(4409, 5).alias("penalty"), (0.5 * u(3301, 17)).alias("cob_w"), (0.5 + 0.5 * u(2207, 23)).alias("mismatch_w"))


@query("select world_id, 3 * -ln(1 - u_eff) / (-ln(1 - u_eff) - ln(1 - u_dim) - ln(1 - w_vuln)) as d0, 3 * -ln(1 - u_dim) / (-ln(1 - u_eff) - ln(1 - u_dim) - ln(1 - w_vuln)) as d1, 3 * -ln(1 - w_vuln) / (-ln(1 - u_eff) - ln(1 - u_dim) - ln(1 - w_vuln)) as d2 from worlds")
def w3_dirichlet_weights(t):
    weights = W.dirichlet([F.col("u_eff"), F.col("u_dim"), F.col("w_vuln")])
    return t.worlds.select("world_id", weights.alias("d")).select("world_id", *(F.col("d")[k].alias(f"d{k}") for k in range(3)))


_FIVE = ("u_eff", "u_dim", "w_vuln", "penalty", "mismatch_w")
_EMPHASIS = {
    "draws": f"select world_id, scenario, [{', '.join(f'-ln(1 - {c})' for c in _FIVE)}] as e from worlds",
    "weights": "select world_id, scenario, list_transform(e, lambda x: 5 * x / list_sum(e)) as w from draws",
    "ordered": "select *, list_sort(list_transform(w, lambda x, i: {'x': -x, 'i': i})) as o from weights",
    "named": "select *, list_filter(w, lambda x, i: i <> o[1].i and i <> o[2].i) as rest, w[2] >= w[4] as lead from ordered",
}


@query("select world_id, unnest([0, 1, 2, 3, 4]) as place, unnest(case when scenario = 1 then [rest[1], case when lead then -o[1].x else -o[2].x end, rest[2], case when lead then -o[2].x else -o[1].x end, rest[3]] else w end) as weight from named", _EMPHASIS)
def w3_emphasis_weights(t):
    weights = W.emphasised([F.col(c) for c in _FIVE], F.col("scenario") == 1, 1, 3)
    return t.worlds.select("world_id", F.posexplode(weights).alias("place", "weight"))


_SHIFTS = "scenario = 1 and (u_dim < 0.3 * u_eff + 0.01 * unit_id or unit_id = 0)"


@query(f"select world_id, coalesce(string_agg(unit_id, ',' order by unit_id) filter (where {_SHIFTS}), '') as shifted from worlds cross join units group by world_id")
def w4_scenario_shifts(t):
    return W.with_shifts(t.worlds, t.units).select("world_id", F.array_join("shifted", ",").alias("shifted"))


@query("select cast(world_id as varchar) as name, w_vuln, penalty from worlds union all select * from (values ('institutional', 0.7::double, 0.5::double), ('multidimensional', 0.7::double, 0.15::double)) v(name, w_vuln, penalty)")
def w5_named_points(t):
    named = t.spark.createDataFrame([("institutional", 0.7, 0.5), ("multidimensional", 0.7, 0.15)], "name string, w_vuln double, penalty double")
    return t.worlds.select(F.col("world_id").cast("string").alias("name"), "w_vuln", "penalty").unionByName(named)


@query("select world_id, 0.6::double as w_vuln, penalty, case when world_id % 5 = 2 then 1.5::double else 1.0::double end as weight from worlds")
def w6_world_overrides(t):
    given = {"w_vuln": 0.6}
    unknown = set(given) - set(t.worlds.columns)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    over = F.create_map(F.lit(2), F.lit(1.5))
    return t.worlds.withColumns({k: F.lit(v) for k, v in given.items()}).select("world_id", "w_vuln", "penalty", F.coalesce(over[(F.col("world_id") % 5).cast("int")], F.lit(1.0)).alias("weight"))


@query("select world_id, cast(sum(score) as bigint) as total, max(score) as highest, min(score) as lowest, count(*) as n_sets from wscores group by world_id", upto("wscores"))
def w7_score_table(t):
    def reduce(space, part, table):
        return pa.RecordBatch.from_arrays([part.column("world_id"), pa.array(table.sum(1)), pa.array(table.max(1)), pa.array(table.min(1)), pa.array(np.full(len(table), table.shape[1]))], ["world_id", "total", "highest", "lowest", "n_sets"])

    return W.score_worlds(t.world_terms(), t.space(), reduce, "world_id long, total long, highest long, lowest long, n_sets long")


@query("select * from wbest", upto("wbest"))
def w8_best_per_world(t):
    return t.best_per_world()


@query("select p.world_id, p.measure_id, p.part from wparts p join wbest b on p.world_id = b.world_id and p.set_id = b.best_set", upto("wbest"))
def w9_contributions(t):
    arrays = W.world_terms(t.worlds, t.facts()).join(t.best_per_world().select("world_id", "best_set"), "world_id")
    names = F.broadcast(t.measures.select("measure_no", "measure_id", "dimension_id"))
    rows = arrays.select("world_id", "best_set", "penalty", F.posexplode(F.arrays_zip("vuln", "flat")).alias("measure_no", "x")).join(names, "measure_no").filter(P.member(F.col("best_set"), F.col("measure_no")))
    place = F.row_number().over(Window.partitionBy("world_id", "dimension_id").orderBy((F.col("x.vuln") + F.col("x.flat")).desc(), "measure_id"))
    kept = F.when(F.col("place") == 1, F.col("x.vuln")).otherwise(F.floor(F.col("x.vuln") * F.col("penalty") + 0.5).cast("long"))
    return rows.withColumn("place", place).select("world_id", "measure_id", (kept + F.col("x.flat")).alias("part"))


@query("select * from wstar", upto("wstar"))
def w10_regret(t):
    return t.star_regret()


@query("select scenario_name, set_id, wins / n as rank1 from nears", upto("nears"))
def r1_rank1_share(t):
    return t.near_counts().select("scenario_name", "set_id", (F.col("wins") / F.col("n")).alias("rank1"))


@query("select scenario_name, set_id, n1 / n as near_1, n2 / n as near_2, n5 / n as near_5 from nears", upto("nears"))
def r2_near_share(t):
    return t.near_counts().select("scenario_name", "set_id", *((F.col(f"n{k}") / F.col("n")).alias(f"near_{k}") for k in (1, 2, 5)))


@query("select set_id, n5 / nears.n as near_5, wins / nears.n as rank1, s.score as world0 from nears join scored s using (set_id) where scenario_name = 'all' order by n5 desc, wins desc, s.score desc, s.cost, s.ids limit 20", upto("nears"))
def r3_robust_choice(t):
    rows = t.near_counts().filter("scenario_name = 'all'").join(t.scored().drop("n"), "set_id")
    top = rows.orderBy(F.desc("n5"), F.desc("wins"), F.desc("score"), "cost", "ids").limit(20)
    return top.select("set_id", (F.col("n5") / F.col("n")).alias("near_5"), (F.col("wins") / F.col("n")).alias("rank1"), F.col("score").alias("world0"))


_STABLE = {"ranked_sets": "select t as threshold, set_id, row_number() over (partition by t order by case t when 0.01 then n1 when 0.02 then n2 else n5 end desc, wins desc, s.score desc, s.cost, s.ids) as place from nears join scored s using (set_id) cross join (values (0.01), (0.02), (0.05)) v(t) where scenario_name = 'all'"}


@query("select threshold::double as threshold, set_id, s.ids, count(distinct set_id) over () = 1 as stable from (select *, (select count(distinct set_id) from ranked_sets where place = 1) as k from ranked_sets where place = 1) join scored s using (set_id)".replace("count(distinct set_id) over () = 1", "k = 1"), upto("nears") | _STABLE)
def r3_choice_by_threshold(t):
    """The robust set at each threshold of nearness, and whether all thresholds choose the same."""
    rows = t.near_counts().filter("scenario_name = 'all'").join(t.scored().drop("n"), "set_id")
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("threshold"), F.col(c).alias("near")) for x, c in zip(NEAR, ("n1", "n2", "n5"), strict=True)))).alias("e")
    order = F.struct((-F.col("e.near")).alias("a"), (-F.col("wins")).alias("b"), (-F.col("score")).alias("c"), "cost", "ids")
    chosen = cells.small(rows.select("*", each).groupBy(F.col("e.threshold").alias("threshold")).agg(F.min_by(F.struct("set_id", "ids"), order).alias("s")).select("threshold", "s.set_id", "s.ids"))
    return chosen.crossJoin(F.broadcast(chosen.agg((F.countDistinct("set_id") == 1).alias("stable"))))  # one row


@query("""select scenario_name, measure_id, avg(share) as incl_near, avg(inside::int) as incl_best from (select world_id, b.scenario, measure_id, any_value((best_set >> measure_no) & 1) as inside, count(*) filter (where (set_id >> measure_no) & 1 = 1) / count(*) as share
    from wscores s join wbest b using (world_id) cross join (select measure_id, measure_no from measures) where (best_score - s.score) / best_score <= 0.05::double + 1e-12 group by all) join scen on scenario_name = 'all' or scenario_name = cast(scenario as varchar) group by all""", upto("wbest", "scen"))
def r4_inclusion_near(t):
    """Per scenario and measure the mean share of near-best sets that have it, and the share of best sets."""

    def reduce(space, part, table):
        best, top = space.best(table), table.max(1)
        near = (top[:, None] - table) / top[:, None] <= NEAR[-1] + 1e-12
        share = (near.astype(float) @ space.members) / near.sum(1)[:, None]
        k = space.members.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("scenario").to_numpy(), k)), pa.array(np.tile(np.arange(k), len(best))), pa.array(share.ravel()), pa.array(space.members[best].ravel())], ["scenario", "measure_no", "near", "best"])

    rows = W.score_worlds(t.world_terms(), t.space(), reduce, "scenario int, measure_no long, near double, best long")
    means = rows.select("measure_no", "near", "best", F.explode(F.array(F.lit("all"), F.col("scenario").cast("string"))).alias("scenario_name")).groupBy("scenario_name", "measure_no").agg(F.avg("near").alias("incl_near"), F.avg("best").alias("incl_best"))
    return means.join(F.broadcast(t.measures.select("measure_no", "measure_id")), "measure_no").drop("measure_no")


@query("select scenario_name, measure_id, share, case when share >= 0.8 then 'core' when share >= 0.2 then 'contingent' else 'rarely' end as role from (select scenario_name, measure_id, cast(sum(case when (set_id >> measure_no) & 1 = 1 then wins else 0 end) as bigint) / cast(sum(wins) as bigint) as share from nears cross join measures group by all)", upto("nears"))
def r4_inclusion(t):
    rows = t.near_counts().crossJoin(F.broadcast(t.measures.select("measure_id", "measure_no")))
    share = F.sum(F.when(P.member(F.col("set_id"), F.col("measure_no")), F.col("wins")).otherwise(0)) / F.sum("wins")
    return rows.groupBy("scenario_name", "measure_id").agg(share.alias("share")).withColumn("role", F.when(F.col("share") >= 0.8, "core").when(F.col("share") >= 0.2, "contingent").otherwise("rarely"))


_LONG = "select world_id, name, value from worlds unpivot (value for name in (w_vuln, w_rec, penalty, cob_w, mismatch_w))"


@query(f"""select best_set, name, avg(value) as mean_here, any_value(mean_all) as mean_all, (avg(value) - any_value(mean_all)) / any_value(sd) as z from ({_LONG}) join wbest using (world_id) join (select name, avg(value) as mean_all, stddev_pop(value) as sd from ({_LONG}) group by all) using (name)
    where best_set in (select best_set from wbest group by all order by count(*) desc, best_set limit 5) group by best_set, name""", upto("wbest"))
def r5_central_parameters(t):
    long = t.worlds.unpivot("world_id", ["w_vuln", "w_rec", "penalty", "cob_w", "mismatch_w"], "name", "value")
    spread = long.groupBy("name").agg(F.avg("value").alias("mean_all"), F.stddev_pop("value").alias("sd"))
    best = t.best_per_world()
    top = best.groupBy("best_set").count().orderBy(F.desc("count"), "best_set").limit(5).select("best_set")
    rows = long.join(best.select("world_id", "best_set").join(F.broadcast(top), "best_set"), "world_id").groupBy("best_set", "name").agg(F.avg("value").alias("mean_here"))
    return rows.join(F.broadcast(spread), "name").select("best_set", "name", "mean_here", "mean_all", ((F.col("mean_here") - F.col("mean_all")) / F.col("sd")).alias("z"))


@query("select t as within, count(*) filter (where b.score - s.score <= t * b.score) as n_sets from scored s cross join best b cross join (values (0.01::double), (0.02::double), (0.05::double), (0.1::double)) v(t) group by all", upto("best"))
def r6_sets_within(t):
    rows = t.scored().crossJoin(t.best().select(F.col("score").alias("top")))
    rows = rows.select("score", "top", F.explode(F.array(*map(F.lit, (0.01, 0.02, 0.05, 0.1)))).alias("within"))
    return rows.groupBy("within").agg(F.count_if(F.col("top") - F.col("score") <= F.col("within") * F.col("top")).alias("n_sets"))


@query("select scenario, count(distinct best_set) as n_winners, count(*) as n_worlds from wbest group by all", upto("wbest"))
def r7_distinct_winners(t):
    return t.best_per_world().groupBy("scenario").agg(F.countDistinct("best_set").alias("n_winners"), F.count("*").alias("n_worlds"))


@query("select coalesce(cast(scenario as varchar), 'all') as scenario_name, avg(case when regret > 0.05::double + 1e-12 then 1.0 else 0.0 end) as fail_5, avg(case when regret > 0.1::double + 1e-12 then 1.0 else 0.0 end) as fail_10 from wstar group by rollup (scenario)", upto("wstar"))
def r8_failure_share(t):
    fails = [F.avg((F.col("regret") > x + 1e-12).cast("double")).alias(f"fail_{n}") for n, x in ((5, 0.05), (10, 0.1))]
    return t.star_regret().rollup("scenario").agg(*fails).select(F.coalesce(F.col("scenario").cast("string"), F.lit("all")).alias("scenario_name"), "fail_5", "fail_10")


_LABEL = {"li": "select l_quantity as q, l_discount as d, l_tax as x, l_extendedprice as p, case when l_linestatus = 'O' then 1 else 0 end as o, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem"}
COLUMNS = ("q", "d", "x", "p", "o")


def labelled(t):
    return t.lineitem.select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"), F.col("l_extendedprice").alias("p"), (F.col("l_linestatus") == "O").cast("int").alias("o"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _limits(c):
    """SQL for the order statistics at which a column is cut."""
    place = {"low": "floor((count(*) - 1) * 0.05::double + 1e-9)", "high": "ceil((count(*) - 1) * 0.95::double - 1e-9)"}
    return {side: f"(select list_sort(list({c}))[cast({x} as bigint) + 1] from li)" for side, x in place.items()}


@query(" union all ".join(f"select '{c}' as name, '{side}' as side, cast(lim as double) as limit_value, count(*) filter (where {c} {'>' if side == 'low' else '<'} lim) as kept, avg(y) filter (where {c} {'>' if side == 'low' else '<'} lim) as mean from li cross join (select {lim} as lim) group by lim" for c in ("q", "p") for side, lim in _limits(c).items())
    + " union all " + " union all ".join(f"select 'o' as name, 'drop' as side, {v}::double as limit_value, count(*) filter (where o <> {v}) as kept, avg(y) filter (where o <> {v}) as mean from li" for v in (0, 1)), _LABEL)
def b1_peel_candidates(t):
    rows = labelled(t)
    return boxes.peel_candidates(rows, ("q", "p", "o"), "y", 0.05, rows.count(), binary=("o",))


@query(None)
def b2_prim_peel(t):
    rows = labelled(t).persist()
    out = boxes.prim(rows, COLUMNS, "y", binary=("o",))
    rows.unpersist()
    return boxes.as_rows(t.spark, out)


@query(None)
def b3_pick_box(t):
    rows = labelled(t).persist()
    picked = boxes.pick_box(boxes.prim(rows, COLUMNS, "y", binary=("o",)))
    rows.unpersist()
    return boxes.boxes_as_rows(t.spark, [picked] if picked else [])


_PRUNE = {"mean": "select d.*, avg(y) filter (where (not a or q > 10) and (not b or p < 50000) and (not c or d < 0.08)) as density from li cross join (select * from (values (true, true, true), (true, true, false), (true, false, true), (true, false, false), (false, true, true), (false, true, false), (false, false, true)) v(a, b, c)) d group by all",
          "s1": "select density as full_density, (select density from mean where a and b and not c) >= density - 0.01::double as drop_c from mean where a and b and c",
          "s2": "select *, (select density from mean where a and not b and c = not drop_c) >= full_density - 0.01::double as drop_b from s1",
          "s3": "select *, not (drop_c and drop_b) and (select density from mean where not a and b = not drop_b and c = not drop_c) >= full_density - 0.01::double as drop_a from s2"}


@query("select concat_ws(',', case when not drop_a then 'q' end, case when not drop_b then 'p' end, case when not drop_c then 'd' end) as kept_columns, density from s3 join mean on a = not drop_a and b = not drop_b and c = not drop_c", _LABEL | _PRUNE)
def b4_prune_box(t):
    rows = labelled(t).persist()
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("hits")).first()
    box = boxes.measured(rows, {"q": (10.0, None), "p": (None, 50000.0), "d": (None, 0.08)}, "y", total["n"], total["hits"])
    pruned = boxes.prune_box(rows, box, "y", total["n"], total["hits"])
    rows.unpersist()
    return t.spark.createDataFrame([(",".join(pruned.box), pruned.density)], "kept_columns string, density double")


@query(None)
def b5_find_boxes(t):
    return boxes.boxes_as_rows(t.spark, boxes.find_boxes(labelled(t), COLUMNS, "y", binary=("o",)))


_BOXES = [boxes.Found({"q": (10.0, None), "d": (0.02, 0.08), "p": (None, 50000.0)}, 0, 0.0, 0.0, 0.0), boxes.Found({"x": (0.01, None), "q": (None, 40.0)}, 0, 0.0, 0.0, 0.0)]
_BOUNDS = {"bounds": "select * from (values (1, 1, 'q'), (1, 2, 'd'), (1, 3, 'p'), (2, 1, 'x'), (2, 2, 'q')) v(box_no, place, name)",
           "listed": "select box_no, gap_id, min({'a': place, 'b': gap_no}) as pos from bounds join param_gaps using (name) group by all"}


@query("select c.box_no, n_conditions, gap_list, exploratory from (select box_no, count(*) as n_conditions, bool_or(evidence = 'exploratory') as exploratory from bounds left join params using (name) group by all) c join (select box_no, string_agg(gap_id, ',' order by pos) as gap_list from listed group by all) g using (box_no)", _BOUNDS)
def b7_box_conditions(t):
    listed = t.param_gaps.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("gap_no", "gap_id"))).alias("g"))
    specs = t.params.join(listed, "name", "left").select("name", "evidence", F.transform("g", lambda x: x["gap_id"]).alias("gaps"))
    return boxes.box_gaps(boxes.box_conditions(t.spark, _BOXES, specs))


@query("select count(*) as n, count(*) filter (where q > 10 and p < 50000) as inside, cast(sum(y) filter (where q > 10 and p < 50000) as bigint) as hits, sum(y) filter (where q > 10 and p < 50000) / sum(y) as coverage, avg(y) filter (where q > 10 and p < 50000) as density from li", _LABEL)
def b6_box_stats(t):
    return boxes.box_stats(labelled(t), {"q": (10.0, None), "p": (None, 50000.0)}, "y")


@query("select name, bin, count(*) as n, min(value) as low, max(value) as high from (select name, value, cast(floor((row_number() over (partition by name order by value, world_id) - 1) * 10 / n) as bigint) as bin from (" + _LONG + ") cross join (select count(*) as n from events)) group by all")
def v3_equal_count_bins(t):
    n = t.events.count()
    strata = {"w_vuln": (7919, 3), "w_rec": (6607, 11), "penalty": (4409, 5), "cob_w": (3301, 17), "mismatch_w": (2207, 23)}
    # every parameter rises with its stratum, and a stratum holds one world: it is the rank
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), information.stratum_bin(F.col("world_id"), n, 10, *ab).alias("bin")) for c, ab in strata.items()))
    return t.worlds.select(F.inline(pairs)).groupBy("name", "bin").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


_VOI = {"binned": "select world_id, cast(floor((({0} * world_id + {1}) % n) * 10 / n) as bigint) as bin from (select event_id as world_id from events) cross join (select count(*) as n from events)".format(7919, 3),
        "sums": "select bin, set_id, cast(sum(score) as bigint) as s from binned join wscores using (world_id) group by all"}


@query("select (select cast(sum(m) as bigint) from (select max(s) as m from sums group by bin)) as informed, (select max(s) from (select cast(sum(s) as bigint) as s from sums group by set_id)) as uninformed", upto("wscores") | _VOI)
def v4_evppi_statistic(t):
    n = t.events.count()

    def reduce(space, part, table):
        bins = ((7919 * part.column("world_id").to_numpy() + 3) % n) * 10 // n
        own = np.unique(bins)
        sums = np.stack([table[bins == b].sum(0) for b in own])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sums.shape[1])), pa.array(np.tile(space.set_id, len(own))), pa.array(sums.ravel())], ["bin", "set_id", "s"])

    sums = W.score_worlds(t.world_terms(), t.space(), reduce, "bin long, set_id long, s long").groupBy("bin", "set_id").agg(F.sum("s").alias("s"))
    informed = sums.groupBy("bin").agg(F.max("s").alias("m")).agg(F.sum("m").alias("informed"))
    return informed.crossJoin(sums.groupBy("set_id").agg(F.sum("s").alias("s")).agg(F.max("s").alias("uninformed")))


_SWITCH = {"masked": "select world_id, m.measure_id, max(score) filter (where (set_id >> measure_no) & 1 = 1) as with_k, max(score) filter (where (set_id >> measure_no) & 1 = 0) as without_k from wscores cross join (select measure_id, measure_no from measures) m group by all"}


@query("select measure_id, count(*) filter (where with_k >= without_k) as worlds_in, median(with_k - without_k) as median_delta, quantile_cont(with_k - without_k, 0.05::double) as p5, quantile_cont(with_k - without_k, 0.95::double) as p95 from masked group by all", upto("wscores") | _SWITCH)
def v1_switching_values(t):
    def reduce(space, part, table):
        k = space.members.shape[1]
        low = np.iinfo(np.int64).min
        inside = np.stack([np.where(space.members[:, j] == 1, table, low).max(1) for j in range(k)], 1)
        outside = np.stack([np.where(space.members[:, j] == 0, table, low).max(1) for j in range(k)], 1)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(k), len(table))), pa.array((inside - outside).ravel())], ["measure_no", "delta"])

    rows = W.score_worlds(t.world_terms(), t.space(), reduce, "measure_no long, delta long").join(F.broadcast(t.measures.select("measure_no", "measure_id")), "measure_no")
    exact = lambda q: F.percentile("delta", F.lit(q))
    return rows.groupBy("measure_id").agg(F.count_if(F.col("delta") >= 0).alias("worlds_in"), exact(0.5).alias("median_delta"), exact(0.05).alias("p5"), exact(0.95).alias("p95"))


_READINGS = {"distance": "distance", "out_distance": "case when not inside then distance end", "in_distance": "case when inside then distance end", "delta": "delta", "star_delta": "star_delta", "star_distance": "star_distance"}
_SWITCHED = {
    "alternatives": """select world_id, m.measure_id, max(score) filter (where has) as with_score, max(score) filter (where not has) as without_score, arg_min(set_id, {'s': -score, 'c': cost, 'i': ids}) filter (where has) as with_set
        from (select *, (set_id >> measure_no) & 1 = 1 as has from wscores cross join (select measure_id, measure_no from measures)) m group by all""",
    "moves": """select a.*, b.best_set, b.best_score, (b.best_set >> m.measure_no) & 1 = 1 as inside, (star >> m.measure_no) & 1 = 1 as in_star, star, s.score as star_score from alternatives a join measures m using (measure_id) join wbest b using (world_id) cross join star0 join wscores s on s.world_id = a.world_id and s.set_id = star""",
    "gains": """select v.*, best_score - case when inside then without_score else with_score end as delta, p.part as own, star_score - case when in_star then without_score else with_score end as star_delta, q.part as star_own from moves v
        left join wparts p on p.world_id = v.world_id and p.measure_id = v.measure_id and p.set_id = case when inside then best_set else with_set end left join wparts q on q.world_id = v.world_id and q.measure_id = v.measure_id and q.set_id = case when in_star then star else with_set end""",
    "switched": "select *, case when own > 0 then delta / own end as distance, case when star_own > 0 then star_delta / star_own end as star_distance from gains",
}


@query("select measure_id, bool_or(in_star) as in_star, avg(inside::int) as share_in_best, avg((best_set <> star)::int) as star_beaten_share, " + ", ".join(f"quantile_cont(({x})::double, {q}::double) as {r}_{n}" for r, x in _READINGS.items() for n, q in (("p5", 0.05), ("median", 0.5), ("p95", 0.95))) + " from switched group by measure_id", upto("star0") | _SWITCHED)
def v1_switching_readings(t):
    star = t.best().first()["set_id"]
    return information.switching_values(information.switching_rows(t.world_terms(), t.space(), star), t.measures, star)


_W0 = {"w0": """select m.measure_id, inside, b.score - case when inside then o.score else c.score end as delta, p.part as own from (select measure_id, (b.set_id >> measure_no) & 1 = 1 as inside from measures cross join best b) m
    cross join best b left join containing c on c.measure_id = m.measure_id left join without o on o.measure_id = m.measure_id left join parts p on p.measure_id = m.measure_id and p.set_id = case when inside then b.set_id else c.set_id end"""}


@query("select measure_id, inside, delta, own, case when own > 0 then delta / own end as distance from w0", portfolios.upto("without") | _W0)
def v2_world0_switching(t):
    return world0_switching(t)


def world0_switching(t):
    return information.world0_switching(t.measures, t.best(), t.containing(), t.without(), lambda ids: P.parts(P.members(t.sets().join(F.broadcast(ids), "set_id", "left_semi"), t.terms()), 0.5))


_EVPPI = {
    "shuffles": "select * from (values " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(information.SHUFFLES)) + ") v(shuffle_no, a, b)",
    "moved": "select world_id, shuffle_no, (a * world_id + b) % n as w, n from (select event_id as world_id from events) cross join (select count(*) as n from events) cross join shuffles",
    "labels": "select world_id, shuffle_no, unnest(['w_vuln', 'penalty', 'gamma']) as parameter, unnest([cast(floor(((7919 * w + 3) % n) * 10 / n) as bigint), cast(floor(((4409 * w + 5) % n) * 10 / n) as bigint), cast(floor(((5417 * w + 29) % n) * 2 / n) as bigint)]) as bin from moved",
    "labelled": "select parameter, shuffle_no, bin, set_id, cast(sum(score) as bigint) as s from labels join wscores using (world_id) group by all",
    "informed": "select parameter, shuffle_no, cast(sum(m) as bigint) as i from (select parameter, shuffle_no, bin, max(s) as m from labelled group by all) group by all",
    "baseline": "select max(s) as u, (select count(*) from events) as n from (select cast(sum(score) as bigint) as s from wscores group by set_id)",
    "evppi": "select parameter, cast(max(i) filter (where shuffle_no = 0) - any_value(u) as bigint) / any_value(n) as raw, cast(5 * max(i) filter (where shuffle_no = 0) - sum(i) filter (where shuffle_no > 0) as bigint) / (5 * any_value(n)) as corrected, cast(5 * max(i) filter (where shuffle_no = 0) - sum(i) filter (where shuffle_no > 0) as bigint) / (5 * any_value(u)) as corrected_pct from informed cross join baseline group by parameter",
}


def evppi(t):
    n = t.events.count()
    bins = {"w_vuln": (7919, 3, 10), "penalty": (4409, 5, 10), "gamma": (5417, 29, 2)}
    return information.evppi_corrected(t.world_terms(), t.space(), n, bins)


@query("select * from evppi", upto("wscores") | _EVPPI)
def v5_evppi_corrected(t):
    return evppi(t)


_LINKS = {"links": "select distinct parameter, gap_id from spec_gaps union select concat('eff[', measure_id, ']') as parameter, gap_id from gap_measures join gaps using (gap_id) where kind = 'model' and gap_id not in (select gap_id from spec_gaps)"}


@query("select * from links", _LINKS)
def v6_gap_links(t):
    return information.gap_links(t.gaps, t.gap_measures, t.spec_gaps)


@query("""select gap_id, kind, closest_measure, closest_distance, top_parameter, top_pct, row_number() over (partition by kind order by case when kind = 'model' then -coalesce(top_pct, 0) else coalesce(closest_distance, 1e300) end, gap_id) as place from gaps
    left join (select gap_id, arg_min(measure_id, {'d': distance, 'm': measure_id}) as closest_measure, min(distance) as closest_distance from gap_measures join (select measure_id, delta / own as distance from w0 where own > 0) using (measure_id) group by gap_id) using (gap_id)
    left join (select gap_id, arg_min(parameter, {'c': -corrected, 'p': parameter}) as top_parameter, max(corrected_pct) as top_pct from links join evppi using (parameter) join gaps using (gap_id) where kind = 'model' group by gap_id) using (gap_id)""", upto("wscores") | portfolios.upto("without") | _W0 | _EVPPI | _LINKS)
def v7_gap_ranking(t):
    return information.gap_ranking(t.gaps, t.gap_measures, world0_switching(t).select("measure_id", "distance"), information.gap_links(t.gaps, t.gap_measures, t.spec_gaps), evppi(t))


#: Every parameter's stratum (its multiplier and shift in the bindings) and number of bins.
STRATA = {"w_vuln": (7919, 3, 10), "w_rec": (6607, 11, 10), "gamma": (5417, 29, 2), "penalty": (4409, 5, 10), "cob_w": (3301, 17, 10), "mismatch_w": (2207, 23, 10), "u_eff": (1103, 41, 10), "u_dim": (9001, 7, 10)}
_RANKED = _EVPPI | {
    "labels": "select world_id, shuffle_no, unnest([" + ", ".join(f"'{x}'" for x in STRATA) + "]) as parameter, unnest([" + ", ".join(f"cast(floor((({a} * w + {b}) % n) * {k} / n) as bigint)" for a, b, k in STRATA.values()) + "]) as bin from moved",
}


def ranked_evppi(t):
    """What each parameter is worth knowing, with its place."""
    values = information.evppi_corrected(t.world_terms(), t.space(), t.events.count(), STRATA)
    return values.withColumn("place", F.row_number().over(Window.orderBy(F.desc("corrected"), "parameter")))  # a row for each parameter


@query("select *, row_number() over (order by corrected desc, parameter) as place from evppi", upto("wscores") | _RANKED)
def v5_evppi_ranked(t):
    return ranked_evppi(t)


_MEDIANS = {"medians": "select measure_id, quantile_cont(distance::double, 0.5::double) as distance from switched where distance is not null group by measure_id"}


@query("""select gap_id, kind, closest_measure, closest_distance, top_parameter, top_pct, row_number() over (partition by kind order by case when kind = 'model' then -coalesce(top_pct, 0) else coalesce(closest_distance, 1e300) end, gap_id) as place from gaps
    left join (select gap_id, arg_min(measure_id, {'d': distance, 'm': measure_id}) as closest_measure, min(distance) as closest_distance from gap_measures join medians using (measure_id) group by gap_id) using (gap_id)
    left join (select gap_id, arg_min(parameter, {'c': -corrected, 'p': parameter}) as top_parameter, max(corrected_pct) as top_pct from links join evppi using (parameter) join gaps using (gap_id) where kind = 'model' group by gap_id) using (gap_id)""", upto("star0") | _SWITCHED | _MEDIANS | _RANKED | _LINKS)
def v7_gaps_by_median(t):
    """Gaps in order within their kind, by the median distances of the measures they touch and the worth of all parameters."""
    distances = information.median_distances(t.world_terms(), t.space(), t.measures)
    return information.gap_ranking(t.gaps, t.gap_measures, distances, information.gap_links(t.gaps, t.gap_measures, t.spec_gaps), ranked_evppi(t))


@query("select parameter, corrected_pct, place from (select *, row_number() over (order by corrected desc, parameter) as place from evppi) where parameter not in (select parameter from spec_gaps)", upto("wscores") | _RANKED)
def v7_preferences(t):
    """Parameters that no gap informs: what they are worth is a matter of preference."""
    return ranked_evppi(t).join(t.spec_gaps.select("parameter").distinct(), "parameter", "left_anti").select("parameter", "corrected_pct", "place")


DELAY_COST = 0.007


def signals(t):
    """Driver and signal of every contingent measure (in 20 to 80 percent of the winning sets), with what waiting for the signal is worth."""
    best = t.best_per_world().select("world_id", "best_set")
    member = {r["measure_id"]: P.member(F.col("best_set"), F.lit(r["measure_no"])).cast("int").alias(f"y{r['measure_no']}") for r in t.measures.collect()}
    rows = t.worlds.select("world_id", *STRATA).join(best, "world_id").select(*STRATA, *member.values()).persist()
    names = {m: f"y{m[1:]}" for m in member}
    shares = rows.agg(*(F.avg(y).alias(y) for y in names.values())).first()
    contingent = {m: y for m, y in names.items() if 0.2 <= shares[y] < 0.8}
    gaps = {r["parameter"]: r["g"] for r in t.spec_gaps.groupBy("parameter").agg(F.array_join(F.slice(F.array_sort(F.collect_set("gap_id")), 1, 3), ",").alias("g")).collect()}
    found = information.entry_signals(rows, contingent, list(STRATA), [c for c in STRATA if c in gaps], binary=("gamma",))
    rows.unpersist()
    known = t.spark.createDataFrame([(c, gaps.get(c), "exploratory" if c in ("gamma", "w_vuln") else "assumption") for c in STRATA], "parameter string, gaps string, evidence string")
    share = t.spark.createDataFrame([(m, float(shares[y])) for m, y in contingent.items()], "name string, share_in_best double")
    worth = ranked_evppi(t).select("parameter", F.col("corrected_pct").alias("value_of_waiting"))
    first = found.filter("place = 1").join(found.groupBy("name", "role").agg(F.count("*").alias("n_conditions")), ["name", "role"])
    return first.join(share, "name").join(known, "parameter").join(worth, "parameter", "left").drop("place").withColumnRenamed("name", "measure_id")


@query(None)
def a1_entry_signals(t):
    return signals(t)


@query(None)
def a4_reserve_lists(t):
    """Which signals are worth a reserve: what waiting is worth beyond its cost, and is not exploratory."""
    rows = signals(t).filter("role = 'signal'").withColumn("exploratory", F.col("evidence") == "exploratory")
    return information.reserve_lists(information.reserve_rule(rows, DELAY_COST))


@query(None)
def a1_entry_signal(t):
    """What drives the measure whose place is most open (share of wins nearest to one half) into the best set."""
    rows = t.worlds.join(t.best_per_world().select("world_id", "best_set"), "world_id").persist()
    shares = rows.crossJoin(F.broadcast(t.measures.select("measure_id", "measure_no"))).groupBy("measure_id", "measure_no").agg(F.avg(P.member(F.col("best_set"), F.col("measure_no")).cast("double")).alias("share"))
    most_open = shares.orderBy(F.abs(F.col("share") - 0.5), "measure_id").first()
    labelled_worlds = rows.withColumn("y", P.member(F.col("best_set"), F.lit(most_open["measure_no"])).cast("int"))
    columns = ["w_vuln", "w_rec", "gamma", "penalty", "cob_w", "mismatch_w", "u_eff", "u_dim"]
    known = {r["parameter"] for r in t.spec_gaps.select("parameter").distinct().collect()}
    out = information.entry_signals(labelled_worlds, {most_open["measure_id"]: "y"}, columns, [c for c in columns if c in known], binary=("gamma",))
    rows.unpersist()
    return out.select(F.col("name").alias("measure_id"), F.lit(most_open["share"]).alias("share_in_best"), "role", "place", F.col("parameter").alias("name"), "low", "high", "kept", "support", "coverage", "density")


_MOVES = {
    "wcells": f"select world_id, unit_id, dimension_id, least(5, class_no + case when {_SHIFTS} then 1 else 0 end) as class_no from worlds cross join cells",
    "m1": "select * from (select world_id, measure_id, c.unit_id, c.dimension_id, class_no, max(class_no) over (partition by world_id, measure_id) as top from measures m join wcells c on m.dimension_id = c.dimension_id) where class_no = top",
    "m2": "select p.*, capacity, records, coalesce(matches, 0) as matches, min_records, count(*) over w as tied, count(capacity) over w as with_capacity, min(capacity) over w as lowest from m1 p left join capacity using (unit_id, dimension_id) left join coverage using (unit_id) left join matches using (measure_id, unit_id) cross join model window w as (partition by world_id, measure_id)",
    "m3": "select *, count(*) over w as left_, min(records) over w as fewest, max(matches) over w as most from m2 where not (tied > 1 and with_capacity = tied) or capacity = lowest window w as (partition by world_id, measure_id)",
    "moved_to": "select world_id, measure_id, string_agg(unit_id, ',' order by unit_id) as sited from m3 where not (left_ > 1 and fewest >= min_records) or matches = most group by all",
    "at0": "select measure_id, string_agg(unit_id, ',' order by unit_id) as at0 from placed group by all",
}


def placements(t):
    """Where each tied pattern of units that occurs in the worlds ends, by measure."""
    patterns = sites.tied_patterns(W.with_shifts(t.worlds, t.units), t.cells())
    return sites.placement_lookup(t.measures, patterns, t.capacity(), t.coverage(), t.matches(), t.model)


def world0_units(t):
    return t.placed().groupBy("measure_id").agg(F.array_join(F.array_sort(F.collect_list("unit_id")), ",").alias("world0_units"))


@query("select measure_id, pattern, class_no, sited as candidates, count(*) as n_worlds from (select world_id, measure_id, string_agg(unit_id, ',' order by unit_id) as pattern, any_value(class_no) as class_no from m1 group by all) join moved_to using (world_id, measure_id) group by all", cells.upto("placed") | _MOVES)
def c6_placement_lookup(t):
    return placements(t)


@query("select measure_id, at0 as world0_units, avg(case when sited <> at0 then 1.0 else 0.0 end) as changed, bool_or(at0 like '%,%') or avg(case when sited <> at0 then 1.0 else 0.0 end) >= 0.2 as decide_later from moved_to join at0 using (measure_id) group by all", cells.upto("placed") | _MOVES)
def a3_site_change_share(t):
    changes = sites.site_changes(placements(t), world0_units(t))
    return changes.withColumn("decide_later", F.contains("world0_units", F.lit(",")) | (F.col("changed") >= 0.2))


_SITES = {
    "star_members": "select m.*, scope <> 'corridor' as free from measures m cross join star0 where (star >> measure_no) & 1 = 1",
    "site_terms": """select m.measure_id, m.measure_no, m.dimension_id, m.free, u.unit_id, c.class_no, case when v.records >= min_records then case when denominator > 0 then coalesce(matches, 0) / denominator else 0.0 end end as rec_share, o.class_no as cob_class,
        needed is not null and lever <> 'S+CA' and lever <> needed as mismatch from star_members m cross join units u cross join model cross join denom left join cells c on c.unit_id = u.unit_id and c.dimension_id = m.dimension_id left join coverage v on v.unit_id = u.unit_id
        left join matches t on t.unit_id = u.unit_id and t.measure_id = m.measure_id left join cells o on o.unit_id = u.unit_id and o.dimension_id = m.cob_dim left join profiles p on p.unit_id = u.unit_id and p.dimension_id = m.dimension_id where m.free
        union all select measure_id, measure_no, dimension_id, false, -1, f.class_no, rec_share, cob_class, mismatch from facts f join (select measure_id, free from star_members where not free) using (measure_id)""",
    "site_base": "select w.*, f.*, least(5, class_no + case when scenario = 1 and (measure_no + world_id) % 3 = 0 then 1 else 0 end) / 5.0 as cs from worlds w cross join site_terms f",
    "site_worlds": """select world_id, penalty, measure_id, dimension_id, free, unit_id, coalesce(cast(floor(w_vuln * (0.5::double + 0.1::double * ((world_id * 5 + length(dimension_id)) % 11)) * (case when gamma = 2 then cs * cs else cs end)
        * (0.7::double + 0.03::double * ((world_id * 7 + measure_no * 3) % 11)) * (case when mismatch then mismatch_w else 1.0 end) * 1e6 + 0.5) as bigint), 0) as vuln,
        coalesce(cast(floor(w_rec * rec_share * 1e6 + 0.5) as bigint), 0) + coalesce(cast(floor(cob_w * (cob_class / 5.0) * 1e6 + 0.5) as bigint), 0) as flat from site_base""",
    "site_parts": "select *, vuln + flat as total, cast(floor(vuln * penalty + 0.5) as bigint) + flat as rest from site_worlds",
    # a dimension has two measures at most in these bindings, so its variants are pairs of sites
    "site_pairs": """select a.world_id, a.dimension_id, a.measure_id as m1, a.unit_id as u1, b.measure_id as m2, b.unit_id as u2, case when a.total >= b.total then a.total + b.rest else a.rest + b.total end as score from site_parts a join site_parts b on a.world_id = b.world_id and a.dimension_id = b.dimension_id and a.measure_id < b.measure_id
        union all select world_id, dimension_id, measure_id, unit_id, null, null, total from site_parts where dimension_id in (select dimension_id from star_members group by all having count(*) = 1)""",
    "site_tops": "select world_id, dimension_id, max(score) as top from site_pairs group by all",
    "site_given": "select world_id, dimension_id, measure_id, unit_id, max(score) as given from (select world_id, dimension_id, m1 as measure_id, u1 as unit_id, score from site_pairs union all select world_id, dimension_id, m2, u2, score from site_pairs where m2 is not null) group by all",
    # the other dimensions add the same to every site of a measure, so they don't decide which is best
    "site_wins": "select g.world_id, g.measure_id, count(*) as n_best, min(unit_id) as unit_id from site_given g join site_tops t on t.world_id = g.world_id and t.dimension_id = g.dimension_id and given = top join star_members m on m.measure_id = g.measure_id and free group by all",
    "variants": "select m.measure_id, u.unit_id, count(w.world_id) filter (where n_best = 1 and w.unit_id = u.unit_id) / count(*) as best_share, count(*) filter (where n_best > 1) / count(*) as tie_share, cast((select count(*) from units) ** (select count(*) from star_members where free) as bigint) as n_variants from star_members m cross join units u join site_wins w on w.measure_id = m.measure_id where free group by all",
}


def location_variants(t):
    """The best set of World 0 with its members moved over all units."""
    star = t.best().first()["set_id"]
    facts = sites.site_facts(t.measures, t.units, t.cells(), t.coverage(), t.matches(), t.model, t.denominator(), t.profiles())
    own = t.facts().withColumn("unit_id", F.lit(sites.OWN)).select(*facts.columns)
    catalogue = cells.small(facts.unionByName(own))
    members = [(r["measure_no"], r["measure_id"], r["dimension_id"], r["scope"] != "corridor") for r in t.measures.collect() if star >> r["measure_no"] & 1]
    units = sorted(r["unit_id"] for r in t.units.select("unit_id").collect())
    return sites.location_variants(W.Terms(t.worlds, catalogue, ("unit_id",)), members, units)


@query("select * from variants", upto("star0") | _SITES)
def a2_location_variants(t):
    return location_variants(t)


@query("""select measure_id, world0_units, changed, best_elsewhere, tie_share, tied, coalesce(case when withheld then near end, at_site, 'gap-sites') as resolving_gap from (select measure_id, at0 as world0_units, at0 like '%,%' as tied, changed, sum(case when list_contains(string_split(at0, ','), cast(unit_id as varchar)) then 0.0 else best_share end) as best_elsewhere, max(tie_share) as tie_share
    from variants join (select measure_id, at0, avg(case when sited <> at0 then 1.0 else 0.0 end) as changed from moved_to join at0 using (measure_id) group by all) using (measure_id) group by all) join (select measure_id, rec_share is null as withheld from facts) using (measure_id)
    left join (select measure_id, min(gap_id) filter (where kind = 'dependency') as near, min(gap_id) filter (where kind = 'site') as at_site from gap_measures join gaps using (gap_id) group by all) using (measure_id) where tied or changed >= 0.2 or best_elsewhere >= 0.2""", upto("star0") | _SITES | _MOVES)
def a3_decide_site_later(t):
    later = sites.decide_later(sites.site_changes(placements(t), world0_units(t)), location_variants(t))
    kinds = t.gap_measures.join(t.gaps, "gap_id").groupBy("measure_id").agg(F.min(F.when(F.col("kind") == "dependency", F.col("gap_id"))).alias("near"), F.min(F.when(F.col("kind") == "site", F.col("gap_id"))).alias("at_site"))
    rows = later.join(t.facts().select("measure_id", F.col("rec_share").isNull().alias("withheld")), "measure_id").join(kinds, "measure_id", "left")
    gap = F.coalesce(F.when(F.col("withheld"), F.col("near")), "at_site", F.lit("gap-sites"))
    return rows.select("measure_id", "world0_units", "changed", "best_elsewhere", "tie_share", "tied", gap.alias("resolving_gap"))


@query("select measure_id, parameter, corrected_pct as value_of_waiting, case when not corrected_pct > 0.0001::double then 'spend' when parameter = 'gamma' then 'watch' else 'reserve' end as decision from (select measure_id, case measure_no % 3 when 0 then 'w_vuln' when 1 then 'penalty' else 'gamma' end as parameter from measures) join evppi using (parameter)", upto("wscores") | _EVPPI)
def a4_reserve_rule(t):
    signals = t.measures.select("measure_id", F.when(F.col("measure_no") % 3 == 0, "w_vuln").when(F.col("measure_no") % 3 == 1, "penalty").otherwise("gamma").alias("parameter"))
    values = evppi(t).select("parameter", F.col("corrected_pct").alias("value_of_waiting"))
    rows = signals.join(values, "parameter").withColumn("exploratory", F.col("parameter") == "gamma")
    return information.reserve_rule(rows, 0.0001).select("measure_id", "parameter", "value_of_waiting", "decision")
