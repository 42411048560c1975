"""Registered queries on portfolios, with their SQL twins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from robustspark.operators import portfolios as P
from robustspark.plans import cells

QUERIES, ORACLES = {}, {}
MEASURES = 10
query = partial(cells.query, into=(QUERIES, ORACLES))

_PARTS = "select *, {kept} + coalesce(rec, 0) {cob} as part from (select *, row_number() over (partition by set_id, dimension_id order by vuln + coalesce(rec, 0) {cob} desc, measure_id) as place from set_members)"


def part_sql(penalty: float, with_cob: bool = False) -> str:
    return _PARTS.format(kept=f"case when place = 1 then vuln else cast(floor(vuln * {penalty}::double + 0.5) as bigint) end", cob="+ cob" if with_cob else "")


CTES = cells.CTES | {
    "sets0": "select s.set_id, count(*) as n, cast(sum(cost) as bigint) as cost, string_agg(measure_id, '|' order by measure_id) as ids from (select unnest(range(1, 1024)) as set_id) s join measures m on (s.set_id >> measure_no) & 1 = 1 group by all",
    "sets": "select set_id, n, cost, ids from sets0 cross join fund where cost <= budget",
    "set_members": "select s.set_id, s.n, s.cost as set_cost, s.ids, t.* from sets s join terms t on (s.set_id >> measure_no) & 1 = 1",
    "parts": part_sql(0.5),
    "scored": "select s.*, score from sets s join (select set_id, cast(sum(part) as bigint) as score from parts group by all) using (set_id)",
    "best": "select * from scored order by score desc, cost, ids limit 1",
    "containing": "select measure_id, unnest(arg_min({'set_id': set_id, 'score': score, 'cost': cost, 'ids': ids}, {'a': -score, 'b': cost, 'c': ids})) from scored join (select measure_id, measure_no from measures) m on (set_id >> measure_no) & 1 = 1 group by measure_id",
    "without": "select measure_id, unnest(arg_min({'set_id': set_id, 'score': score, 'cost': cost, 'ids': ids}, {'a': -score, 'b': cost, 'c': ids})) from scored join (select measure_id, measure_no from measures) m on (set_id >> measure_no) & 1 = 0 group by measure_id",
}


def upto(*names: str) -> dict[str, str]:
    """The common expressions up to the last of some."""
    keys = list(CTES)
    return {k: CTES[k] for k in keys[: max(keys.index(n) for n in names) + 1]}


class Sets(cells.Model):
    """The model with its portfolio space."""

    def sets(self):
        return P.enumerate_portfolios(self.spark, self.measures, self.fund, MEASURES)

    def parts(self, penalty=0.5, **options):
        return P.parts(P.members(self.sets(), self.terms()), penalty, **options)

    def scored(self, penalty=0.5, name="score", **options):
        return self.sets().join(self.parts(penalty, **options).groupBy("set_id").agg(F.sum("part").alias(name)), "set_id")

    @cells.once
    def best(self):
        return cells.small(P.best(self.scored(), -F.col("score")))

    def containing(self):
        return P.best_by_measure(self.scored(), self.measures)

    def without(self):
        return P.best_by_measure(self.scored(), self.measures, inside=False)

    def selected(self):
        """The measures of the best set, with their contributions."""
        return self.parts().join(F.broadcast(self.best().select("set_id")), "set_id")


cells_query = query


def query(sql=None, ctes=None):  # noqa: F811
    def wrap(f):
        return cells_query(sql, ctes)(lambda_named(f))

    return wrap


def lambda_named(f):
    def run(model):
        return f(Sets(model.spark, model.sf_dir))

    run.__name__ = f.__name__
    return run


@query("select * from sets", upto("sets"))
def p1_enumerate_portfolios(t):
    return t.sets()


@query("select set_id, row_number() over (order by cost, ids) - 1 as tie_rank from sets", upto("sets"))
def p2_tie_rank(t):
    # the space is bounded by 2^measures rows of a few bytes, so one ordered partition holds it
    return t.sets().select("set_id", (F.row_number().over(Window.orderBy("cost", "ids")) - 1).alias("tie_rank"))


@query("select set_id, ids from sets s cross join fund where not exists (select 1 from measures m where (s.set_id >> measure_no) & 1 = 0 and s.cost + m.cost <= budget)", upto("sets"))
def p3_maximal_sets(t):
    outside = t.measures.select("measure_no", F.col("cost").alias("extra"))
    sets = t.sets().crossJoin(F.broadcast(t.fund))
    return sets.join(F.broadcast(outside), ~P.member(F.col("set_id"), F.col("measure_no")) & (F.col("cost") + F.col("extra") <= F.col("budget")), "left_anti").select("set_id", "ids")


@query("select cast(sum(k) as bigint) as n_variants, count(*) as n_sets from (select s.set_id, cast(any_value(u) ** count(*) filter (where scope <> 'corridor') as bigint) as k from sets s join measures m on (s.set_id >> measure_no) & 1 = 1 cross join (select count(*) as u from units) group by s.set_id)", upto("sets"))
def p4_variant_count(t):
    units = t.units.agg(F.count("*").alias("u"))
    rows = P.members(t.sets(), t.measures).groupBy("set_id").agg(F.count_if(F.col("scope") != "corridor").alias("free"))
    return rows.crossJoin(units).agg(F.sum(F.pow("u", "free").cast("long")).alias("n_variants"), F.count("*").alias("n_sets"))


@query("select set_id, measure_id, dimension_id, place, part from parts", upto("parts"))
def p5_score_parts(t):
    return t.parts().select("set_id", "measure_id", "dimension_id", "place", "part")


@query("select set_id, cast(sum(cast(floor(part * (case when class_no >= 4 then 1.0 else 0.5 end)::double / cost * 1000 + 0.5) as bigint)) as bigint) as regret_score from parts group by all", upto("parts"))
def p6_regret_gate(t):
    return t.parts(gate=(4, 0.5)).groupBy("set_id").agg(F.sum("part").alias("regret_score"))


@query("select * from best", upto("best"))
def p7_best_portfolio(t):
    return t.best()


@query("select * from scored cross join fund where (set_id >> 1) & 1 = 1 and (set_id >> 4) & 1 = 0 and cost <= budget - 100 order by score desc, cost, ids limit 1", upto("scored"))
def p8_constrained_best(t):
    s = F.col("set_id")
    allowed = t.scored().crossJoin(F.broadcast(t.fund)).filter(P.member(s, F.lit(1)) & ~P.member(s, F.lit(4)) & (F.col("cost") <= F.col("budget") - 100))
    return P.best(allowed, -F.col("score"))


_LENS = "select '{lens}' as lens, set_id, ids, cast({value} as bigint) as lens_score from ({source}) order by {order}, cost, ids limit 1"
_WIDE = """select s.*, n_score, direct, hybrid, grey, m_score, r_score from scored s join (select set_id, cast(sum(part) as bigint) as n_score, count(*) filter (where nbs_class = 'NBS_DIRECT') as direct, count(*) filter (where nbs_class = 'NBS_HYBRID') as hybrid,
    coalesce(sum(cost) filter (where nbs_class = 'GREY_INFRASTRUCTURE'), 0) as grey from parts_cob group by all) using (set_id) join (select set_id, cast(sum(part) as bigint) as m_score from parts_multi group by all) using (set_id)
    join (select set_id, cast(sum(cast(floor(part * (case when class_no >= 4 then 1.0 else 0.5 end)::double / cost * 1000 + 0.5) as bigint)) as bigint) as r_score from parts_cob group by all) using (set_id)"""


@query(
    "select * from (" + ") union all select * from (".join(_LENS.format(lens=n, value=v, source="select * from wide" + w, order=o) for n, v, o, w in (
        ("institutional", "score", "score desc", ""), ("nature", "n_score", "n_score desc, direct desc, hybrid desc, grey", ""), ("multidimensional", "m_score", "m_score desc", ""),
        ("low_regret", "r_score", "r_score desc", ""), ("max_count", "score", "n desc, score desc", ""), ("grey_forced", "score", "score desc", " where grey > 0"))) + ")",
    upto("scored") | {"parts_cob": part_sql(0.5, True), "parts_multi": part_sql(0.15, True), "wide": _WIDE},
)
def p9_lens_best(t):
    cob, multi = t.parts(with_cob=True), t.parts(0.15, with_cob=True)
    kinds = [F.count_if(F.col("nbs_class") == c).alias(n) for c, n in (("NBS_DIRECT", "direct"), ("NBS_HYBRID", "hybrid"))]
    grey = F.coalesce(F.sum(F.when(F.col("nbs_class") == "GREY_INFRASTRUCTURE", F.col("measure_cost"))), F.lit(0)).alias("grey")
    wide = t.scored().join(cob.groupBy("set_id").agg(F.sum("part").alias("n_score"), *kinds, grey), "set_id").join(multi.groupBy("set_id").agg(F.sum("part").alias("m_score")), "set_id")
    wide = wide.join(t.parts(with_cob=True, gate=(4, 0.5)).groupBy("set_id").agg(F.sum("part").alias("r_score")), "set_id")
    c = F.col
    lenses = {
        "institutional": (wide, c("score"), [-c("score")]), "nature": (wide, c("n_score"), [-c("n_score"), -c("direct"), -c("hybrid"), c("grey")]), "multidimensional": (wide, c("m_score"), [-c("m_score")]),
        "low_regret": (wide, c("r_score"), [-c("r_score")]), "max_count": (wide, c("score"), [-c("n"), -c("score")]), "grey_forced": (wide.filter("grey > 0"), c("score"), [-c("score")]),
    }
    firsts = []
    for name, (_, value, keys) in lenses.items():
        order = F.struct(*(k.alias(f"k{i}") for i, k in enumerate((*keys, c("cost"), c("ids")))))
        allowed = c("grey") > 0 if name == "grey_forced" else F.lit(True)
        firsts.append(F.struct(F.lit(name).alias("lens"), F.min_by(F.when(allowed, F.struct("set_id", "ids", value.alias("lens_score"))), F.when(allowed, order)).alias("b")))
    return wide.agg(F.array(*firsts).alias("all")).select(F.explode("all").alias("x")).select("x.lens", "x.b.set_id", "x.b.ids", "x.b.lens_score").filter("set_id is not null")


@query("select measure_id, set_id, score, cost, ids from containing", upto("containing"))
def p10_best_containing(t):
    return t.containing()


@query("select c.measure_id, b.score - c.score as gap from containing c cross join best b join measures m on m.measure_id = c.measure_id where (b.set_id >> measure_no) & 1 = 0", upto("containing"))
def p11_rejected_gaps(t):
    best = t.best().select(F.col("set_id").alias("best_id"), F.col("score").alias("best_score"))
    rows = t.containing().join(t.measures.select("measure_id", "measure_no"), "measure_id").crossJoin(best)
    return rows.filter(~P.member(F.col("best_id"), F.col("measure_no"))).select("measure_id", (F.col("best_score") - F.col("score")).alias("gap"))


@query("select w.measure_id, greatest(0, b.score - w.score) as loss, w.ids as replacement from without w cross join best b join measures m on m.measure_id = w.measure_id where (b.set_id >> measure_no) & 1 = 1", upto("without"))
def p12_leave_one_out(t):
    best = t.best().select(F.col("set_id").alias("best_id"), F.col("score").alias("best_score"))
    rows = t.without().join(t.measures.select("measure_id", "measure_no"), "measure_id").crossJoin(best)
    return rows.filter(P.member(F.col("best_id"), F.col("measure_no"))).select("measure_id", F.greatest(F.lit(0), F.col("best_score") - F.col("score")).alias("loss"), F.col("ids").alias("replacement"))


_STRESSED = {"set_members2": "select set_id, n, set_cost, ids, measure_id, measure_no, dimension_id, cost, class_no, case when dimension_id = 'BUILDING' then vuln + 140000 else vuln end as vuln, rec, cob from set_members", "parts2": part_sql(0.5).replace("set_members", "set_members2"),
             "best2": "select s.*, score from sets s join (select set_id, cast(sum(part) as bigint) as score from parts2 group by all) using (set_id) order by score desc, cost, ids limit 1"}


@query("""select measure_id, (a.set_id >> measure_no) & 1 = 1 as before, (b.set_id >> measure_no) & 1 = 1 as after, case when (a.set_id >> measure_no) & 1 = 1 then case when (b.set_id >> measure_no) & 1 = 1 then 'kept' else 'exited' end else case when (b.set_id >> measure_no) & 1 = 1 then 'entered' else 'out' end end as status
    from measures cross join best a cross join best2 b""", upto("best") | _STRESSED)
def p13_stress_compare(t):
    stressed = t.terms().withColumn("vuln", F.when(F.col("dimension_id") == "BUILDING", F.col("vuln") + 140000).otherwise(F.col("vuln")))
    sets = t.sets()
    other = P.best(sets.join(P.scores(sets, stressed, 0.5), "set_id"), -F.col("score")).select(F.col("set_id").alias("b"))
    rows = t.measures.select("measure_id", "measure_no").crossJoin(t.best().select(F.col("set_id").alias("a"))).crossJoin(other)
    before, after = P.member(F.col("a"), F.col("measure_no")), P.member(F.col("b"), F.col("measure_no"))
    status = F.when(before & after, "kept").when(before, "exited").when(after, "entered").otherwise("out")
    return rows.select("measure_id", before.alias("before"), after.alias("after"), status.alias("status"))


_FORCED = {"forced": "select * from scored where (set_id >> 6) & 1 = 1 order by score desc, cost, ids limit 1"}


@query("""select b.score - f.score as loss, 100.0 * (b.score - f.score) / b.score as loss_pct, (select string_agg(measure_id, '|' order by measure_id) from measures where (b.set_id >> measure_no) & 1 = 1 and (f.set_id >> measure_no) & 1 = 0) as leave_ids,
    (select string_agg(measure_id, '|' order by measure_id) from measures where (b.set_id >> measure_no) & 1 = 0 and (f.set_id >> measure_no) & 1 = 1) as enter_ids from best b cross join forced f""", upto("best") | _FORCED)
def p14_price_of_constraint(t):
    forced = P.best(t.scored().filter(P.member(F.col("set_id"), F.lit(6))), -F.col("score")).select(F.col("score").alias("f_score"), F.col("ids").alias("f_ids"))
    rows = t.best().crossJoin(forced)
    a, b = F.split("ids", "\\|"), F.split("f_ids", "\\|")
    loss = F.col("score") - F.col("f_score")
    text = lambda x: F.nullif(F.array_join(F.array_sort(x), "|"), F.lit(""))
    return rows.select(loss.alias("loss"), (100.0 * loss / F.col("score")).alias("loss_pct"), text(F.array_except(a, b)).alias("leave_ids"), text(F.array_except(b, a)).alias("enter_ids"))


@query("select p.set_id, p.ids, p.set_cost, cast(sum(part) as bigint) as score, count(distinct dimension_id) as n_dimensions, count(*) as n from parts p where p.set_id in (select set_id from best union all select set_id from forced) group by all", upto("best") | _FORCED)
def p15_compare_portfolios(t):
    forced = P.best(t.scored().filter(P.member(F.col("set_id"), F.lit(6))), -F.col("score"))
    two = t.best().select("set_id").unionByName(forced.select("set_id")).distinct()
    rows = t.parts().join(F.broadcast(two), "set_id")
    return rows.groupBy("set_id", "ids", F.col("cost").alias("set_cost")).agg(F.sum("part").alias("score"), F.countDistinct("dimension_id").alias("n_dimensions"), F.count("*").alias("n"))


@query("select measure_id, part, row_number() over (order by part desc, measure_id) as rank from parts join (select set_id from best) using (set_id)", upto("best"))
def p16_implementation_order(t):
    return t.selected().select("measure_id", "part", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("part"), "measure_id")).alias("rank"))


@query("select measure_id, vuln + coalesce(rec, 0) as verified, vuln + coalesce(rec, 150000) as upper, rec is null as withheld from terms", upto("terms"))
def p17_evidence_interval(t):
    rec = F.col("rec")
    return t.terms().select("measure_id", (F.col("vuln") + F.coalesce(rec, F.lit(0))).alias("verified"), (F.col("vuln") + F.coalesce(rec, F.lit(150000))).alias("upper"), rec.isNull().alias("withheld"))


@query("select s.set_id, s.score + 150000 * missing - b.score as margin from scored s join (select set_id, count(*) filter (where rec is null) as missing from set_members group by all) using (set_id) cross join best b where s.set_id <> b.set_id and s.score + 150000 * missing > b.score", upto("best"))
def p18_missing_evidence_flips(t):
    missing = P.members(t.sets(), t.terms()).groupBy("set_id").agg(F.count_if(F.col("rec").isNull()).alias("missing"))
    rows = t.scored().join(missing, "set_id").crossJoin(t.best().select(F.col("set_id").alias("best_id"), F.col("score").alias("best_score")))
    margin = F.col("score") + 150000 * F.col("missing") - F.col("best_score")
    return rows.filter((F.col("set_id") != F.col("best_id")) & (margin > 0)).select("set_id", margin.alias("margin"))


@query("""select measure_id, gap, case when r <= 0.05 then 1 when r <= 0.25 then 2 when r <= 1 then 3 else 4 end as band from (select c.measure_id, b.score - c.score as gap, (b.score - c.score) / 700000.0 as r from containing c cross join best b join measures m on m.measure_id = c.measure_id where (b.set_id >> measure_no) & 1 = 0)
    order by gap, measure_id limit 3""", upto("containing"))
def p19_hinge_bands(t):
    best = t.best().select(F.col("set_id").alias("best_id"), F.col("score").alias("best_score"))
    rows = t.containing().join(t.measures.select("measure_id", "measure_no"), "measure_id").crossJoin(best).filter(~P.member(F.col("best_id"), F.col("measure_no")))
    rows = rows.withColumn("gap", F.col("best_score") - F.col("score"))
    r = F.col("gap") / 700000.0
    return rows.orderBy("gap", "measure_id").limit(3).select("measure_id", "gap", F.when(r <= 0.05, 1).when(r <= 0.25, 2).when(r <= 1, 3).otherwise(4).alias("band"))


@query("""select measure_id, case when inside then 'SELECTED' when rank <= 3 then 'CLOSE ALTERNATIVE' else 'NOT SELECTED' end as status, case when inside then 0 else gap end as gap from (select *, row_number() over (partition by inside order by gap, measure_id) as rank
    from (select c.measure_id, (b.set_id >> measure_no) & 1 = 1 as inside, b.score - c.score as gap from containing c cross join best b join measures m on m.measure_id = c.measure_id))""", upto("containing"))
def p20_decision_matrix(t):
    best = t.best().select(F.col("set_id").alias("best_id"), F.col("score").alias("best_score"))
    rows = t.containing().join(t.measures.select("measure_id", "measure_no"), "measure_id").crossJoin(best)
    rows = rows.select("measure_id", P.member(F.col("best_id"), F.col("measure_no")).alias("inside"), (F.col("best_score") - F.col("score")).alias("gap"))
    rank = F.row_number().over(Window.partitionBy("inside").orderBy("gap", "measure_id"))
    status = F.when(F.col("inside"), "SELECTED").when(F.col("rank") <= 3, "CLOSE ALTERNATIVE").otherwise("NOT SELECTED")
    return rows.withColumn("rank", rank).select("measure_id", status.alias("status"), F.when(F.col("inside"), 0).otherwise(F.col("gap")).alias("gap"))


_CHOSEN = {"chosen": "select p.measure_id, p.dimension_id, p.nbs_class, p.cost from parts p join (select set_id from best) using (set_id)"}


@query("select d.dimension_id, (select count(*) from chosen c where c.dimension_id = d.dimension_id) as funded, (select count(*) from cells c where c.dimension_id = d.dimension_id and class_no >= 4) as high_units from dims d", upto("best") | _CHOSEN)
def p21_residual_view(t):
    funded = t.selected().groupBy("dimension_id").agg(F.count("*").alias("f"))
    high = t.cells().filter("class_no >= 4").groupBy("dimension_id").agg(F.count("*").alias("h"))
    rows = t.dims.select("dimension_id").join(funded, "dimension_id", "left").join(high, "dimension_id", "left")
    return rows.select("dimension_id", F.coalesce("f", F.lit(0)).alias("funded"), F.coalesce("h", F.lit(0)).alias("high_units"))


@query("select unit_id, dimension_id, class_no from cells where class_no >= 4 and dimension_id not in (select dimension_id from chosen)", upto("best") | _CHOSEN)
def p22_uncovered_cells(t):
    return t.cells().filter("class_no >= 4").join(F.broadcast(t.selected().select("dimension_id").distinct()), "dimension_id", "left_anti").select("unit_id", "dimension_id", "class_no")


@query("select m.nbs_class, count(c.measure_id) as n, coalesce(cast(sum(c.cost) as bigint), 0) as investment from (select distinct nbs_class from measures) m left join chosen c on c.nbs_class = m.nbs_class group by all", upto("best") | _CHOSEN)
def p23_class_rollup(t):
    chosen = t.selected().groupBy("nbs_class").agg(F.count("*").alias("k"), F.sum("measure_cost").alias("c"))
    rows = t.measures.select("nbs_class").distinct().join(chosen, "nbs_class", "left")
    return rows.select("nbs_class", F.coalesce("k", F.lit(0)).alias("n"), F.coalesce("c", F.lit(0)).alias("investment"))


@query("select dimension_id, count(*) filter (where class_no >= 4) as high_units, cast(sum(class_no) as bigint) as class_sum from cells group by all order by high_units desc, class_sum desc, dimension_id limit 1", upto("cells"))
def p24_regional_pressure(t):
    rows = t.cells().groupBy("dimension_id").agg(F.count_if(F.col("class_no") >= 4).alias("high_units"), F.sum("class_no").alias("class_sum"))
    return rows.orderBy(F.desc("high_units"), F.desc("class_sum"), "dimension_id").limit(1)
