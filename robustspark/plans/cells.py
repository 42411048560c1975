"""Registered queries on cells and terms, with their SQL twins."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustspark.operators import cells as C
from robustspark.sources.bind import Tables, oracle

QUERIES, ORACLES = {}, {}

#: Common expressions of the oracles.
CTES = {
    "cells": "select unit_id, dimension_id, arg_min(class_no, {'v': value is null, 'r': row_no}) as class_no from metric_rows where class_no is not null group by all",
    "capacity": "select unit_id, dimension_id, arg_min(value, row_no) as capacity from capacity_rows where value is not null group by all",
    "coverage": "select u.unit_id, count(record_id) as records from units u left join records r on u.unit_id = r.unit_id group by all",
    "matches": "select measure_id, unit_id, count(*) as matches from records where measure_id is not null group by all",
    "denom": "select coalesce(max(matches), 0) as denominator from matches join coverage using (unit_id) cross join model where records >= min_records",
    "place1": "select * from (select measure_id, c.*, max(class_no) over (partition by measure_id) as top from measures m join cells c on m.dimension_id = c.dimension_id) where class_no = top",
    "place2": "select p.*, capacity, records, coalesce(matches, 0) as matches, min_records, count(*) over w as tied, count(capacity) over w as with_capacity, min(capacity) over w as lowest from place1 p left join capacity using (unit_id, dimension_id) left join coverage using (unit_id) left join matches using (measure_id, unit_id) cross join model window w as (partition by measure_id)",
    "place3": "select *, (tied > 1 and with_capacity = tied) as step_capacity, count(*) over w as left_, min(records) over w as fewest, max(matches) over w as most from place2 where not (tied > 1 and with_capacity = tied) or capacity = lowest window w as (partition by measure_id)",
    "placed": "select measure_id, dimension_id, unit_id, class_no, records, matches, step_capacity, (left_ > 1 and fewest >= min_records) as step_records from place3 where not (left_ > 1 and fewest >= min_records) or matches = most",
    "profiles": """select u.unit_id, d.dimension_id, s_level, ca_level, case when s_level >= 4 and ca_level >= 2 then 'reduce_s' when s_level >= 4 and ca_level < 2 then 'both' when s_level < 4 and ca_level < 2 then 'raise_ca'
        when s_level is not null and ca_level is not null then 'no_lever' when s_level is not null or ca_level is not null then 'partial' else 'unknown' end as profile,
        case when s_level >= 4 and ca_level >= 2 then 'S' when s_level < 4 and ca_level < 2 then 'CA' end as needed from units u cross join dims d left join readings r on u.unit_id = r.unit_id and d.dimension_id = r.dimension_id""",
    "rec_terms": "select measure_id, case when min(records) >= any_value(min_records) then case when any_value(denominator) > 0 then max(matches) / any_value(denominator) else 0.0 end end as rec_share from placed cross join model cross join denom group by all",
    "cob_terms": "select p.measure_id, min(c.class_no) as cob_class from placed p join measures m on p.measure_id = m.measure_id and cob_dim is not null left join cells c on c.unit_id = p.unit_id and c.dimension_id = m.cob_dim group by all",
    "fits": "select p.measure_id, bool_and(needed is not null and lever <> 'S+CA' and lever <> needed) as mismatch from placed p join measures m using (measure_id) left join profiles f on f.unit_id = p.unit_id and f.dimension_id = p.dimension_id group by all",
    "terms": """select m.measure_id, m.measure_no, m.dimension_id, cost, scope, nbs_class, top_class as class_no, cast(floor(0.7 * (top_class / 5.0) * (case when mismatch then 0.8 else 1.0 end) * 1e6 + 0.5) as bigint) as vuln,
        cast(floor(0.15 * rec_share * 1e6 + 0.5) as bigint) as rec, coalesce(cast(floor(0.15 * (cob_class / 5.0) * 1e6 + 0.5) as bigint), 0) as cob
        from measures m join (select measure_id, max(class_no) as top_class from placed group by all) t using (measure_id) left join rec_terms using (measure_id) left join cob_terms using (measure_id) left join fits using (measure_id)""",
}


def upto(name: str) -> dict[str, str]:
    """The common expressions up to one of them."""
    keys = list(CTES)
    return {k: CTES[k] for k in keys[: keys.index(name) + 1]}


#: Rows up to which a result is worth keeping as literal rows.
SMALL_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """A result computed once: as literal rows, which later plans can fold and broadcast, or kept by Spark if it is not small."""
    df = df.persist()
    if df.count() > SMALL_ROWS:
        return df
    rows = df.collect()
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, df.schema)


def once(method):
    """A method whose result the model keeps."""

    @wraps(method)
    def get(self):
        kept = self.__dict__.setdefault("_kept", {})
        if method.__name__ not in kept:
            kept[method.__name__] = method(self)
        return kept[method.__name__]

    return get


class Model(Tables):
    """Bound tables and the model tables derived from them."""

    # What is kept below has at most a row per unit and measure, or per cell.

    @once
    def cells(self):
        return small(C.resolve_class(self.metric_rows))

    @once
    def capacity(self):
        return small(C.resolve_capacity(self.capacity_rows))

    @once
    def counts(self):
        """Records per unit and measure, the one pass over the records."""
        return small(C.record_counts(self.records))

    def coverage(self):
        return C.coverage_of(self.units, self.counts())

    def matches(self):
        return C.match_counts(self.counts())

    @once
    def denominator(self):
        return small(C.max_adequate(self.coverage(), self.matches(), self.model))

    @once
    def placed(self):
        return small(C.place_measures(self.measures, self.cells(), self.capacity(), self.coverage(), self.matches(), self.model))

    def profiles(self):
        return C.lever_profiles(self.units, self.dims, self.readings)

    @once
    def terms(self):
        """Terms of every measure in World 0, in micro-units; at most one row a measure, so its users may broadcast it."""
        placed = self.placed()
        top = placed.groupBy("measure_id").agg(F.max("class_no").alias("class_no"))
        rows = self.measures.join(top, "measure_id").join(C.recurrence_term(placed, self.model, self.denominator()), "measure_id", "left")
        rows = rows.join(C.cobenefit_term(placed, self.measures, self.cells()), "measure_id", "left").join(C.lever_fit(placed, self.measures, self.profiles()), "measure_id", "left")
        fit = F.when(F.col("mismatch"), 0.8).otherwise(1.0)
        return small(rows.select(
            "measure_id", "measure_no", "dimension_id", "cost", "scope", "nbs_class", "class_no", C.micro(F.lit(0.7) * C.class_score(F.col("class_no")) * fit).alias("vuln"),
            C.micro(F.lit(0.15) * F.col("rec_share")).alias("rec"), F.coalesce(C.micro(F.lit(0.15) * C.class_score(F.col("cob_class"))), F.lit(0)).cast("long").alias("cob"),
        ))


def query(sql: str | None = None, ctes: dict[str, str] | None = None, into=None):
    """Registers a function of the model under its name, with its oracle."""
    queries, oracles = into or (QUERIES, ORACLES)

    def wrap(f):
        queries[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            oracles[f.__name__] = oracle(sql, ctes)
        return f

    return wrap


@query("select * from cells", upto("cells"))
def c1_resolve_class(t):
    return t.cells()


@query("select * from capacity", {"capacity": CTES["capacity"]})
def c2_resolve_capacity(t):
    return t.capacity()


@query("select row_no, class_no / 5.0 as score, (class_no / 5.0) * (class_no / 5.0) as score_squared from metric_rows")
def c3_class_score(t):
    return t.metric_rows.select("row_no", C.class_score(F.col("class_no")).alias("score"), C.class_score(F.col("class_no"), F.lit(2)).alias("score_squared"))


@query("select row_no, unit_id, least(5, class_no + case when unit_id % 3 = 0 then 1 else 0 end) as shifted_class from metric_rows where class_no is not null")
def c4_shift_classes(t):
    return t.metric_rows.filter("class_no is not null").select("row_no", "unit_id", C.shifted(F.col("class_no"), F.col("unit_id") % 3 == 0).alias("shifted_class"))


@query("select * from placed", upto("placed"))
def c5_place_measures(t):
    return t.placed()


@query("select measure_id, string_agg(cast(unit_id as varchar), ',' order by unit_id) as pattern, count(*) as n_tied, max(class_no) as class_no from place1 group by all", upto("place1"))
def c6_placement_patterns(t):
    tied = t.measures.select("measure_id", "dimension_id").join(t.cells(), "dimension_id").groupBy("measure_id").agg(F.max("class_no").alias("top"))
    rows = t.measures.select("measure_id", "dimension_id").join(t.cells(), "dimension_id").join(tied, "measure_id").filter("class_no = top")
    return rows.groupBy("measure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("unit_id")), lambda x: x.cast("string")), ",").alias("pattern"), F.count("*").alias("n_tied"), F.max("class_no").alias("class_no"))


@query("select * from rec_terms", upto("rec_terms"))
def c7_recurrence_term(t):
    return C.recurrence_term(t.placed(), t.model, t.denominator())


@query("select * from cob_terms", upto("cob_terms"))
def c8_cobenefit_term(t):
    return C.cobenefit_term(t.placed(), t.measures, t.cells())


@query("select profile, needed, count(*) as n from profiles group by all", {"profiles": CTES["profiles"].replace("join readings r", "join grid_readings r")})
def c9_lever_profiles(t):
    return C.lever_profiles(t.units, t.dims, t.grid_readings).groupBy("profile", "needed").agg(F.count("*").alias("n"))


@query("select * from fits", upto("fits"))
def c10_lever_fit(t):
    return C.lever_fit(t.placed(), t.measures, t.profiles())


@query("select * from terms", upto("terms"))
def c11_measure_terms(t):
    return t.terms()


@query("""select m.measure_id, s.unit_id as site, cast(floor(0.7 * (c.class_no / 5.0) * 1e6 + 0.5) as bigint) as vuln, case when records >= min_records then cast(floor(0.15 * (case when denominator > 0 then coalesce(matches, 0) / denominator else 0.0 end) * 1e6 + 0.5) as bigint) end as rec
    from measures m cross join units s join cells c on c.unit_id = s.unit_id and c.dimension_id = m.dimension_id left join coverage v on v.unit_id = s.unit_id left join matches mt on mt.measure_id = m.measure_id and mt.unit_id = s.unit_id cross join model cross join denom where scope <> 'corridor'""", upto("denom"))
def c12_fixed_site_terms(t):
    rows = t.measures.filter("scope <> 'corridor'").join(t.cells(), "dimension_id").join(t.coverage(), "unit_id").join(t.matches(), ["measure_id", "unit_id"], "left").crossJoin(t.model).crossJoin(t.denominator())
    share = F.when(F.col("denominator") > 0, F.coalesce("matches", F.lit(0)) / F.col("denominator")).otherwise(0.0)
    return rows.select("measure_id", F.col("unit_id").alias("site"), C.micro(F.lit(0.7) * C.class_score(F.col("class_no"))).alias("vuln"), F.when(F.col("records") >= F.col("min_records"), C.micro(F.lit(0.15) * share)).alias("rec"))


@query("""select m.measure_id, case when m.dimension_id = 'FURNITURE' and (bool_or(unit_id = 3) or any_value(scope) = 'corridor') then cast(floor(0.7 * (least(1.0, (max(class_no) + 1) / 5.0) - max(class_no) / 5.0) * 1e6 + 0.5) as bigint) else 0 end as urgency_micro
    from placed p join measures m using (measure_id) group by m.measure_id, m.dimension_id""", upto("placed"))
def c13_urgency_term(t):
    return C.urgency_term(t.placed(), t.measures, 3, "FURNITURE", 0.7)


@query("select lever, count(*) as n_cells, count(*) filter (where needed is not null and lever <> 'S+CA' and lever <> needed) as n_mismatch from measures m join profiles f on m.dimension_id = f.dimension_id group by all", upto("profiles"))
def c14_mismatch_cells(t):
    rows = t.profiles().join(F.broadcast(t.measures.select("dimension_id", "lever")), "dimension_id")
    wrong = F.col("needed").isNotNull() & (F.col("lever") != "S+CA") & (F.col("lever") != F.col("needed"))
    return rows.groupBy("lever").agg(F.count("*").alias("n_cells"), F.count_if(wrong).alias("n_mismatch"))
