"""Bindings from the driver's tables to the model's tables.

Each binding is one SELECT in the SQL that Spark and DuckDB share, over base tables and earlier bindings. Spark reads
only the files that a binding needs; the texts also serve as common table expressions of the oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

_SEGMENT = "case {x} % 5 when 0 then 'AUTOMOBILE' when 1 then 'BUILDING' when 2 then 'FURNITURE' when 3 then 'HOUSEHOLD' else 'MACHINERY' end"


def segment(x: str) -> str:
    """The dimension of a whole-number expression."""
    return _SEGMENT.replace("{x}", x)


def stratum(a: int, b: int) -> str:
    """A point of a Latin hypercube column: the stratum is an affine bijection of the world's number."""
    return f"(cast(({a} * world_id + {b}) % n as double) + 0.5e0) / n"


#: Parameters that information could settle, by the remainder of a number.
PARAMETERS = ("w_vuln", "penalty", "gamma", "cob_w")


def parameter(x: str) -> str:
    """The parameter of a whole-number expression."""
    return f"case {x} % 4 " + " ".join(f"when {k} then '{p}'" for k, p in enumerate(PARAMETERS)) + " end"


def thousands(x: str) -> str:
    """A whole number below a million with a point for thousands."""
    return f"concat(cast(floor(({x}) / 1000) as bigint), '.', lpad(cast(({x}) % 1000 as string), 3, '0'))"


_TOTAL, _TENTHS = "cast(round(o_totalprice) as bigint) + case when o_orderkey % 5 = 0 then 7 else 0 end", "cast(round(o_totalprice / 1000) as bigint)"
_NOTED = "(o_orderkey % 900000 + 1234)"

BINDINGS = {
    "units": "select n_nationkey as unit_id, n_name as unit_name, n_regionkey as region_id from nation",
    "dims": f"select {segment('n_nationkey')} as dimension_id, n_nationkey as dim_no from nation where n_nationkey < 5",
    "measures": f"""select concat('m', p_partkey) as measure_id, cast(p_partkey as int) as measure_no, {segment('p_partkey')} as dimension_id, cast(p_size as bigint) * 10 as cost,
        case when p_partkey % 4 = 3 then 'corridor' else 'municipality' end as scope,
        case p_partkey % 4 when 0 then 'NBS_DIRECT' when 1 then 'NBS_HYBRID' when 2 then 'GREY_INFRASTRUCTURE' else 'ENABLING' end as nbs_class,
        case p_partkey % 3 when 0 then 'S' when 1 then 'CA' else 'S+CA' end as lever,
        case when p_partkey % 2 = 0 then {segment('(p_partkey + 1)')} end as cob_dim from part where p_partkey < 10""",
    "metric_rows": """select c_custkey as row_no, c_nationkey as unit_id, c_mktsegment as dimension_id, case when c_custkey % 3 <> 0 then c_acctbal / 10000 end as value,
        case when c_custkey % 5 <> 0 then greatest(1, least(5, cast(floor(c_acctbal / 2430) as int) + 1) - case c_mktsegment when 'BUILDING' then 1 when 'FURNITURE' then 2 when 'MACHINERY' then 1 else 0 end) end as class_no from customer""",
    "capacity_rows": f"""select s_suppkey as row_no, s_nationkey as unit_id, {segment('s_suppkey')} as dimension_id, case when s_suppkey % 4 <> 0 then s_acctbal end as value from supplier
        union all select c_custkey + 1000000 as row_no, c_nationkey as unit_id, c_mktsegment as dimension_id, case when c_nationkey % 11 <> 1 then floor(c_acctbal / 500) end as value from customer""",
    "records": """select o_orderkey as record_id, c_nationkey as unit_id, case when o_orderkey % 7 < 3 then concat('m', o_orderkey % 10) end as measure_id,
        case when o_orderstatus <> 'P' then cast(floor(o_totalprice) as bigint) end as investment, o_orderpriority as label, year(o_orderdate) as yr, o_orderstatus as plan from orders join customer on o_custkey = c_custkey""",
    "model": "select cast(floor(count(*) / 28) as bigint) as min_records from orders",
    "fund": "select cast(floor(sum(cost) * 4 / 10) as bigint) as budget from measures",
    "readings": """select n_nationkey as unit_id, dimension_id, case when (n_nationkey + dim_no) % 3 = 0 then null else (n_nationkey * 3 + dim_no) % 5 + 1 end as s_level,
        case when (n_nationkey + dim_no) % 4 = 0 then null else (n_nationkey + dim_no) % 3 + 1 end as ca_level from nation cross join dims where (n_nationkey + dim_no) % 5 <> 0""",
    # the grid's own readings, whose levels meet every profile
    "grid_readings": """select n_nationkey as unit_id, dimension_id, case when (n_nationkey + dim_no) % 3 = 0 then null else (n_nationkey * 2 + dim_no) % 5 + 1 end as s_level,
        case when (n_nationkey + dim_no) % 4 = 0 then null else (n_nationkey + dim_no * 3) % 3 + 1 end as ca_level from nation cross join dims where (n_nationkey + dim_no) % 5 <> 0""",
    "gaps": "select concat('gap', s_suppkey) as gap_id, s_suppkey as gap_no, case s_suppkey % 3 when 0 then 'dependency' when 1 then 'site' else 'model' end as kind from supplier",
    "gap_measures": "select distinct gap_id, measure_id from (select gap_id, gap_no % 10 as m from gaps union all select gap_id, (gap_no * 7 + 3) % 10 as m from gaps) g join measures on m = measure_no",
    "spec_gaps": f"select {parameter('s_nationkey')} as parameter, concat('gap', s_suppkey) as gap_id from supplier where s_acctbal < 5000",
    "params": """select case r_regionkey when 0 then 'q' when 1 then 'd' when 2 then 'x' when 3 then 'p' else 'none' end as name, r_regionkey as param_no,
        case r_regionkey when 1 then 'exploratory' when 2 then 'assumption' else 'institutional' end as evidence from region""",
    "param_gaps": "select name, concat('gap', n_nationkey % 7) as gap_id, n_nationkey as gap_no from nation join params on n_regionkey = param_no",
    "outputs": f"""select concat('run', o_custkey % 40) as run, case o_custkey % 3 when 0 then 'find' when 1 then 'compare' else 'simulate' end as tool, concat('fp', o_custkey) as fingerprint, o_custkey % 4 as label_no,
        concat('{{"orders": [', string_agg(concat('{{"key": ', o_orderkey, ', "total": ', o_totalprice, ', "share": ', o_totalprice / 1000000, ', "note": "balance of ', {thousands(_NOTED)}, ',5 left", "open": true, "next": null}}'), ', '), '], "summary": {{"sizes": [', count(*), ', [0.25]]}}}}') as result from orders group by o_custkey""",
    "claims": f"""select concat('prod', o_custkey % 50) as product, o_orderkey as claim, o_custkey, o_totalprice, {thousands(_TOTAL)} as shown1, {_TOTAL} as value1, concat(cast(floor(({_TENTHS}) / 10) as bigint), ',', ({_TENTHS}) % 10, ' %') as shown2, ({_TENTHS}) / 10 as value2,
        case when o_orderkey % 13 = 0 then null when o_orderkey % 11 = 0 then concat('zz', o_custkey) when o_orderkey % 17 = 0 then 'fixture-1' else concat('fp', o_custkey) end as fingerprint,
        case when o_orderkey % 13 = 0 and o_orderkey % 2 = 0 then concat('src', o_custkey % 30) when o_orderkey % 12 = 5 then concat('gis-', o_custkey % 30) end as source_id,
        case o_orderkey % 4 when 1 then o_totalprice when 3 then o_totalprice + 0.2e0 end as stated1, case when o_orderkey % 2 = 1 then o_totalprice / 1000000 end as stated2,
        case o_orderkey % 5 when 0 then null when 1 then 'Institutional' when 2 then 'Exploratory' when 3 then 'guess' else 'Assumption' end as label, case when o_orderkey % 19 = 0 then 'synthetic_demo' end as provenance,
        case o_orderkey % 23 when 3 then ' on a synthetic site' when 7 then ' at this site by Acme Ltd' when 11 then ' and it is guaranteed' else '' end as tail from orders""",
    "claim_texts": "select *, concat('The total was ', shown1, ' and its part ', shown2, ' in 2024', tail) as text from claims",
    "source_list": "select concat('src', n_nationkey) as source_id, case n_nationkey % 3 when 0 then 'official' else 'press' end as kind from nation union all select concat('gis-', n_nationkey) as source_id, 'official' as kind from nation",
    "worlds": f"""select world_id, scenario, 0.1e0 + 0.8e0 * {stratum(7919, 3)} as w_vuln, 0.6e0 * {stratum(6607, 11)} as w_rec, case when {stratum(5417, 29)} < 0.5e0 then 1 else 2 end as gamma,
        {stratum(4409, 5)} as penalty, 0.5e0 * {stratum(3301, 17)} as cob_w, 0.5e0 + 0.5e0 * {stratum(2207, 23)} as mismatch_w, {stratum(1103, 41)} as u_eff, {stratum(9001, 7)} as u_dim
        from (select event_id as world_id, cast(event_id % 2 as int) as scenario from events) e cross join (select count(*) as n from events) c""",
}


def needs(sql: str) -> list[str]:
    """The bindings that a text uses, in the order of definition."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name, body in BINDINGS.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(body)

    visit(sql)
    return [x for x in BINDINGS if x in wanted]


def oracle(sql: str, ctes: dict[str, str] | None = None) -> str:
    """A DuckDB query over bindings: the bindings used and further expressions go in front."""
    extra = ctes or {}
    used = needs(sql + " ".join(extra.values()))
    parts = [f"{name} as ({BINDINGS[name]})" for name in used] + [f"{name} as materialized ({body})" for name, body in extra.items()]
    return (f"with {', '.join(parts)} " if parts else "") + sql


class Tables:
    """The bound tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in BINDINGS:
            raise AttributeError(name)
        sql = oracle(f"select * from {name}").replace("{", "{{").replace("}", "}}")  # braces of JSON texts
        used = [t for t in BASE if re.search(rf"(?:from|join) {t}\b", sql)]
        for t in used:
            sql = re.sub(rf"(from|join) {t}\b", rf"\1 {{{t}}} {t}", sql)
        return self.spark.sql(sql, **{t: self.base(t) for t in used})
