"""Registered queries on sources, table checks and text matching, with their SQL twins."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from robustspark.operators import audit as A
from robustspark.operators import tables as T
from robustspark.plans import cells

QUERIES, ORACLES = {}, {}


def query(sql=None, ctes=None):
    return cells.query(sql, ctes, into=(QUERIES, ORACLES))


@query("select event_id, cast(props->>'k' as bigint) as k from events")
def q1_read_bundle(t):
    return t.events.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("select unit_id, count(*) as n, count(investment) as n_invested from records group by all")
def q2_read_history(t):
    rows = T.require_columns(t.records, ["record_id", "unit_id", "investment"])
    return rows.groupBy("unit_id").agg(F.count("*").alias("n"), F.count("investment").alias("n_invested"))


@query("select s_suppkey as feature_id, s_name as name, n_name as unit_name from supplier join nation on s_nationkey = n_nationkey where s_nationkey < 20")
def q3_read_features(t):
    point = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("code")).alias("properties"))
    collections = t.supplier.groupBy(F.floor(F.col("s_suppkey") / 50).alias("file")).agg(F.to_json(F.struct(F.collect_list(point).alias("features"))).alias("text"))
    schema = "struct<features: array<struct<type: string, properties: struct<id: bigint, name: string, code: int>>>>"
    rows = collections.select(F.explode(F.from_json("text", schema)["features"]).alias("f")).select(F.col("f.properties.id").alias("feature_id"), F.col("f.properties.name").alias("name"), F.col("f.properties.code").alias("code"))
    known = t.nation.filter("n_nationkey < 20").select("n_nationkey", F.col("n_name").alias("unit_name"))
    return rows.join(F.broadcast(known), F.col("code") == F.col("n_nationkey")).select("feature_id", "name", "unit_name")


@query("select event_id, case when event_id % 5 = 0 then null else round(value / 7, 6) + 0.0 end as v from events")
def q4_write_results(t):
    raw = t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value") / 7).alias("v"))
    return T.cleaned(raw)


_STORED = "select o_orderkey as k, case when o_orderkey % 50 = 0 then 'X' else o_orderstatus end as v from orders where o_orderkey % 40 <> 7"


@query(f"select coalesce(a.k, b.k) as k from (select o_orderkey as k, o_orderstatus as v from orders) a full join ({_STORED}) b on a.k = b.k where a.v is distinct from b.v")
def q5_check_outputs(t):
    fresh = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    stored = fresh.filter("k % 40 <> 7").withColumn("v", F.when(F.col("k") % 50 == 0, "X").otherwise(F.col("v")))
    return T.difference(fresh, stored, "k", "v").select("k")


@query(r"select doc_id, strlen(replace(text, chr(13) || chr(10), chr(10))) as bytes, sha256(replace(text, chr(13) || chr(10), chr(10))) as digest from documents")
def q6_file_inventory(t):
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return t.documents.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("digest"))


@query(f"select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as status from (select o_orderkey as k, o_orderstatus as v from orders where o_orderkey % 30 <> 1) a full join ({_STORED}) b on a.k = b.k where a.k is null or b.k is null or a.v is distinct from b.v")
def q7_inventory_diff(t):
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    right = base.filter("k % 40 <> 7").withColumn("v", F.when(F.col("k") % 50 == 0, "X").otherwise(F.col("v")))
    return T.difference(base.filter("k % 30 <> 1"), right, "k", "v")


@query("select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by all having count(*) > 1")
def q8_duplicate_content(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(" union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as n_null, count(*) as n_rows from metric_rows" for c in ("row_no", "unit_id", "dimension_id", "value", "class_no")))
def q9_profile_nulls(t):
    return T.profile_nulls(t.metric_rows)


@query("select c_custkey as row_id, rule from customer cross join (values ('balance'), ('segment'), ('name')) v(rule) where (rule = 'balance' and not (c_acctbal between 0 and 9000)) or (rule = 'segment' and c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD')) or (rule = 'name' and length(c_name) <> 18)")
def q10_validate_domain(t):
    rules = {"balance": F.col("c_acctbal").between(0, 9000), "segment": F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"), "name": F.length("c_name") == 18}
    return T.violations(t.customer, "c_custkey", rules)


@query("select o_custkey, o_orderstatus, count(*) as n from orders group by all having count(*) > 1")
def q11_validate_unique(t):
    return T.duplicate_keys(t.orders, ["o_custkey", "o_orderstatus"])


@query("select o_orderstatus, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as total, sum(cast(floor(o_totalprice) as bigint)) > 1000000 as over_budget from orders group by all")
def q12_validate_totals(t):
    total = F.sum(F.floor("o_totalprice").cast("long"))
    return t.orders.groupBy("o_orderstatus").agg(total.alias("total"), (total > 1000000).alias("over_budget"))


@query("select distinct l_partkey as value from lineitem where l_partkey not in (select p_partkey from part where p_partkey % 9 <> 4)")
def q13_validate_refs(t):
    return T.missing_references(t.lineitem, "l_partkey", t.part.filter("p_partkey % 9 <> 4"), "p_partkey")


@query("select p_partkey as k, p_name as v from part where p_partkey % 4 <> 0 union all select p_partkey * 2 as k, p_brand as v from part where p_partkey % 2 = 0")
def q14_merge_registry(t):
    old = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    new = t.part.filter("p_partkey % 2 = 0").select((F.col("p_partkey") * 2).alias("k"), F.col("p_brand").alias("v"))
    return T.merged(old, new, "k")


#: Patterns that must not appear in published text.
BANNED = {"mail": "[a-z0-9.]+@[a-z0-9.]+", "key": "(token|password) ?=", "shout": "[A-Z]{6,}!!", "rights": "All rights reserved"}


@query(" union all ".join(f"select doc_id, '{k}' as pattern_id from documents where regexp_matches(text, '{v}')" for k, v in BANNED.items()))
def q15_banned_pattern_scan(t):
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(v), F.lit(k)) for k, v in BANNED.items())), lambda x: x.isNotNull())
    return t.documents.select("doc_id", F.explode(hits).alias("pattern_id"))


_MARKS = ("áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")


def folded_sql(text: str) -> str:
    return f"trim(regexp_replace(translate(lower({text}), '{_MARKS[0]}', '{_MARKS[1]}'), '[ \\t\\n\\r]+', ' ', 'g'))"


_FOLD = folded_sql("text")


def fold(text):
    """Lower case, without accents, single spaces: built-in, for the letters listed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), *_MARKS), "[ \\t\\n\\r]+", " "))


@query(f"select doc_id, sha256({_FOLD}) as folded from documents")
def t1_fold_text(t):
    return t.documents.select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded"))


#: Phrases of each catalogue id.
PHRASES = {"a": ["the er", "of the"], "b": ["de la", "que la"], "c": ["und der", "der die"], "d": ["licensed under", "all rights"]}


@query(f"select doc_id, case when len(ids) = 1 then ids[1] end as matched from (select doc_id, list_filter([{', '.join(f'''case when {' or '.join(f"contains(folded, '{p}')" for p in ps)} then '{k}' end''' for k, ps in PHRASES.items())}], lambda x: x is not null) as ids from (select doc_id, {_FOLD} as folded from documents))")
def t2_match_phrases(t):
    rows = t.documents.select("doc_id", fold(F.col("text")).alias("folded"))
    found = []
    for k, ps in PHRASES.items():
        hit = F.lit(False)
        for p in ps:
            hit = hit | F.contains("folded", F.lit(p))
        found.append(F.when(hit, F.lit(k)))
    ids = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select("doc_id", ids.alias("ids")).select("doc_id", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("matched"))


@query("select c_custkey, unit_id, unit_id is not null as in_scope from (select c_custkey, lower(n_name) as folded from customer join nation on c_nationkey = n_nationkey) left join (select lower(unit_name) as f, unit_id from units where unit_id % 3 <> 0) on folded = f")
def t3_scope_records(t):
    named = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("folded"))
    scope = F.broadcast(t.units.filter("unit_id % 3 <> 0").select(F.lower("unit_name").alias("f"), "unit_id"))
    return named.join(scope, F.col("folded") == F.col("f"), "left").select("c_custkey", "unit_id", F.col("unit_id").isNotNull().alias("in_scope"))


@query("select u.unit_id, count(record_id) as n, cast(sum(investment) as bigint) as invested, count(record_id) - count(investment) as n_null, count(*) filter (where label = '1-URGENT') as n_urgent, count(*) filter (where label = '5-LOW') as n_low from units u left join records r on u.unit_id = r.unit_id group by all")
def t4_coverage(t):
    counts = t.records.groupBy("unit_id").agg(F.count("*").alias("n"), F.sum("investment").alias("invested"), F.count_if(F.col("investment").isNull()).alias("n_null"), F.count_if(F.col("label") == "1-URGENT").alias("n_urgent"), F.count_if(F.col("label") == "5-LOW").alias("n_low"))
    rows = t.units.select("unit_id").join(counts, "unit_id", "left")
    return rows.select("unit_id", "invested", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_null", "n_urgent", "n_low")))


@query("select unit_id, measure_id, count(*) as n, array_to_string(list_sort(list_distinct(list(yr))), ',') as years, array_to_string(list_sort(list_distinct(list(plan))), ',') as plans, arg_min(label, record_id) as sample from records where measure_id is not null group by all")
def t5_match_summary(t):
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    years = F.array_join(F.transform(F.sort_array(F.collect_set("yr")), lambda x: x.cast("string")), ",")
    return t.records.filter("measure_id is not null").groupBy("unit_id", "measure_id").agg(F.count("*").alias("n"), years.alias("years"), joined("plan").alias("plans"), F.min_by("label", "record_id").alias("sample"))


@query("select denominator from denom", {k: cells.CTES[k] for k in ("coverage", "matches", "denom")})
def t6_max_adequate_count(t):
    return t.denominator()


@query("select doc_id, line_no, row_number() over (partition by doc_id order by line_no) as running from (select doc_id, line, min(pos) as line_no from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) group by all)")
def t7_indicator_rows(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).groupBy("doc_id", "line").agg(F.min("pos").cast("long").alias("line_no"))
    return lines.select("doc_id", "line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).alias("running"))


#: Needles looked for in every document.
NEEDLES = ("token", "licensed under", "rights reserved")

_AROUND = "trim(regexp_replace(substr(text, greatest(0, place - 90) + 1, place + length(needle) + 140 - greatest(0, place - 90)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(
    f"""select doc_id, needle, len(found) > 0 as found, found[1] as first_excerpt, [x for x in found if x <> found[1]][1] as second_excerpt from (select doc_id, needle, [{_AROUND} for place in places] as found
    from (select doc_id, needle, text, [cast(list_sum([length(p) for p in parts[1:i]]) + (i - 1) * length(needle) as bigint) for i in range(1, len(parts))] as places
    from (select doc_id, needle, coalesce(text, '') as text, string_split_regex(coalesce(text, ''), '(?i)' || needle) as parts from documents cross join (values {', '.join(f"('{x}')" for x in NEEDLES)}) v(needle))))"""
)
def t8_keyword_excerpts(t):
    found = F.array(*(F.struct(F.lit(x).alias("needle"), A.excerpts(F.col("text"), x).alias("excerpts")) for x in NEEDLES))
    rows = t.documents.select("doc_id", F.inline(found))
    return rows.select("doc_id", "needle", (F.size("excerpts") > 0).alias("found"), F.get("excerpts", F.lit(0)).alias("first_excerpt"), F.get("excerpts", F.lit(1)).alias("second_excerpt"))


@query("select doc_id, strpos(lower(text), 'token') > 0 as found, case when strpos(lower(text), 'token') > 0 then substr(text, greatest(1, strpos(lower(text), 'token') - 20), 20 + least(0, strpos(lower(text), 'token') - 21) + 45) end as snippet from documents")
def t8_keyword_windows(t):
    at = F.instr(F.lower("text"), "token")
    snippet = F.when(at > 0, F.substring(F.col("text"), F.greatest(F.lit(1), at - 20), 20 + F.least(F.lit(0), at - 21) + 45))
    return t.documents.select("doc_id", (at > 0).alias("found"), snippet.alias("snippet"))
