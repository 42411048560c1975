"""Registered queries on the evidence audit and on spatial features, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustspark.operators import audit as A
from robustspark.operators import spatial as S
from robustspark.plans import cells, tables

QUERIES, ORACLES = {}, {}


def query(sql=None, ctes=None):
    return cells.query(sql, ctes, into=(QUERIES, ORACLES))


#: Wording rules and question classes.
FORBIDDEN = {"rights": "(?i)all rights reserved", "secret": "(?i)(token|password) ?=", "license": "(?i)licensed under"}
ROUTES = {"forbidden": "(?i)(token|password)", "write": "(?i)(mail[0-9]|@)", "location": "[0-9]+[.][0-9]+[.][0-9]+"}


@query()
def e1_extract_numbers(t):
    rows = t.documents.select("doc_id", F.posexplode(A.numbers(F.col("text"))).alias("pos", "raw"))
    return rows.select("doc_id", "pos", "raw", A.number_value(F.col("raw")).alias("value"))


@query("select c_custkey, abs(abs(round(c_acctbal, 0)) - abs(c_acctbal + 0.3e0)) <= 0.5e0 + 1e-9 or abs(abs(round(c_acctbal, 0)) - abs((c_acctbal + 0.3e0) * 100)) <= 0.5e0 + 1e-9 as shown from customer")
def e2_displays_as(t):
    return t.customer.select("c_custkey", A.displays_as(F.round("c_acctbal", 0), F.lit(0), F.col("c_acctbal") + 0.3).alias("shown"))


@query("select event_id, 'k' as path, cast(props->>'k' as double) as value from events")
def e3_json_leaves(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string, double>")).alias("path", "value"))


@query("select o_orderkey, bool_or(p.cents is not null) as found from (select o_orderkey, o_custkey, cast(floor(o_totalprice / 1000) as bigint) as shown from orders) c left join (select distinct o_custkey as fp, cast(floor(o_totalprice / 1000) as bigint) as cents from orders where o_orderkey % 3 = 0) p on c.o_custkey = p.fp and c.shown = p.cents group by all")
def e4_claim_numbers(t):
    value = F.floor(F.col("o_totalprice") / 1000).cast("long")
    claims = t.orders.select("o_orderkey", "o_custkey", value.alias("shown"))
    pool = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("fp"), value.alias("cents")).distinct()
    rows = claims.join(pool, (F.col("o_custkey") == F.col("fp")) & (F.col("shown") == F.col("cents")), "left")
    return rows.groupBy("o_orderkey").agg(F.bool_or(F.col("cents").isNotNull()).alias("found"))


_FINDINGS = {"findings": """select doc_id, source as bundle, severity, check_name from documents d left join (select n_nationkey, concat('src', n_nationkey) as s from nation where n_nationkey < 15) k on d.source = k.s
    cross join (values ('critical', 'source unknown'), ('warning', 'label missing'), ('critical', 'too short')) v(severity, check_name) where (check_name = 'source unknown' and s is null) or (check_name = 'label missing' and lang <> 'en') or (check_name = 'too short' and n_chars < 200)"""}


def findings(t):
    known = F.broadcast(t.nation.filter("n_nationkey < 15").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("s")))
    rows = t.documents.join(known, F.col("source") == F.col("s"), "left")
    rule = lambda ok, severity, name: F.when(ok, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("check_name")))
    found = F.filter(F.array(rule(F.col("s").isNull(), "critical", "source unknown"), rule(F.col("lang") != "en", "warning", "label missing"), rule(F.col("n_chars") < 200, "critical", "too short")), lambda x: x.isNotNull())
    return rows.select("doc_id", F.col("source").alias("bundle"), F.inline(found))


@query("select * from findings", _FINDINGS)
def e5_claim_rules(t):
    return findings(t)


@query(" union all ".join(f"select doc_id, '{k}' as rule, regexp_extract(text, '{v}', 0) as quote from documents where regexp_matches(text, '{v}')" for k, v in FORBIDDEN.items()))
def e6_forbidden_claims(t):
    quotes = F.array(*(F.struct(F.lit(k).alias("rule"), F.regexp_extract("text", v, 0).alias("quote")) for k, v in FORBIDDEN.items()))
    return t.documents.select("doc_id", F.inline(quotes)).filter("quote <> ''")


@query("select conv_id, turn, case " + " ".join(f"when regexp_matches(text, '{v}') then '{k}'" for k, v in ROUTES.items()) + " else 'other' end as route from conversations")
def e7_route_question(t):
    return t.conversations.select("conv_id", "turn", A.first_route(F.col("text"), ROUTES).alias("route"))


@query("select b.source as bundle, count(*) filter (where severity = 'critical') as critical, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'critical') = 0 as export_allowed from (select distinct source from documents) b left join findings f on f.bundle = b.source group by all", _FINDINGS)
def e8_audit_summary(t):
    return A.summary(findings(t), t.documents.withColumnRenamed("source", "bundle"))


@query("select conv_id, turn, len(string_split_regex(trim(text), '[ \\n]+')) <= 120 as short_enough, strpos(text, '@') > 0 as has_address from conversations where role = 'assistant'")
def e9_verify_answer(t):
    rows = t.conversations.filter("role = 'assistant'")
    return rows.select("conv_id", "turn", (F.size(F.split(F.trim("text"), "[ \\n]+")) <= 120).alias("short_enough"), F.contains("text", F.lit("@")).alias("has_address"))


@query("select q.conv_id, q.turn, a.turn as answer_turn from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where strpos(a.text, substr(q.text, 1, 4)) > 0 and length(q.text) >= 4")
def e10_verbatim_filter(t):
    q = t.conversations.select("conv_id", "turn", F.substring("text", 1, 4).alias("quote"), F.length("text").alias("size"))
    a = t.conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("answer_turn"), F.col("text").alias("answer"))
    return q.join(a, (F.col("conv_id") == F.col("c")) & (F.col("answer_turn") == F.col("turn") + 1)).filter(F.contains("answer", F.col("quote")) & (F.col("size") >= 4)).select("conv_id", "turn", "answer_turn")


@query("select doc_id, case when strpos(lower(text), lower(concat('the ', lang))) > 0 then lang end as grounded from documents")
def e11_grounded_values(t):
    return t.documents.select("doc_id", F.when(F.contains(F.lower("text"), F.lower(F.concat(F.lit("the "), "lang"))), F.col("lang")).alias("grounded"))


#: The first word of what a user says stands for a finding's quote and for an extracted value.
_FIRST = {"asked": "select conv_id, turn, regexp_extract(text, '^[^ \\n]+') as word from conversations where role = 'user'"}


def asked(t):
    return t.conversations.filter("role = 'user'").select("conv_id", "turn", F.regexp_extract("text", "^[^ \\n]+", 0).alias("word"))


@query("select q.conv_id, q.turn, q.word, min(a.turn) as claim_turn from asked q join conversations a on a.conv_id = q.conv_id and a.role = 'assistant' where length(word) >= 4 and strpos(a.text, word) > 0 group by all", _FIRST)
def e10_verbatim_quotes(t):
    findings = asked(t).select(F.col("conv_id").alias("bundle"), F.col("turn").alias("finding"), F.col("word").alias("quote"))
    claims = t.conversations.filter("role = 'assistant'").select(F.col("conv_id").alias("bundle"), F.col("turn").alias("position"), "text")
    return A.verbatim(findings, claims).select(F.col("bundle").alias("conv_id"), F.col("finding").alias("turn"), F.col("quote").alias("word"), F.col("claim").alias("claim_turn"))


@query(f"select conv_id, turn, case when folded <> '' and contains(answer, folded) then word end as grounded from (select q.conv_id, q.turn, word, {tables.folded_sql('word')} as folded, {tables.folded_sql('a.text')} as answer from asked q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1)", _FIRST)
def e11_grounded_words(t):
    answers = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), tables.fold(F.col("text")).alias("answer"))
    rows = asked(t).join(answers, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", A.grounded(F.col("word"), tables.fold(F.col("word")), F.col("answer")).alias("grounded"))


@query("select doc_id, regexp_matches(text, '[0-9]{16}') as has_number, regexp_matches(text, 'AKIA[A-Z0-9]{16}') as has_key from documents")
def e12_identity_filter(t):
    return t.documents.select("doc_id", F.col("text").rlike("[0-9]{16}").alias("has_number"), F.col("text").rlike("AKIA[A-Z0-9]{16}").alias("has_key"))


@query("select event_type, count(*) as n, count(*) filter (where value is null or value <= 5) as failures from events group by all")
def e13_grade_runs(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull() | (F.col("value") <= 5)).alias("failures"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, sha256(props) as digest from events")
def e14_log_records(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.sha2("props", 256).alias("digest"))


_SQUARE = {"polys": "select s_suppkey as polygon_id, cast(s_suppkey % 10 * 10 as double) as x0, cast(s_suppkey // 10 % 10 * 10 as double) as y0, cast(4 + s_suppkey % 5 as double) as side, s_suppkey % 2 as turned from supplier"}


def polygons(t):
    """A square per supplier, every other one turned the other way."""
    x, y, side = ((F.col("s_suppkey") % 10) * 10).cast("double"), (F.floor(F.col("s_suppkey") / 10) % 10 * 10).cast("double"), (4 + F.col("s_suppkey") % 5).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    one, two = F.array(p(x, y), p(x + side, y), p(x + side, y + side), p(x, y + side), p(x, y)), F.array(p(x, y), p(x, y + side), p(x + side, y + side), p(x + side, y), p(x, y))
    return t.supplier.select(F.col("s_suppkey").alias("polygon_id"), F.when(F.col("s_suppkey") % 2 == 0, one).otherwise(two).alias("ring"))


@query("select polygon_id, case when turned = 0 then 2 else -2 end * side * side as area2 from polys", _SQUARE)
def g1_signed_area(t):
    return polygons(t).select("polygon_id", S.signed_area(F.col("ring")).alias("area2"))


@query("select polygon_id, case when turned = 0 then 'hole' else 'shell' end as kind from polys", _SQUARE)
def g2_ring_kind(t):
    return polygons(t).filter(F.size("ring") >= 4).select("polygon_id", F.when(S.signed_area(F.col("ring")) < 0, "shell").otherwise("hole").alias("kind"))


@query("select polygon_id, x0, y0, x0 + side as x1, y0 + side as y1 from polys where x0 <= 45 and x0 + side >= 15 and y0 <= 75 and y0 + side >= 25", _SQUARE)
def g3_bounds_filter(t):
    rows = polygons(t).select("polygon_id", S.bounds(F.col("ring")).alias("b")).select("polygon_id", "b.*")
    return rows.filter("x0 <= 45 and x1 >= 15 and y0 <= 75 and y1 >= 25")


@query("select c_custkey as point_id, polygon_id from (select c_custkey, c_custkey % 97 + 0.25e0 as x, c_custkey % 89 + 0.25e0 as y from customer) join polys on x > x0 and x < x0 + side and y > y0 and y < y0 + side", _SQUARE)
def g4_point_in_polygon(t):
    points = t.customer.select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 97 + 0.25).alias("x"), (F.col("c_custkey") % 89 + 0.25).alias("y"))
    return S.points_in_polygons(points, polygons(t), 10.0)


@query("select p_partkey, coalesce(nullif(case when p_partkey % 3 = 0 then '' else p_name end, ''), p_type) as name from part")
def g5_clean_properties(t):
    name = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.coalesce(F.nullif(name, F.lit("")), "p_type").alias("name"))


@query("select o_orderkey, case when contains(o_orderpriority, 'URGENT') then 4 when contains(o_orderpriority, 'HIGH') then 3 when contains(o_orderpriority, 'MEDIUM') then 2 when contains(o_orderpriority, 'LOW') then 1 end as threat from orders")
def g6_threat_class(t):
    out = F.lit(None).cast("int")
    for word, k in (("LOW", 1), ("MEDIUM", 2), ("HIGH", 3), ("URGENT", 4)):
        out = F.when(F.contains("o_orderpriority", F.lit(word)), k).otherwise(out)
    return t.orders.select("o_orderkey", out.alias("threat"))


@query("select side, count(*) as n, sum(side * side) as area, max(polygon_id) as last_id from polys group by all", _SQUARE)
def g7_dissolve_by_class(t):
    rows = polygons(t).select("polygon_id", F.abs(S.signed_area(F.col("ring"))).alias("a2"))
    return rows.groupBy(F.sqrt(F.col("a2") / 2).alias("side")).agg(F.count("*").alias("n"), F.sum(F.col("a2") / 2).alias("area"), F.max("polygon_id").alias("last_id"))


@query("select measure_id, u.unit_id, unit_name from measures m join cells c on c.dimension_id = m.dimension_id join units u on u.unit_id = c.unit_id where class_no = 5", {"cells": cells.CTES["cells"]})
def g8_layer_context(t):
    rows = t.cells().filter("class_no = 5").join(F.broadcast(t.measures.select("measure_id", "dimension_id")), "dimension_id")
    return rows.join(F.broadcast(t.units.select("unit_id", "unit_name")), "unit_id").select("measure_id", "unit_id", "unit_name")
