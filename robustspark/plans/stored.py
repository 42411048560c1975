"""Registered queries on files, folded texts and assembled polygons, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustspark.operators import spatial as S
from robustspark.operators import tables as T
from robustspark.operators import text as X
from robustspark.plans import cells, tables
from robustspark.sources import files

QUERIES, ORACLES = {}, {}


def query(sql=None, ctes=None):
    return cells.query(sql, ctes, into=(QUERIES, ORACLES))


@query("select region, unit, member, cast(floor(size) as bigint) as size from (select r_regionkey as region, n_nationkey as unit, c_custkey as member, c_acctbal as size from region join nation on r_regionkey = n_regionkey join customer on c_nationkey = n_nationkey)")
def q1_read_nested_files(t):
    """A JSON document a unit, written, read back by its schema, and its inner list unnested."""
    members = t.customer.groupBy(F.col("c_nationkey").alias("unit"), (F.col("c_custkey") % 64).alias("part")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("member"), F.col("c_acctbal").alias("size"))).alias("members"))
    bundle = members.join(t.nation, F.col("unit") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), "unit", F.struct(F.lit(1).alias("version"), "members").alias("payload"))
    back = files.written(bundle, files.scratch(t.spark, "bundle"), "json")
    return back.select("region", "unit", F.inline("payload.members")).select("region", "unit", "member", F.floor("size").cast("long").alias("size"))


@query("select event_id, event_type, case when event_id % 5 = 0 then null else round(value / 7, 6) + 0.0 end as v from events")
def q4_written_results(t):
    """Cleaned results written as JSON and read back; what is not finite comes back as null."""
    broken = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf"))
    raw = t.events.select("event_id", "event_type", broken.otherwise(F.col("value") / 7).alias("v"))
    return files.written(T.cleaned(raw), files.scratch(t.spark, "results"), "json")


@query("select concat('day=', strftime(ts, '%Y-%m-%d'), '/block=', event_id // 1000) as path, cast(sum(strlen(concat(event_id, ':', props, chr(10)))) as bigint) as bytes, sha256(string_agg(concat(event_id, ':', props, chr(10)), '' order by event_id)) as digest from events group by all")
def q6_files_inventory(t):
    """Line files of a day and block of events, written with two-byte line ends and read as bytes."""
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(F.col("event_id") / 1000).alias("block"), F.concat_ws(":", F.col("event_id").cast("string"), "props").alias("line"))
    path = files.scratch(t.spark, "lines")
    rows.repartition("day", "block").sortWithinPartitions("day", "block", "event_id").select("day", "block", "line").write.partitionBy("day", "block").option("lineSep", "\r\n").text(path)
    found = files.inventory(files.binary_files(t.spark, path))
    return found.withColumn("path", F.substring_index("path", "/", 2))


@query("select event_id, strftime(ts, '%Y-%m-%d') as day, sha256(concat('{\"a\": ', event_id, ', \"k\": [', json_extract_string(props, '$.k'), ', {\"x\": \"é\", \"y\": null}]}')) as digest from events")
def e14_logged_calls(t):
    """Calls logged by day: the digest of each output's JSON with its keys in order, written by day and read back."""
    output = F.format_string('{"k": [%s, {"y": null, "x": "é"}], "a": %d}', F.get_json_object("props", "$.k"), F.col("event_id"))
    calls = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.sha2(X.canonical_json(output), 256).alias("digest"))
    return files.written(calls, files.scratch(t.spark, "calls"), "json", ["day"])


@query(f"select doc_id, sha256({tables._FOLD}) as folded, length({tables._FOLD}) as n_chars from documents")
def t1_fold_unicode(t):
    folded = t.documents.select("doc_id", X.folded(F.col("text")).alias("f"))
    return folded.select("doc_id", F.sha2("f", 256).alias("folded"), F.length("f").cast("long").alias("n_chars"))


_RINGS = {
    "feats": "select s_suppkey as f, cast(s_suppkey % 10 * 100 as double) as x, cast(s_suppkey // 10 % 10 * 100 as double) as y, cast(6 + s_suppkey % 5 as double) as s, s_suppkey % 7 = 0 as bare, s_suppkey % 3 = 0 as two from supplier",
    "squares": """select f, 1 as no, x, y, s as side, not bare as shell from feats union all select f, 2, x + 20, y, s / 2, true from feats where two and not bare union all select f, 3, x + 1, y + 1, 1.0, false from feats
        union all select f, 4, x + 20.5, y + 1, 0.5, false from feats union all select f, 6, x + 0.5, y + 3, 0.25, false from feats where f % 2 = 0""",
    "shells": "select * from squares where shell or f in (select f from feats where bare)",
    "held": "select s.f, s.no, string_agg(h.no, ',' order by h.no) as holes from shells s join squares h on h.f = s.f and not h.shell and h.f not in (select f from feats where bare) and h.x >= s.x and h.x + h.side <= s.x + s.side and h.y >= s.y and h.y + h.side <= s.y + s.side group by all",
}


def rings(t):
    """Features of squares: shells clockwise, holes the other way, one ring too short, one outside; some without any shell."""
    k = F.col("s_suppkey")
    x, y, s = ((k % 10) * 100).cast("double"), (F.floor(k / 10) % 10 * 100).cast("double"), (6 + k % 5).cast("double")
    bare, point = k % 7 == 0, lambda a, b: F.struct(a.alias("x"), b.alias("y"))

    def square(x0, y0, side, shell):
        a, b, c, d = point(x0, y0), point(x0, y0 + side), point(x0 + side, y0 + side), point(x0 + side, y0)
        return F.when(shell, F.array(a, b, c, d, a)).otherwise(F.array(a, d, c, b, a))

    no = F.lit(False)
    made = [
        (1, F.lit(True), square(x, y, s, ~bare)), (2, (k % 3 == 0) & ~bare, square(x + 20, y, s / 2, F.lit(True))), (3, F.lit(True), square(x + 1, y + 1, F.lit(1.0), no)),
        (4, F.lit(True), square(x + 20.5, y + 1, F.lit(0.5), no)), (5, F.lit(True), F.array(point(x, y), point(x + 1, y), point(x, y))), (6, k % 2 == 0, square(x + 0.5, y + 3, F.lit(0.25), no)),
    ]
    every = F.filter(F.array(*(F.when(there, F.struct(F.lit(n).alias("ring_no"), ring.alias("ring"))) for n, there, ring in made)), lambda r: r.isNotNull())
    return t.supplier.select(k.alias("feature_id"), F.inline(every))


@query("select s.f as feature_id, s.no as shell_no, s.side * s.side as area, coalesce(holes, '') as holes from shells s left join held using (f, no)", _RINGS)
def g2_assemble_polygons(t):
    polygons = S.assemble_polygons(rings(t))
    return polygons.select("feature_id", "shell_no", (F.abs(S.signed_area(F.col("ring"))) / 2).alias("area"), F.array_join("holes", ",").alias("holes"))
