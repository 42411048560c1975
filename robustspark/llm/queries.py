"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustspark.llm import bpe, chunking, decontaminate, html, jaccard, lm, media, negatives, pii, quality, suffix, toxicity, trie
from robustspark.llm.common import read_table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(read_table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"), keep_media=False)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(read_table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_dedup(read_table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_columns(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), keep_ids=False)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.rebuilt(read_table(spark, sf_dir, "conversations")))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), label=moved)


OPERATORS = (
    op1_quality, op2_pii, op3_jaccard, op4_decontaminate, op5_media, op6_main_text, op7_suffix_dedup, op8_chunk_dedup, op9_lm_scores, op10_bpe,
    op11_prefix_trie, op12_toxicity, op13_hard_negatives,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

ORACLES: dict[str, str] = {
    "op11_prefix_trie": """with turns as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as p, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        convs as (select conv_id, count(*) as n, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda s, c:
            list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) as s from turns group by conv_id),
        heads as (select conv_id, xor(s, 4294967295) % 6 as h from convs),
        rebuilt as (select conv_id, p as k, role, text from (select c.conv_id, t.p, t.role, t.text from heads c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.p <= c.h)
            union all select t.conv_id, t.p + 10, t.role, t.text from turns t join heads c on t.conv_id = c.conv_id and t.p > c.h),
        placed as (select conv_id, row_number() over (partition by conv_id order by k) as d, role, text from rebuilt),
        paths as (select h.conv_id, coalesce(list(struct_pack(role, text) order by d) filter (where d is not null), []) as path from heads h left join placed p on h.conv_id = p.conv_id group by h.conv_id),
        members as (select conv_id, unnest(range(0, len(path) + 1)) as depth, path from paths),
        nodes as (select path[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(case when len(path) = depth then conv_id::varchar end, ',' order by conv_id), '') as ends from members group by all),
        valued as (select n.*, (select count(*) from nodes c where c.depth = n.depth + 1 and c.node[1:n.depth] = n.node) as n_children, case when depth > 0 then (n_convs - 1) * length(node[depth].text) else 0 end as saved from nodes n)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children,
        (select count(*) from valued v where v.node[1:n.depth] = n.node and v.n_children = 0) as n_leaves, (select cast(sum(v.saved) as bigint) from valued v where v.node[1:n.depth] = n.node) as saved_tokens, sha256(n.ends) as ends_sha256
        from valued n left join nodes p on p.depth = n.depth - 1 and p.node = n.node[1:p.depth]""",
    "op13_hard_negatives": """with rows_ as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.q, r.q) as bigint) as score from rows_ a join rows_ r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
        positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
        from positives join scored using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score qualify rank <= 3""",
}
