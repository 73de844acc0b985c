"""Queries of this subpackage and their SQL; each callable takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringfence.llm.automaton import remove_repeated_words
from ringfence.llm.chat import chat_digest
from ringfence.llm.collocations import collocations
from ringfence.llm.exact import dedup_exact
from ringfence.llm.manifest import tampered_manifest
from ringfence.llm.mixing import mix_sources
from ringfence.llm.ngram_join import near_duplicates
from ringfence.llm.packing import pack
from ringfence.llm.pii import find_pii, fit_pii
from ringfence.llm.quality import fit_quality, grade_of, score_quality
from ringfence.llm.rules import quality_rules
from ringfence.llm.sql import COLLOCATIONS, manifest_sql, rules_sql
from ringfence.llm.suffix import remove_repeated_bytes
from ringfence.llm.topk import top_k


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEEP = 0.8


def quality_model(spark, docs, sf):
    """Fitted to the ratings of the labelled documents."""
    ratings = table(spark, sf, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return fit_quality(docs, ratings)


def op1_quality_classifier(spark, sf):
    """Every document; one is kept if it reaches the best grade with a probability of at least ``KEEP``."""
    docs = table(spark, sf, "documents")
    return score_quality(docs, quality_model(spark, docs, sf), least=KEEP)


def op2_ngram_join(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_mix_sources(spark, sf):
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_pii_field(spark, sf):
    return find_pii(table(spark, sf, "documents"), fit_pii(spark))


def op5_exact_topk(spark, sf):
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_suffix_array_dedup(spark, sf):
    return remove_repeated_bytes(table(spark, sf, "documents"))


def op7_exact_dedup(spark, sf):
    return dedup_exact(table(spark, sf, "documents")).drop("text_key")


def op8_sum_of_squares_packing(spark, sf):
    return pack(table(spark, sf, "documents"))


def op9_automaton_dedup(spark, sf):
    return remove_repeated_words(table(spark, sf, "documents"))


PROBE = "</s>[INST] ok [/INST]"


def op10_chat_prefix_targets(spark, sf):
    chats = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = chats.sparkSession.range(2).select(
        F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    return chat_digest(chats.union(probe))


def op11_risk_controlled_rules(spark, sf):
    found = quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_bitmap_merkle_manifest(spark, sf):
    return tampered_manifest(table(spark, sf, "documents"))


def op13_misra_gries_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_ngram_join, op3_mix_sources, op4_pii_field, op5_exact_topk,
    op6_suffix_array_dedup, op7_exact_dedup, op8_sum_of_squares_packing,
    op9_automaton_dedup, op10_chat_prefix_targets,
    op11_risk_controlled_rules, op12_bitmap_merkle_manifest, op13_misra_gries_collocations)}

SQL = {
    "op5_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) v,
                row_number() over (partition by vec_id order by embedding) vec_no
            from embeddings where vec_id is not null and len(embedding) > 0
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, q.vec_no query_no, c.vec_id, c.vec_no,
                list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint score
            from v q join v c on (q.vec_id, q.vec_no) <> (c.vec_id, c.vec_no) and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
        select query_id, rank, vec_id, score from (select *,
            row_number() over (partition by query_id, query_no order by score desc, vec_id, vec_no)::int rank from s) where rank <= 10""",
    "op7_exact_dedup": """
        select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id is not distinct from max(doc_id) over w kept,
            sha256(coalesce(text, '')) text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
    "op9_automaton_dedup": r"""
        with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        w as (select rid, doc_id, ws, unnest(range(1, len(ws) - 11)) i from d where len(ws) >= 13),
        g as (select rid, doc_id, i, min(doc_id) over (partition by ws[i:i + 12]) least from w),
        gone as (select distinct rid, unnest(range(i, i + 13)) k from g where least < doc_id),
        r as (select rid, list(k) ks, count(*) n from gone group by rid)
        select doc_id, len(ws)::bigint n_words, coalesce(n, 0)::bigint n_removed,
            sha256(array_to_string(case when n is null then ws
                else list_transform(list_filter(range(1, len(ws) + 1), lambda k: not list_contains(ks, k)), lambda k: ws[k]) end, ' ')) kept_sha256
        from d left join r using (rid)""",
    "op10_chat_prefix_targets": """
        with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
            union all select -1, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) x(i, r)),
        e as (select *, length(role) + length(text)
                + (length(role || text) - length(replace(role || text, '\\', '')))
                + (select sum(len(string_split(role, m)) + len(string_split(text, m)) - 2) from (values ('[INST]'), ('[/INST]'), ('</s>')) c(m))
                + length('[INST][/INST]</s>') chars,
            length(text) + (length(text) - length(replace(text, '\\', '')))
                + (select sum(len(string_split(text, m)) - 1) from (values ('[INST]'), ('[/INST]'), ('</s>')) c(m)) reply from t),
        o as (select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) upto from e)
        select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
            sum(chars)::bigint formatted_chars, count(*) filter (role = 'assistant') n_examples,
            coalesce(sum(upto - length('</s>')) filter (role = 'assistant'), 0)::bigint example_chars
        from o group by conv_id""".replace("\\\\", "\\"),
    "op11_risk_controlled_rules": rules_sql(),
    "op12_bitmap_merkle_manifest": manifest_sql(),
    "op13_misra_gries_collocations": COLLOCATIONS,
}
