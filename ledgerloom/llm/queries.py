"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import ann, bytepairs, chat, hamming, hardneg, licenses, neardup, packing, pieces, pii, toxicity, urls, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.fit(urls.labelled_urls(spark)))


@_register(
    "op1_chat_format",
    r"""
    with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
      union all select -7, 0, 'user', '\### Assistant: </turn> ok'
      union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    select conv_id, count(*)::bigint as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
      sum(length(role) + length(text) + 14 + len(regexp_extract_all(text, '[#<]\\*(?:## |/turn>)')))::bigint as formatted_chars
    from turns group by conv_id
    """,
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    done = chat.format_conversations(rows).select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("read"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"),
    )
    whole = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@_register("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


@_register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC_AT).cast("int").alias("predicted"),
    )


@_register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_register("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_register("op7_nearest")
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@_register(
    "op9_nearest_codes",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: case when x > 0 then 1.0::double else 0.0 end) as code
      from embeddings
      where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    p as (
      select q.vec_id as query_id, r.vec_id, round(pow(list_distance(q.code, r.code), 2))::bigint as distance
      from v q join v r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id
    )
    select query_id, rank::int as rank, vec_id, distance
    from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p)
    where rank <= 20
    """,
)
def op9_nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_codes(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 20)


@_register("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


@_register("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit(pii.TERM), t["start"], t["end"]))
    return found.select(
        "doc_id", *map(_count_of, pii.KINDS), F.sha2(F.array_join(listed(F.col("base")), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(listed(F.col("base")), terms), ",").alias("spans"),
    )


def _count_of(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


@_register(
    "op11_hard_negatives",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x,
        case when vec_id % 7 = 0 then (label + 1) % 10 else label end::bigint as label
      from embeddings
      where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    s as (
      select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.x, r.x)::bigint as score
      from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id
    ),
    p as (
      select anchor_id, vec_id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same)
      where place <= 5
    ),
    n as (
      select p.*, s.vec_id as negative_id, s.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
      from p join s on s.anchor_id = p.anchor_id and not same
        and 80 * positive_score <= 100 * s.score and s.score <= positive_score
    )
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@_register("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytepairs.digest(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
