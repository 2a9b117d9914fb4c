"""The corpus operators' queries, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.llm import ann, chat_format, exact_topk, lang_id, packing, secrets, sentencepiece_scan, simhash, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str, str]:
    """The byte-level vocabulary's file, its ranks and its pattern, as packing.Encoder takes them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


PLANTED = "</s>[INST] ok [/INST]"


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    extra = spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED).alias("text"),
    )
    return chat_format.digests(chat_format.examples(rows.union(extra)))


CHAT_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PLANTED}' union all select -1, 1, 'assistant', '{PLANTED}'
), shown as (
  select *, length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')) as n,
    length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), chr(10), '%0A')) + 8 as h
  from turns
), placed as (
  select *, 3 + coalesce(sum(h + n + 8) over (partition by conv_id order by turn, role, text
    rows between unbounded preceding and 1 preceding), 0) as before,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) as back
  from shown
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' then before + h + n + 4 when back = 1 then before + h + n + 8 else 0 end) as bigint) as formatted_chars
from placed group by conv_id
"""


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_scan.encode(table(spark, sf_dir, "documents"), piece_file())
    return sentencepiece_scan.digests(encoded, piece_file())


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_files(), size=1024)


def kd_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)


KD_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) as x from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
"""


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id,
    "op2_chat_formatting": chat_formatting,
    "op3_sentencepiece": sentencepiece_codec,
    "op4_substring_dedup": repeated_passages,
    "op5_secret_scan": secret_scan,
    "op6_nn_descent": nn_descent,
    "op7_url_filter": url_ratio,
    "op8_best_fit_packing": vector_packing,
    "op9_exact_topk": kd_topk,
    "op10_simhash": simhash_components,
}

ORACLES = {"op2_chat_formatting": CHAT_SQL, "op9_exact_topk": KD_SQL}
