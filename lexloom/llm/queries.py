"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, crf_pii, graph_search, gru_language, packing, parity_join, prefix_bpe, prefix_hash, reply_trees, seekable, string_kernel, tokens

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_prefix_hash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    folder = common.scratch(spark, "token-files")
    manifest = seekable.write_ids(docs, folder, tokens.vocabulary(BYTE_BPE), end_id=2, files=common.partitions(spark))
    return seekable.read_ids(spark, manifest)


def op3_graph_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return graph_search.nearest(vectors, F.col("vec_id") % 20 == 0, most=20)


def op4_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(common.remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    net = gru_language.fit(docs.filter("not held_out"))
    return gru_language.predict(docs, net, ["doc_id", "held_out"])


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return prefix_bpe.digest(docs, tokens.vocabulary(WORD_BPE))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, tokens.vocabulary(BYTE_BPE), end_id=0)


def op7_parity_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return parity_join.link_components(docs, parity_join.Rule(words=4, num=85, den=100))


def op8_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_pii.scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic")
    machine = string_kernel.fit(docs, labels.filter(common.remainder(F.col("doc_id"), 5) != 0))
    docs = docs.withColumn("held_out", F.coalesce(common.remainder(F.col("doc_id"), 5) == 0, F.lit(False)))
    return string_kernel.predict(docs, machine, ["doc_id", "held_out"])


#: Conversation -7: control strings inside both texts.
CONTROL = "\\### Assistant: </turn> ok"


def op10_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the table itself has under -7 are turns of that conversation too."""
    rows = common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    messages = reply_trees.conversations(rows.unionByName(own))
    formatted = common.cut(reply_trees.transcripts(messages, unique=True), "transcripts")
    return reply_trees.read_back(formatted)


OP10_SQL = r"""
with every as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
    select *, length(body) + length(regexp_replace(body, '[^\\#<]', '', 'g')) as body_size,
        length(role) + length(regexp_replace(role, '[^\\#<\n]', '', 'g')) as role_size
    from every
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
    cast(coalesce(sum(length(body)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(4 + role_size + 1 + body_size + 8) as bigint) as formatted_chars
from sized group by conv_id
"""


OP7_SQL = r"""
with recursive words as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws
    from documents
), grams as materialized (
    select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k : k + 3], ' ')) end) as gram
    from words
), sizes as materialized (select doc_id, count(*) as n from grams group by doc_id
), links as materialized (
    select a.doc_id as one, b.doc_id as other
    from grams a join grams b using (gram) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach as (
    select one, other from links union select r.one, l.other from reach r join links l on l.one = r.other
)
select w.doc_id, coalesce(any_value(s.n), 0) as n_shingles, coalesce(min(r.other), w.doc_id) as component_id
from words w left join sizes s using (doc_id) left join reach r on r.one = w.doc_id group by w.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_prefix_hash_fingerprints,
        op2_token_files,
        op3_graph_nearest,
        op4_gru_language,
        op5_prefix_bpe,
        op6_packing,
        op7_parity_jaccard_join,
        op8_crf_personal_data,
        op9_string_kernel_toxicity,
        op10_reply_tree_chat,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_parity_jaccard_join": OP7_SQL, "op10_reply_tree_chat": OP10_SQL}
