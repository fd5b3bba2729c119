"""The registered queries of the training-data operators and the SQL they match."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthway.llm import quality
from hearthway.llm.chat import format_conversations, read_conversations
from hearthway.llm.exact_dedup import exact_dedup
from hearthway.llm.fill_in_middle import fill_in_middle, restore
from hearthway.llm.filter_audit import audit_documents
from hearthway.llm.hidden_markov import score_texts
from hearthway.llm.jaccard import near_duplicates
from hearthway.llm.language_id import identify
from hearthway.llm.packing import pack
from hearthway.llm.pieces import encode_pieces
from hearthway.llm.secret_scan import scan_secrets
from hearthway.llm.topk import top_k
from hearthway.llm.toxicity import classify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored() -> Column:
    """Which rows stand for the stored snapshot; the others arrive as a batch."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))


@query(
    "op1_exact_dedup",
    """
with t as (select doc_id, length(coalesce(text, '')) as n_chars,
  sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents),
g as (select text_sha256, count(*) as group_size, arg_min(doc_id, (-n_chars, doc_id)) as keep_id from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are the snapshot, the other half the batch; every row is in the result."""
    return exact_dedup(table(spark, sf_dir, "documents"), stored())


@query("op3_mixture_packing")
def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(
        table(spark, sf_dir, "documents"),
        tokenizer=public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op2_top_k_search",
    """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
  where embedding is not null and len(embedding) > 0
   and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select a.vec_id as query_id, b.vec_id,
  cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 5""",
)
def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query(
    "op5_chat_format",
    """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, text as loss, regexp_replace(text, '</?s>|\\[/?(SYS|INST|OUT|ROLE|TEXT)\\]|<\\|(image|audio|document)\\|>|\\\\', '\\0#', 'g') as marked,
  regexp_replace(role, '</?s>|\\[/?(SYS|INST|OUT|ROLE|TEXT)\\]|<\\|(image|audio|document)\\|>|\\\\', '\\0#', 'g') as marked_role from c)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
 cast(3 + sum(length(marked) + case role when 'system' then 13 when 'user' then 15 when 'assistant' then 11 else 24 + length(marked_role) end) as bigint) as formatted_chars
from e group by conv_id""",
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    return read_conversations(format_conversations(rows.union(probe)))


@query("op4_piece_dropout")
def op4_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode with a tenth of the merges skipped; the digest is that of the decoded ids."""
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rate=0.1, seed=1, with_ids=False)


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its host, the language a path below it."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


@query(
    "op11_filter_audit",
    """
with marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id),
t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, min(doc_id) over (partition by coalesce(text, '')) as least from documents),
w as (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from t),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  case when len(words) < 200 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
  + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > least then 16 else 0 end as failed
  from w left join marks on w.doc_id = marks.doc_id),
g as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, failed),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as a, unnest([1, 2, 4, 8, 16]) as v),
o as (select p.a || q.a || r.a || s.a || t.a as filter_order, [p.v, q.v, r.v, s.v, t.v] as bits from l p, l q, l r, l s, l t
  where p.v + q.v + r.v + s.v + t.v = 31 and p.v | q.v | r.v | s.v | t.v = 31),
k as (select filter_order, cast(step as integer) as step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0) as before from o, range(1, 6) r(step)),
d as (select part, filter_order, step, bit, sum(case when failed & (before | bit) = 0 then n else 0 end) as kept,
  sum(case when failed & before = 0 and failed & bit > 0 then n else 0 end) as removed,
  sum(case when failed & before > 0 and failed & bit > 0 then n else 0 end) as redundant, sum(case when failed = bit then n else 0 end) as unique_fails,
  sum(case when failed & before = 0 and failed & bit > 0 then good else 0 end) as good_lost,
  sum(case when failed & before = 0 and failed & bit > 0 then toxic else 0 end) as toxic_lost
  from k, g group by part, filter_order, step, bit)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
 cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
 cast(sum(removed) over (partition by part, bit) as bigint) as shapley from d""",
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_fill_in_middle",
    """
with t as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
  cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as high from u),
f as (select *, case when n = 0 or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
  array_to_string(units[1:low], '') as p, array_to_string(units[low + 1:high], '') as m, array_to_string(units[high + 1:n], '') as s from c)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars,
 cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
 sha256(case form when 'plain' then text when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
 sha256(text) as restored_sha256 from f""",
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the output, and that of the text rebuilt from it."""
    made = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op13_hidden_markov")
def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id leaves 1 modulo 5 are held out."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return score_texts(table(spark, sf_dir, "documents"), learn)
