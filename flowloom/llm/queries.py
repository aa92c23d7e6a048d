"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), percent=85, words_in_shingle=4)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    stats = quality.with_statistics(table(spark, sf_dir, "documents"))
    return quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), min_words=50, min_chars=300).select("doc_id", "n_lines", "n_removed", "text")


SQL["op8_line_dedup"] = r"""
with lines as (select doc_id, text, string_split(text, chr(10)) a from documents),
heavy as (select *, list_transform(a, lambda x: len(regexp_extract_all(x, '[^\x09-\x0D\x20]+'))) words, list_transform(a, lambda x: length(x)) chars from lines),
w as (select doc_id, p, v, a[p:p + v - 1] k from (select *, unnest(range(1, len(a) - v + 2)) p from heavy, (select unnest([1, 2, 3]) v) where doc_id is not null)
  where v = 3 or list_sum(words[p:p + v - 1]) >= 50 or list_sum(chars[p:p + v - 1]) >= 300),
f as (select k, v, min((doc_id, p)) first from w group by k, v),
gone as (select doc_id, list(distinct q) g from (
  select doc_id, unnest(range(p, p + v)) q from w join f using (k, v) where first <> (doc_id, p)) group by doc_id)
select doc_id, cast(coalesce(len(a), 0) as bigint) n_lines, cast(coalesce(len(g), 0) as bigint) n_removed,
 case when g is null then text else array_to_string([a[i] for i in range(1, len(a) + 1) if not list_contains(g, i)], chr(10)) end as text
from lines left join gone using (doc_id)
"""


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chat

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)))


SQL["op2_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
  length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) as n_role,
  length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) as n_text from t)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(n_text + case when before is not null and before = role then 8 else 9 + 7 + 7 + n_role end) as bigint) as formatted_chars
from e group by conv_id
"""


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .repair import encoded_documents

    return encoded_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op12_importance_resampling"] = rf"""
with tab as materialized (select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: case when c & 1 = 1
   then xor(c >> 1, 3988292384) else c >> 1 end, x)) t),
texts as materialized (
  select true own, doc_id, row_number() over () k, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
  union all select false, null, -row_number() over (), regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
runs as materialized (select own, k, array_to_string(w[p:p + n - 1], ' ') f from (
  select own, k, w, n, unnest(range(1, len(w) - n + 2)) p from texts, (select unnest([1, 2, 3]) n))),
hashed as materialized (select f, xor(list_reduce(list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::bigint),
   lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 b
  from (select f, hex(encode(f)) h from (select distinct f from runs)), tab),
counted as (select b, count(*) filter (where own) s, count(*) filter (where not own) t from runs join hashed using (f) group by b),
totals as (select count(*) filter (where own) s, count(*) filter (where not own) t from runs),
gains as (select b, cast(floor(1000 * ln(((c.t + 1) * (a.s + 10000)::double) / ((c.s + 1) * (a.t + 10000)::double))) as bigint) g from counted c, totals a),
weighed as (select k, count(*) n, cast(sum(g) as bigint) g from runs join hashed using (f) join gains using (b) where own group by k),
scored as (select doc_id, len(w) n_words, coalesce(n, 0) n_features, coalesce(g, 0) weight, cast(coalesce(g, 0) + floor(-1000 * ln(-ln(
   (('0x' || substr(sha256('42:' || doc_id::varchar), 1, 8))::bigint + 0.5) / 4294967296))) as bigint) score from texts left join weighed using (k) where own),
placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) r, count(*) filter (where n_words >= 20) over () n from scored)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= 5 * n // 100 then r end as rank from placed
"""

SQL["op13_ranked_search"] = rf"""
with t as materialized (select k, doc_id, {_FOLDED.replace("text", "unnest(w)")} term, len(w) n from (
  select row_number() over () k, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents)),
q as (select distinct j, item_id, {_FOLDED.replace("text", "unnest(w)")} term from (
  select row_number() over () j, item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from benchmark)),
a as (select count(distinct k) n_docs, count(*) n_terms from t),
p as (select k, doc_id, term, n, count(*) tf from t where term in (select term from q) group by all),
df as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w from (select term, count(*) df from p group by term), a),
s as (select j, item_id, k, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as bigint) score
  from q join p using (term) join df using (term), a group by j, item_id, k, doc_id),
r as (select *, row_number() over (partition by j order by score desc, doc_id, k) rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
"""
