"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, cotrain, exact_dedup, filter_audit, hard_negatives, mixing, nbest, pii, quality_rules, simhash, token_files, toxicity, warc
from .common import Workspace, table, with_locator


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measures(table(spark, sf_dir, "documents"), quality_rules.trusted(table(spark, sf_dir, "labels")))


#: A conversation whose texts are control strings themselves.
_CONTROL_CASE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame(_CONTROL_CASE, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.examples(rows.unionByName(case)))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cotrain.features(table(spark, sf_dir, "documents"), Workspace(spark, "cotrain"))
    return cotrain.score(rows, cotrain.train(rows, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.col("keeper.id").alias("keep_id"), F.col("copies").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def op6_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op7_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_warc_split_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    return warc.read(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_locator(table(spark, sf_dir, "documents"), Workspace(spark, "mixing-input"))
    rows = docs.select(F.col("doc_id").alias("id"), "source", F.col("__ll_file").alias("file"), F.col("__ll_row").alias("row"))
    return mixing.mix(rows, ["file", "row"], ties=["file", "row"]).select(F.col("id").alias("doc_id"), "source", "block", "slot", "place")


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "filter-audit"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, frequencies = token_files.write(table(spark, sf_dir, "documents"), Workspace(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(manifest, frequencies)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), "id % 50 = 0", Workspace(spark, "hard-negatives"))


_ALL = (
    op1_quality_rules, op2_chat_format, op3_simhash_near_dedup, op4_quality_cotraining, op5_exact_dedup, op6_pii_semi_crf,
    op7_toxicity_noisy_channel, op8_warc_split_reader, op9_mixing_sources, op10_sentencepiece_nbest,
    op11_filter_audit, op12_token_files, op13_hard_negatives,
)

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPED = "replace(x, '\\', '\\\\')"
for _c in _CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"

_CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length('<|im_start|><|im_sep|><|im_end|>') + length({_ESCAPED.replace("(x,", "(role,")}) + length({_ESCAPED.replace("(x,", "(text,")}) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM c),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, role = 'assistant' OR i = m AS ends FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (ends) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (ends) AS BIGINT) AS n_examples
FROM s GROUP BY conv_id"""

_WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS full_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = full_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> full_id THEN full_id END AS refers_to, url FROM m"""

_BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) AS t(i)),
c AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""

_EXACT = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k"""

#: Every order is played out on the histogram of failed filters; Shapley sums are what a filter removes in all of them.
_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
h AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || g.c || i.c || e.c AS filter_order FROM x a, x b, x g, x i, x e WHERE len(list_distinct([a.c, b.c, g.c, i.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c FROM o, unnest(range(1, 6)) AS r(step)),
p AS (SELECT *, list_min(list_transform(string_split(fails, ''), lambda z: instr(filter_order, z))) AS first_ FROM h, s),
q AS (SELECT *, CASE WHEN fails = '' THEN 9 ELSE first_ END AS at_ FROM p),
r AS (SELECT part, filter_order, step, c, sum(CASE WHEN at_ > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN at_ = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(fails, c) AND at_ < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = c THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN at_ = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN at_ = step THEN toxic ELSE 0 END) AS toxic_lost FROM q GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM r"""

_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM v a, v r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def quality_base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op1 alone, which SQL can express."""
    return quality_rules.base_measures(table(spark, sf_dir, "documents"))


def more_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"quality_base_measures": quality_base_measures}


def oracle_sql() -> dict[str, str]:
    return {"quality_base_measures": _BASE, "op2_chat_format": _CHAT, "op5_exact_dedup": _EXACT, "op8_warc_split_reader": _WARC, "op11_filter_audit": _AUDIT, "op13_hard_negatives": _NEGATIVES}
