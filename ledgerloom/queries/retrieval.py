"""Queries: retrieval of documents for texts, known questions, weights of texts outside the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as op
from ..storage import Workspace
from .common import query, table

S, D = SparkSession, DataFrame
_STOP = ("the", "of", "and", "in", "that", "is", "to", "for", "it", "with", "que", "de", "la", "der", "die", "und", "le", "et")
_IN = ", ".join(f"'{w}'" for w in _STOP)


def _shares(name: str, source: str, id_col: str, stop: bool = True) -> str:
    """Oracle text: token shares of a table, as a common table expression."""
    keep = f"length(t) > 1 AND t NOT IN ({_IN})" if stop else "length(t) > 1"
    rows = rf"SELECT {id_col} AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN_]+'), lambda t: {keep})) AS term FROM {source}"
    return f"{name} AS MATERIALIZED (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM (SELECT id, term, count(*) AS n FROM ({rows}) GROUP BY id, term))"


def _scores(indexed: str, indexed_id: str, asked: str, asked_id: str, stop: bool = True) -> str:
    return f"""{_shares("i", indexed, indexed_id, stop)}, {_shares("q", asked, asked_id, stop)},
idf AS (SELECT term, ln(((SELECT count(*) FROM {indexed}) + 1.0) / (count(*) + 1)) + 1 AS idf FROM i GROUP BY term),
iw AS (SELECT id, term, tf * idf AS w FROM i JOIN idf USING (term)), qw AS (SELECT id, term, tf * coalesce(idf, 1.0) AS w FROM q LEFT JOIN idf USING (term)),
inorm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM iw GROUP BY id), qnorm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY id),
s AS MATERIALIZED (SELECT question, d.id, round(dot / (a.norm * b.norm), 9) AS score FROM (SELECT qw.id AS question, iw.id AS id, sum(qw.w * iw.w) AS dot FROM qw JOIN iw USING (term) GROUP BY 1, 2) d JOIN inorm a ON a.id = d.id JOIN qnorm b ON b.id = question)"""


#: The choice is walked entry by entry.
_WALK = f"""WITH RECURSIVE {_scores("documents", "doc_id", "benchmark", "item_id")},
c AS MATERIALIZED (SELECT question, id, score, length(text) AS len, row_number() OVER (PARTITION BY question ORDER BY score DESC, id DESC) AS rk FROM s JOIN documents ON doc_id = id WHERE score >= 0.05),
walk AS (SELECT question, rk, id, score, len AS used, 1 AS chosen, TRUE AS taken, FALSE AS over FROM c WHERE rk = 1
  UNION ALL SELECT c.question, c.rk, c.id, c.score, used + CASE WHEN used + len <= 6000 THEN len ELSE 0 END, chosen + CASE WHEN used + len <= 6000 THEN 1 ELSE 0 END, used + len <= 6000, used + len > 6000 AND chosen >= 5
  FROM walk JOIN c ON c.question = walk.question AND c.rk = walk.rk + 1 WHERE NOT over)
SELECT question, CAST(chosen - 1 AS INTEGER) AS position, id AS doc_id, score FROM walk WHERE taken"""


@query(_WALK)
def topk_retrieval(spark: S, sf: str) -> D:
    """For every benchmark passage, the documents that fit the context."""
    docs = table(spark, sf, "documents")
    space = Workspace(spark, "retrieval")
    index = op.build(docs, "doc_id", "text", space, _STOP)
    found = space.save(op.scores(index, table(spark, sf, "benchmark"), "item_id", "text", op.LEAST_SCORE), "found")  # read twice
    return op.within_budget(found, index.lengths).withColumnRenamed("id", "doc_id")


@query(f"WITH {_scores('benchmark', 'item_id', 'documents', 'doc_id', False)} SELECT question AS doc_id, id AS item_id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, id) = 1")
def topk_faq(spark: S, sf: str) -> D:
    """For every document, the known passage that is nearest to it, if any is near enough."""
    index = op.build(table(spark, sf, "benchmark"), "item_id", "text", Workspace(spark, "faq"))
    return op.best(op.scores(index, table(spark, sf, "documents"), "doc_id", "text")).select(F.col("question").alias("doc_id"), F.col("id").alias("item_id"), "score")


@query(f"WITH {_scores('documents', 'doc_id', 'benchmark', 'item_id')} SELECT id AS item_id, term, round(w / norm, 9) AS weight FROM qw JOIN qnorm USING (id)")
def fn_conv_tfidf(spark: S, sf: str) -> D:
    """Weights of the benchmark's terms by the statistics of the documents."""
    index = op.build(table(spark, sf, "documents"), "doc_id", "text", Workspace(spark, "tfidf"), _STOP)
    found = op.unit(op.vectors(index, table(spark, sf, "benchmark"), "item_id", "text"))
    return found.select(F.col("id").alias("item_id"), "term", F.round("weight", op.DIGITS).alias("weight"))
