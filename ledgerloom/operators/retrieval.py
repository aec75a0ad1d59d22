"""Text retrieval: an inverted index with tf-idf weights, cosine scores of texts against it, the best entries within a budget.

A text's tokens are its runs of letters, digits and underscores in lower case, longer than one character, without stop words. A
term's weight in a text is its share of the tokens times log((N + 1) / (df + 1)) + 1, with N and df of the indexed texts; a term
that no indexed text has weighs its share. Scores are cosines, rounded to nine digits, so that equal texts tie.

Scale. The index is three written tables: terms (df, idf, salts), postings (term, salt, id, weight over the text's norm) and
lengths. A term of more than ``HOT`` texts is cut into salts by the texts' ids, so no posting list is one task's, and its
idf reaches the counts by a broadcast (there are at most as many hot terms as pairs over ``HOT``); others are joined by shuffle.
Scores are sums over terms that two texts share. Questions of up to ``BROADCAST_ROWS`` terms are sent to the postings, dealt by text,
so that sums need no shuffle; more of them meet by term and salt, pre-aggregated before the shuffle. Nothing is collected.

Defined results. Null texts are empty; texts without tokens are counted in N, match nothing and are matched by nothing. Rows that
repeat an id are one text. An empty index or question table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, Workspace, broadcast_if_small

HOT = 10_000
#: The least score that counts, characters and entries of a selection, least score of a known question.
LEAST_SCORE, BUDGET, TOP, LEAST_FAQ = 0.05, 6000, 5, 0.3
DIGITS = 9


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop) if stop else F.length(t) > 1)


def term_shares(texts: DataFrame, id_col: str, text_col: str, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, tf): each term's share of its text's tokens."""
    rows = texts.select(F.col(id_col).alias("id"), tokens(F.col(text_col), stop).alias("tokens"))
    # Texts move once, by id; counting and shares need no other shuffle.
    counted = rows.repartition("id").select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    return counted.withColumn("tf", F.col("n") / F.sum("n").over(Window.partitionBy("id"))).drop("n")


@dataclass
class Index:
    """terms: term, df, idf, salts; postings: term, salt, id, weight; lengths: id, length; unseen: idf of a term it lacks."""

    terms: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stop: tuple[str, ...]
    unseen: float = 1.0


def _with_idf(shares: DataFrame, terms: DataFrame, how: str) -> DataFrame:
    """shares joined with the term table; hot terms by a broadcast."""
    t = terms.withColumnRenamed("term", "t_term")
    hot, cold, meets = t.filter("salts > 1"), t.filter("salts = 1"), F.col("term") == F.col("t_term")
    rest = shares.join(F.broadcast(hot.select(F.col("t_term").alias("h_term"))), F.col("term") == F.col("h_term"), "left_anti")
    return shares.join(F.broadcast(hot), meets).unionByName(rest.join(broadcast_if_small(cold), meets, how)).drop("t_term")


def unit(weights: DataFrame) -> DataFrame:
    """Weights over the norm of their text."""
    return weights.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id"))))


def build(texts: DataFrame, id_col: str, text_col: str, space: Workspace, stop: tuple[str, ...] = (), hot: int = HOT) -> Index:
    shares = space.save(term_shares(texts, id_col, text_col, stop), "shares")
    lengths = space.save(texts.groupBy(F.col(id_col).alias("id")).agg(F.sum(F.length(F.coalesce(text_col, F.lit("")))).cast("long").alias("length")), "lengths")
    n = lengths.count()
    df = shares.groupBy("term").agg(F.count("*").alias("df"))
    terms = space.save(df.select("term", "df", (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"), F.ceil(F.col("df") / hot).cast("int").alias("salts")), "terms")
    weighed = unit(_with_idf(shares, terms, "inner").withColumn("weight", F.col("tf") * F.col("idf")))
    postings = weighed.select("term", F.expr("CAST(pmod(xxhash64(id), salts) AS INT)").alias("salt"), "id", "weight")
    return Index(terms, space.save(postings, "postings"), lengths, stop)


def vectors(index: Index, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight, salts) of texts outside the index, by its statistics."""
    known = _with_idf(term_shares(texts, id_col, text_col, index.stop), index.terms, "left")
    return known.select("id", "term", (F.col("tf") * F.coalesce("idf", F.lit(index.unseen))).alias("weight"), F.coalesce("salts", F.lit(0)).alias("salts"))


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def scores(index: Index, texts: DataFrame, id_col: str, text_col: str, least: float = 0.0) -> DataFrame:
    """(question, id, score) of every pair with a term in common and a score of at least ``least``."""
    asked = unit(vectors(index, texts, id_col, text_col)).filter("salts > 0")
    spread = Workspace(texts.sparkSession, "asked").save(asked.select(F.col("id").alias("question"), "term", F.col("weight").alias("asked"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), "asked")
    if _few(spread):
        # Questions go to the texts: all terms that a pair shares lie in one task, so no pair moves before its score is known.
        pairs = index.postings.repartition("id").join(F.broadcast(spread), ["term", "salt"])
    else:
        pairs = spread.join(broadcast_if_small(index.postings), ["term", "salt"])
    found = pairs.groupBy("question", "id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), DIGITS).alias("score"))
    return found.filter((F.col("score") >= least) & (F.col("score") > 0))


def best(scored: DataFrame, least: float = LEAST_FAQ) -> DataFrame:
    """(question, id, score): the best entry of each question, of equals the one with the least id, if it scores ``least``."""
    top = scored.groupBy("question").agg(F.max(F.struct("score", (-F.col("id")).alias("back"))).alias("b"))
    return top.filter(F.col("b.score") >= least).select("question", (-F.col("b.back")).alias("id"), "b.score")


def within_budget(scored: DataFrame, lengths: DataFrame, budget: int = BUDGET, top: int = TOP) -> DataFrame:
    """(question, position, id, score): entries best first, of equals the greatest id first, while they fit ``budget`` characters.

    At least one. Until ``top`` are chosen, an entry that doesn't fit is passed over for shorter ones; then the first that
    doesn't fit ends the selection. Of the entries of one length only the first budget / length + 1 can be chosen, as what is
    left never grows: so a question's part of the choice is bounded by the budget, however many entries it matches.
    """
    rows = scored.join(lengths, "id").select("question", "score", "id", F.greatest("length", F.lit(1)).alias("length"))
    order = [F.desc("score"), F.desc("id")]
    of_length = rows.withColumn("nth", F.row_number().over(Window.partitionBy("question", "length").orderBy(*order)))
    some = of_length.filter((F.col("nth") <= budget + 1) & (F.col("nth") <= F.floor(F.lit(budget) / F.col("length")) + 1))
    listed = some.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("score", "id", "length")), asc=False).alias("entries"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<score:double,id:bigint,length:bigint>>").alias("picked"))

    def step(state: Column, e: Column) -> Column:
        size = F.size(state["picked"])
        takes = (size == 0) | ((size < top) & (state["used"] + e["length"] <= budget))
        entry = F.struct(e["score"].alias("score"), e["id"].cast("long").alias("id"), e["length"].cast("long").alias("length"))
        return F.struct((state["used"] + F.when(takes, entry["length"]).otherwise(0)).alias("used"), F.when(takes, F.concat(state["picked"], F.array(entry))).otherwise(state["picked"]).alias("picked"))

    chosen = listed.select("question", F.aggregate("entries", none, step).alias("s")).select("question", "s.used", "s.picked")
    first = chosen.select("question", F.posexplode("picked").alias("position", "e")).select("question", "position", "e.id", "e.score")
    # Behind the top entries only a run without a gap follows.
    full = chosen.filter(F.size("picked") >= top).select("question", "used", F.element_at("picked", -1).alias("last"))
    behind = rows.join(full, "question").filter((F.col("score") < F.col("last.score")) | ((F.col("score") == F.col("last.score")) & (F.col("id") < F.col("last.id"))))
    place = Window.partitionBy("question").orderBy(*order)
    run = behind.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= budget + 1)
    fits = run.withColumn("upto", F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") + F.col("upto") <= budget)
    return first.unionByName(fits.select("question", (F.col("nth") + top - 1).alias("position"), "id", "score"))
