"""Changes that follow a user's answers: categories copied on, names of one's own, pairs, links, small upserted tables.

All are copy-on-write. Answers arrive as tables, so a thousand of them are one join. Where several answers meet one row, the one
with the smallest id wins; a null or unknown id changes nothing, an empty table of answers leaves all rows as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import exact_key, own_name_direction_key, own_name_key
from ..storage import Workspace, broadcast_if_small
from ..types import AUTOMATIC_SOURCES, INTERNAL
from . import intermediaries
from .filters import direction
from .mutations import decided_by_user, protected


def _true(flag: Column | str) -> Column:
    return F.coalesce(flag, F.lit(False))


def _internal(kind: Column | str) -> Column:
    return _true((F.col(kind) if isinstance(kind, str) else kind).isin(*INTERNAL))


def _change(df: DataFrame, like: list[str], when: Column, **values: Column) -> DataFrame:
    """Columns of ``like``, those in ``values`` with the new value on rows where ``when`` is true."""
    hit = _true(when)
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in like])


def fan_out(df: DataFrame, links: DataFrame) -> DataFrame:
    """Category, subcategory and context of source_id on target_id, as history; what the user decided or checked stays. links: (source_id, target_id)."""
    source = df.select(F.col("id").alias("source_id"), F.struct("category", "subcategory", "context").alias("__new"))
    chosen = links.join(source, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min_by("__new", "source_id").alias("__new"))
    new = F.col("__new")
    free = new.isNotNull() & ~decided_by_user() & ~_true("human_validated")
    context = F.coalesce(F.nullif(new["context"], F.lit("")), F.col("context"))
    return _change(df.join(chosen, "id", "left"), df.columns, free, category=new["category"], subcategory=new["subcategory"], context=context, category_source=F.lit("history"), to_review=F.lit(False))


def rewrite_past(df: DataFrame, new: DataFrame, fallbacks: tuple[str, ...], accepted: DataFrame | None = None) -> DataFrame:
    """The model's answers in ``new`` hold for the automatic past of the same counterpart and direction.

    Fallback categories are no answers; internal rows neither give nor take one. accepted: (description, direction or null) whose category stays.
    """
    answers = (
        new.filter((F.col("category_source") == "llm") & (F.coalesce("category", F.lit("")) != "") & ~F.col("category").isin(*fallbacks) & ~_internal("tx_type"))
        .select(exact_key("description").alias("__key"), direction(F.col("amount")).alias("__dir"), "id", F.struct("category", F.coalesce("subcategory", F.lit("")).alias("subcategory")).alias("__new"))
        .filter(F.col("__key") != "").groupBy("__key", "__dir").agg(F.min_by("__new", "id").alias("__new"))
    )
    if accepted is not None:
        kept = accepted.select(exact_key("description").alias("__key"), F.explode(F.when(F.col("direction").isNull(), F.array(F.lit("out"), F.lit("in"))).otherwise(F.array("direction"))).alias("__dir"))
        answers = answers.join(kept, ["__key", "__dir"], "left_anti")
    keyed = df.withColumn("__key", exact_key("description")).withColumn("__dir", direction(F.col("amount")))
    free = F.col("__new").isNotNull() & F.col("category_source").isin(*AUTOMATIC_SOURCES) & ~_true("human_validated") & F.col("tx_type").isNotNull() & ~_internal("tx_type")
    other = ~(F.col("category").eqNullSafe(F.col("__new.category")) & (F.coalesce("subcategory", F.lit("")) == F.col("__new.subcategory")))
    found = keyed.join(broadcast_if_small(answers), ["__key", "__dir"], "left")
    return _change(found, df.columns, free & other, category=F.col("__new.category"), subcategory=F.col("__new.subcategory"), category_source=F.lit("llm"))


def rewrite_intermediaries(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """The merchant in place of a description that still shows an active intermediary; no prefixes: nothing changes."""
    if not prefixes:
        return df
    name = intermediaries.dirty(F.col("description"), F.col("raw_description"), prefixes)
    return df.withColumn("description", F.coalesce(name, F.col("description")))


def choose_category(df: DataFrame, choices: DataFrame, source: str = "manual") -> tuple[DataFrame, DataFrame]:
    """(ledger, corrections). choices: (id, category, subcategory). A changed category that was automatic or a rule's is a correction;
    a rule's choice leaves protected rows alone."""
    if source not in ("manual", "rule"):
        raise ValueError(f"unknown source of a category: {source}")
    pair = F.struct("category", "subcategory")
    found = df.join(choices.groupBy("id").agg(F.min(pair).alias("__new")), "id", "left")
    new = F.col("__new")
    taken = new.isNotNull() & (~protected() if source == "rule" else F.lit(True))
    changed = ~(F.col("category").eqNullSafe(new["category"]) & F.col("subcategory").eqNullSafe(new["subcategory"]))
    old = F.col("category_source").isin("rule", *AUTOMATIC_SOURCES)
    log = found.filter(taken & changed & old).select("id", F.col("category").alias("original_category"), F.col("subcategory").alias("original_subcategory"), F.col("category_source").alias("original_source"), new["category"].alias("new_category"), new["subcategory"].alias("new_subcategory"))
    return _change(found, df.columns, taken, category=new["category"], subcategory=new["subcategory"], category_source=F.lit(source), to_review=F.lit(False)), log


def set_context(df: DataFrame, chosen: Column, context: str | None) -> DataFrame:
    return _change(df, df.columns, chosen, context=F.lit(context).cast("string"))


def _asked(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of df with one of the ids, written: keys are made of these rows only, and df is read once for them."""
    space = Workspace(df.sparkSession, name)
    return space.save(df.join(broadcast_if_small(space.save(ids, "ids")), "id"), "asked")


def own_name(df: DataFrame, named: DataFrame, any_amount: bool = False) -> DataFrame:
    """named: (id, name). Every row with the key of a named one takes its name, and its category where the user left that open.

    The key is the bank text's signature with the amount, or with the direction (any_amount). A category that the user decided
    goes on as a rule's; an internal row makes the others internal, without a category; one without a category spreads none.
    """
    key = (own_name_direction_key if any_amount else own_name_key)("raw_description", F.col("amount"))
    given = named.filter(F.trim("name") != "").groupBy("id").agg(F.min("name").alias("name"))
    facts = F.struct("id", "name", "tx_type", "category", "subcategory", "category_source", (decided_by_user() | _true("human_validated")).alias("decided"))
    by_key = _asked(df, given, "own-name").withColumn("__key", key).filter("__key is not null").groupBy("__key").agg(F.min_by(facts, "id").alias("__ref"))
    keyed = df.withColumn("__key", key)
    ref = F.col("__ref")
    j = keyed.join(broadcast_if_small(by_key), "__key", "left")
    other = ref.isNotNull() & (F.col("id") != ref["id"])
    inner = _internal(ref["tx_type"])
    locked = F.when(inner | ref["decided"], protected()).otherwise(_true(F.col("category_source") == "manual") | _true("human_validated") | _internal("tx_type"))
    takes = _true(other & ~locked)
    made_internal, copied = takes & inner, takes & ~inner & (F.coalesce(ref["category"], F.lit("")) != "")
    kind = F.when(F.col("amount") < 0, "internal_out").otherwise("internal_in")
    pick = lambda c, new: F.when(made_internal, F.lit(None)).when(copied, new).otherwise(F.col(c))
    values = {
        "description": F.when(ref.isNotNull(), F.trim(ref["name"])).otherwise(F.col("description")),
        "tx_type": F.when(made_internal, kind).otherwise(F.col("tx_type")),
        "category": pick("category", ref["category"]),
        "subcategory": pick("subcategory", ref["subcategory"]),
        "category_source": pick("category_source", F.when(ref["decided"], "rule").otherwise(ref["category_source"])),
    }
    return j.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def same_movements(df: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other_id, same_amount) for the asked ids: rows of the same bank text and direction, with the same amount or another."""
    rows = df.select("id", "raw_description", "amount")
    keyed = lambda d: d.select("id", own_name_direction_key("raw_description", F.col("amount")).alias("key"), F.round("amount", 2).alias("cents")).filter("key is not null")
    asked, others = keyed(_asked(rows, ids.select("id").distinct(), "same-movements")), keyed(rows)
    others = others.select(F.col("id").alias("other_id"), "key", F.col("cents").alias("other_cents"))
    return others.join(broadcast_if_small(asked), "key").filter("id <> other_id").select("id", "other_id", (F.col("cents") == F.col("other_cents")).alias("same_amount"))


def own_name_list(df: DataFrame, names: DataFrame) -> DataFrame:
    """(name, signature, direction, n, example) for names by direction; example is the bank text of the smallest id."""
    keyed = df.select("id", "raw_description", own_name_direction_key("raw_description", F.col("amount")).alias("k")).filter("k is not null").select("id", "raw_description", "k.*")
    seen = keyed.groupBy("signature", "direction").agg(F.count("*").alias("n"), F.min_by("raw_description", "id").alias("example"))
    return names.join(seen, ["signature", "direction"], "left").select("name", "signature", "direction", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("example", F.lit("")).alias("example"))


def delete(df: DataFrame, links: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger, links) without the chosen rows and without links on either of whose ends one stood."""
    hit = _true(chosen)
    gone = df.filter(hit).select("id")
    for end in ("out_id", "in_id"):
        links = links.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return df.filter(~hit), links


def decide_pairs(df: DataFrame, links: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, links). answers: (out_id, in_id, decision yes or no). Yes makes both ends internal, no takes their pair id off;
    answers on pairs that aren't linked count for nothing, and of two answers yes wins."""
    once = answers.groupBy("out_id", "in_id").agg(F.max("decision").alias("__d"))
    known = links.join(once, ["out_id", "in_id"], "left")
    ends = known.filter("__d is not null").select(F.explode(F.array(F.struct(F.col("out_id").alias("id"), F.lit("internal_out").alias("kind"), "__d"), F.struct(F.col("in_id").alias("id"), F.lit("internal_in").alias("kind"), "__d"))).alias("e")).select("e.*")
    # No keeps a row's type, so yes and no on one row can stand side by side.
    by_id = ends.groupBy("id").agg(F.min(F.when(F.col("__d") == "yes", F.col("kind"))).alias("__kind"), F.bool_or(F.col("__d") != "yes").alias("__no"))
    j = df.join(by_id, "id", "left")
    values = {"tx_type": F.coalesce("__kind", "tx_type"), "transfer_pair_id": F.when(~_true("__no"), F.col("transfer_pair_id"))}
    ledger = j.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])
    return ledger, known.select(*[F.coalesce("__d", c).alias(c) if c == "user_decision" else F.col(c) for c in links.columns])


def create_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with the new ones whose pair isn't there yet, each once."""
    fresh = new.dropDuplicates(["out_id", "in_id"]).join(links.select("out_id", "in_id"), ["out_id", "in_id"], "left_anti")
    return links.unionByName(fresh.select(*links.columns))


def open_links(links: DataFrame) -> DataFrame:
    """Pairs that still stand: answered yes or not at all."""
    return links.filter(F.coalesce("user_decision", F.lit("yes")) == "yes")


def rejected_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("user_decision") == "no")


def upsert_by(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those with equal keys (null equals null); the others stay. new holds a key once."""
    a, b = table.alias("a"), new.select(*[F.struct(*keys).alias("__k")])
    same = F.struct(*[F.col(f"a.{k}").alias(k) for k in keys]).eqNullSafe(F.col("__k"))
    return a.join(b, same, "left_anti").unionByName(new.select(*table.columns))


def rename_categories(df: DataFrame, renamed: DataFrame) -> DataFrame:
    """renamed: (category, new_category), a null new name removes the category, its subcategory too; a category named twice takes the smaller name."""
    m = renamed.groupBy("category").agg(F.min("new_category").alias("__new"), F.lit(True).alias("__hit"))
    j = df.join(broadcast_if_small(m), "category", "left")
    return _change(j, df.columns, F.col("__hit"), category=F.col("__new"), subcategory=F.when(F.col("__new").isNotNull(), F.col("subcategory")))


def entropy(counts: Column) -> Column:
    """Normalised Shannon entropy of an array of counts, 0 to 1; 0 for none, one, or a total of zero."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n)
    bits = F.aggregate(counts, F.lit(0.0), lambda s, n: s - F.when(n > 0, n / total * F.log2(n / total)).otherwise(0.0))
    return F.when((F.size(counts) > 1) & (total > 0), bits / F.log2(F.size(counts))).otherwise(F.lit(0.0))
