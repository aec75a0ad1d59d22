"""Mixing sources to target weights by Pfair scheduling.

Method. A source's rows are put in a fixed pseudo-random order and cut into blocks. Sources with weights ``w`` flow at rates
in proportion to them until each has used up its blocks; ``T(v)`` is the slot by which a source of weight 1 that never ends
would have had ``v`` blocks, so ``T`` is linear between the points where sources run out. Block k of a source is released at
slot floor(T(k / w)) and due by slot ceil(T((k + 1) / w)); at every slot the released block with the earliest deadline goes
next. The rates always add up to one block a slot, so every block meets its window: at every slot a source is within less than
one block of its target, also where other sources run out, every slot has a block and none is repeated. All of it is integer
arithmetic on the weights as given (to a millionth); no share is rounded.

Scale. Slots are cut into slices of ``SLICE``. Each is scheduled by itself, from a guess of how far every source has come at
its start (the whole blocks due by then, and the earliest deadlines among those begun). Where a slice ends otherwise than the
next one began, the next one is done again from there, until all fit; a guess usually heals within a slice, so two turns do for
any number of slices. Then the whole schedule is the one that a single pass over all slots would give. A slice holds one
entry a source; sources are a dimension. Rows get their rank inside a source without one task per source: they are spread over
prefixes of their order key, ranked inside a prefix, and prefix counts are accumulated. Repeated ids would share a prefix, so a
prefix with far more rows than usual is spread again, by the columns ``ties``. Only ids, sources and keys are shuffled.

Defined results. A null source is a source of its own, null ids order first, repeated rows are all placed. Blocks that are due
at the same slot go in the order of their sources. A source without a positive weight gets the smallest given one; repeated
weights of a source add up. An empty table gives an empty result. Extra columns are ignored or carried whatever their names;
texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, shuffle_partitions, with_locator

BLOCK_ROWS = 16
#: Slots that are scheduled as one row; picks that are gathered in one array before it is put aside.
SLICE, GATHER = 4_096, 256
#: Rows of one source under one prefix of the order key, about.
PREFIX_ROWS = 20_000


def order_key(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")))


def sizes(rows: DataFrame, weights: DataFrame | None, block_rows: int) -> DataFrame:
    """(source, i, n, blocks, w). Without given weights a source weighs the square root of its rows (tempered shares)."""
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.floor(F.sqrt("n") * 1000))
    else:
        given = weights.groupBy(F.col("source").alias("g")).agg(F.round(F.sum("weight") * 1_000_000).cast("long").alias("w")).filter("w > 0")
        least = given.agg(F.coalesce(F.min("w"), F.lit(1))).scalar()
        n = n.join(given, n["source"].eqNullSafe(given["g"]), "left").select("source", "n", F.coalesce("w", least).alias("w"))
    # One row a source: a dimension.
    number = F.row_number().over(Window.orderBy(F.col("source").isNotNull(), "source")) - 1
    return n.select("source", number.alias("i"), "n", F.expr(f"(n + {block_rows} - 1) div {block_rows}").alias("blocks"), F.col("w").cast("decimal(19,0)").alias("w"))


def _setting(sources: DataFrame) -> DataFrame:
    """One row: ``src`` (i, w, blocks by source) and ``bends`` of T, in order: from v = blocks / weight (``b`` / ``v``) on,
    T(v) is ``c`` + v * ``rate``."""
    v = F.col("blocks").cast("decimal(18,0)") / F.col("w").cast("decimal(18,0)")
    ends = sources.groupBy(v.alias("at")).agg(F.min(F.struct(F.col("blocks").alias("b"), F.col("w").alias("v"))).alias("as"), F.sum("blocks").alias("blocks"), F.sum("w").alias("w"))
    upto = Window.orderBy("at")
    whole = sources.agg(F.sum("w")).scalar()
    bends = ends.select("at", "as.b", "as.v", F.sum("blocks").over(upto).alias("c"), (whole - F.sum("w").over(upto)).cast("decimal(19,0)").alias("rate"))
    start = sources.agg(F.lit(0).cast("decimal(37,19)").alias("at"), F.lit(0).cast("long").alias("b"), F.lit(1).cast("decimal(19,0)").alias("v"), F.lit(0).cast("long").alias("c"), F.sum("w").cast("decimal(19,0)").alias("rate"))
    listed = start.unionByName(bends.withColumn("at", F.col("at").cast("decimal(37,19)"))).agg(F.array_sort(F.collect_list(F.struct("at", "c", "b", "v", "rate"))).alias("bends"))
    src = sources.agg(F.array_sort(F.collect_list(F.struct("i", "w", "blocks"))).alias("src"))
    return src.select("src", listed.scalar().alias("bends"))


def _slot(k: str, w: str, up: bool) -> str:
    """T(k / w), rounded up or down."""
    product = "cast(({k}) as decimal(19,0)) * p.rate".format(k=k)
    more = f" + {w} - 1" if up else ""
    return f"element_at(transform(slice(filter(bends, p -> cast(p.b as decimal(19,0)) * {w} <= cast(({k}) as decimal(19,0)) * p.v), -1, 1), p -> p.c + ({product}{more}) div {w}), 1)"


def _job(i: str, k: str, w: str, blocks: str) -> str:
    """What a source has to do next; fields are in the order in which released jobs go."""
    return f"named_struct('due', {_slot(f'{k} + 1', w, True)}, 'i', {i}, 'released', {_slot(k, w, False)}, 'k', {k}, 'w', {w}, 'blocks', {blocks})"


#: Where each source stands at slot ``first``: whole blocks of its flow, and one more for the earliest deadlines begun.
_GUESS = f"""
transform(slice(filter(bends, p -> p.c + case when p.v = 0 then 0 else (cast(p.b as decimal(19,0)) * p.rate) div p.v end <= first), -1, 1), o ->
  transform(src, s -> if(cast(o.b as decimal(19,0)) * s.w >= cast(s.blocks as decimal(19,0)) * o.v, named_struct('i', s.i, 'k', s.blocks, 'part', 0L, 'due', 0L),
    transform(array(cast(s.w as decimal(19,0)) * cast(first - o.c as decimal(19,0))), x -> named_struct('i', s.i, 'k', x div o.rate, 'part', cast(x % o.rate as bigint), 'due', {_slot("x div o.rate + 1", "s.w", True)}))[0])))[0]
"""
_ROUNDED = """
transform(array(named_struct('more', first - aggregate(g, 0L, (a, x) -> a + x.k), 'begun', array_sort(transform(filter(g, x -> x.part > 0), x -> named_struct('due', x.due, 'i', x.i))))), y ->
  transform(g, x -> named_struct('i', x.i, 'k', x.k + if(x.part > 0 and array_position(y.begun, named_struct('due', x.due, 'i', x.i)) <= y.more, 1L, 0L))))[0]
"""
_STEP = f"""
transform(array(coalesce(array_min(filter(s.jobs, x -> x.released <= t)), array_min(s.jobs))), p -> named_struct(
  'jobs', filter(transform(s.jobs, x -> if(x.i <> p.i, x, if(x.k + 1 < x.blocks, {_job("x.i", "x.k + 1", "x.w", "x.blocks")}, null))), x -> x is not null),
  'picks', concat(s.picks, array(named_struct('i', p.i, 'k', p.k)))))[0]
"""
_NONE = "cast(array() as array<struct<i: int, k: bigint>>)"
_RUN = f"""
aggregate(sequence(first, last - 1, {GATHER}L), named_struct('jobs', jobs, 'parts', cast(array() as array<array<struct<i: int, k: bigint>>>)),
  (a, low) -> transform(array(aggregate(sequence(low, least(low + {GATHER}, last) - 1), named_struct('jobs', a.jobs, 'picks', {_NONE}), (s, t) -> {_STEP})),
    b -> named_struct('jobs', b.jobs, 'parts', concat(a.parts, array(b.picks))))[0])
"""


def _simulate(slices: DataFrame, setting: DataFrame) -> DataFrame:
    """(slice, first, last, start) plus ``end`` and ``picks``: the schedule of each slice from where its sources start."""
    df = slices.join(F.broadcast(setting), how="cross")  # one row
    df = df.withColumn("jobs", F.expr(f"filter(transform(start, x -> if(x.k < get(src, x.i).blocks, {_job('x.i', 'x.k', 'get(src, x.i).w', 'get(src, x.i).blocks')}, null)), x -> x is not null)"))
    df = df.withColumn("run", F.expr(_RUN))
    # A source without a job left has come to its last block.
    end = F.expr("transform(src, s -> named_struct('i', s.i, 'k', coalesce(get(filter(run.jobs, j -> j.i = s.i), 0).k, s.blocks)))")
    return df.select("slice", "first", "last", "start", end.alias("end"), F.expr("run.parts").alias("parts"))


def schedule(sources: DataFrame, space: Workspace, slice_slots: int = SLICE) -> DataFrame:
    """(i, k, slot): the slot of every block of the sources (i, blocks, w)."""
    spark = sources.sparkSession
    setting = space.save(_setting(sources), "setting")
    total = sources.agg(F.sum("blocks")).first()[0] or 0
    slices = -(-total // slice_slots)
    plain = spark.range(0, slices, 1, max(1, min(slices, 4 * shuffle_partitions(spark)))).select(F.col("id").alias("slice"), (F.col("id") * slice_slots).alias("first"), F.least((F.col("id") + 1) * slice_slots, F.lit(total)).alias("last"))
    guessed = plain.join(F.broadcast(setting), how="cross").withColumn("g", F.expr(_GUESS)).select("slice", "first", "last", F.expr(_ROUNDED).alias("start"))
    done, turn = space.save(_simulate(guessed, setting), "turn0"), 0
    while True:
        before = done.select((F.col("slice") + 1).alias("slice"), F.col("end").alias("begin"))
        wrong = done.select("slice", "first", "last", "start").join(before, "slice").filter("start <> begin").select("slice", "first", "last", F.col("begin").alias("start"))
        wrong = space.save(wrong, f"wrong{turn}")
        if wrong.isEmpty():
            break
        turn += 1
        parts = max(1, shuffle_partitions(spark))
        again = _simulate(wrong.repartition(parts, "slice"), setting)
        done = space.save(done.join(wrong.select("slice"), "slice", "left_anti").unionByName(again), f"turn{turn}")
    picks = done.select("first", F.posexplode("parts").alias("part", "picks")).select("first", "part", F.posexplode("picks").alias("at", "p"))
    return picks.select("p.i", "p.k", (F.col("first") + F.col("part") * GATHER + F.col("at")).alias("slot"))


def ranked(rows: DataFrame, carry: list[str], ties: list[str], most: int, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(id, source, with, rank): ``with`` holds the columns named in carry, ``rank`` is the place inside the source from 0 on."""
    digits = 1
    while most > prefix_rows * 16**digits:
        digits += 1
    tie = F.md5(F.to_json(F.struct(*ties))) if ties else F.lit("")
    # Carried columns stand apart, whatever their names.
    keyed = rows.select("id", "source", F.struct(F.lit(0), *carry).alias("with"), order_key(F.col("id")).alias("key"), tie.alias("tie")).withColumn("prefix", F.substring("key", 1, digits))
    counts = keyed.groupBy("source", "prefix").agg(F.count("*").alias("m"))
    # Prefixes that repeated ids have filled: as many digits of the ties as spread them.
    full = counts.filter(F.col("m") > 4 * prefix_rows).select(F.col("source").alias("f_source"), F.col("prefix").alias("f_prefix"), F.ceil(F.log(16.0, F.col("m") / prefix_rows)).cast("int").alias("more"))
    keyed = keyed.join(broadcast_if_small(full), keyed["source"].eqNullSafe(F.col("f_source")) & (F.col("prefix") == F.col("f_prefix")), "left")
    spread = keyed.withColumn("cell", F.concat("prefix", F.when(F.col("more").isNotNull(), F.expr("substring(tie, 1, more)")).otherwise("")))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = spread.groupBy("source", "cell").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    c = cells.select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), "before")
    inside = spread.withColumn("inside", F.row_number().over(Window.partitionBy("source", "cell").orderBy("key", "id", "tie")) - 1)
    joined = inside.join(c, inside["source"].eqNullSafe(c["c_source"]) & (F.col("cell") == F.col("c_cell")))
    return joined.select("id", "source", "with", (F.col("before") + F.col("inside")).alias("rank"))


def mix(rows: DataFrame, extra: list[str], weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, prefix_rows: int = PREFIX_ROWS, slice_slots: int = SLICE, ties: list[str] | None = None) -> DataFrame:
    """rows has columns ``id``, ``source`` and those named in ``extra``; it is read several times. ``ties`` are columns of
    extra that tell rows of the same id apart, such as a locator. ``weights`` has (source, weight).

    Returns these plus ``block`` (of its source), ``slot`` (of the mix) and ``place`` (inside the block): the mix is the
    order by slot, place.
    """
    space = Workspace(rows.sparkSession, "mixing")
    by_source = space.save(sizes(rows, weights, block_rows), "sources")
    plan = schedule(by_source, space, slice_slots)
    most = by_source.agg(F.max("n")).first()[0] or 0
    named = by_source.select(F.col("source").alias("s_source"), "i")
    blocks = ranked(rows, extra, ties or [], most, prefix_rows)
    blocks = blocks.join(broadcast_if_small(named), blocks["source"].eqNullSafe(named["s_source"])).withColumn("block", F.expr(f"rank div {block_rows}")).withColumn("place", F.expr(f"rank % {block_rows}"))
    p = plan.select(F.col("i").alias("p_i"), F.col("k").alias("p_k"), "slot")
    placed = blocks.join(p, (F.col("i") == F.col("p_i")) & (F.col("block") == F.col("p_k")))
    return placed.select("id", "source", *[F.col("with")[c].alias(c) for c in extra], "block", "slot", F.col("place").cast("long").alias("place"))


def order(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """docs, all rows and columns, dealt so that reading the written files in order gives the mix."""
    spark: SparkSession = docs.sparkSession
    space = Workspace(spark, "mix-order")
    located = with_locator(docs, space)
    thin = located.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col("__ll_file").alias("file"), F.col("__ll_row").alias("row"))
    spots = space.save(mix(thin, ["file", "row"], weights, ties=["file", "row"], **options).select(F.col("file").alias("__ll_m_file"), F.col("row").alias("__ll_m_row"), F.col("slot").alias("__ll_m_slot"), F.col("place").alias("__ll_m_place")), "spots")
    last = spots.agg(F.max("__ll_m_slot")).first()[0] or 0
    parts = shuffle_partitions(spark)
    # Only text moves here, twice: once to its position, once into the order of the mix. Neither exchange samples.
    joined = located.join(spots.hint("shuffle_hash"), (F.col("__ll_file") == F.col("__ll_m_file")) & (F.col("__ll_row") == F.col("__ll_m_row")))
    part = F.expr(f"cast(__ll_m_slot * {parts} div {last + 1} as int)")
    dealt = joined.repartitionById(parts, part).sortWithinPartitions("__ll_m_slot", "__ll_m_place")
    return dealt.select(*[dealt[f"`{c}`"] for c in docs.columns])
