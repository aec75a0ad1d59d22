"""Hard-negative mining: exact top-k search over one-dimensional distance keys.

Method. Vectors are quantised to integers and augmented by one coordinate that gives all of them the same length, so that the
largest inner products with an anchor are the smallest distances to it. Pivots are data vectors, taken far apart from a bounded
sample; each row is stored with its nearest pivot, sorted by (pivot, distance to it) and cut into blocks. For an anchor at
distance d of a pivot, rows within r of the anchor have keys in [d - r, d + r] (triangle inequality): an annulus, stored
together. A search scans the key intervals of a first radius at all pivots, then widens it; no block is scanned twice. It ends
for an anchor once nothing beyond the radius can change its result: its k-th best is no farther than the radius, or
the radius has reached the far end of what counts. So results are those of all rows against all anchors, however few blocks
were scanned.

First the positives are searched (nearest rows of the anchor's label), then the negatives of all positives of an anchor at once:
rows of other labels whose score lies in a window that the positive's score gives. The window's far end bounds the radius;
its near end lets blocks aside that lie wholly inside it.

Scale. Rows are shuffled once, into ranges of (pivot, distance, id), so that any number of equal vectors is split like others.
Blocks, and groups of anchors that are near to each other, are rows of bounded size; a group meets a block that it
needs in a shuffled join, and only the best k of an anchor in a block go on, cut again before the shuffle of the merge. The
directory of blocks meets the groups on the pivot. Rounds write tables, so a lost executor repeats a part of one round. What
passes the driver is the pivots' sample. The annuli of vectors without structure (random ones of 64 components, say) hold nearly
all rows: then this is a scan of all blocks for all groups of anchors, as any exact search is.

Defined results. Rows with a null id or label, a null or empty vector or a null or non-finite component take no part, nor do rows
with a component beyond 2^28 after quantisation, whose products would leave 64 bits. Shorter vectors count as padded by
zeros. "Other rows" are rows of another id; rows that repeat an id take part as rows of their own, and anchors that repeat
id, label and vector are searched once. Ties go to the smaller id. An anchor without positives or a positive without
negatives gives no rows; a negative score has no window. An empty table gives none. Extra columns are ignored whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, settings

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Scores of negatives in hundredths of the positive's: least and greatest.
LEAST, MOST = 50, 95
#: Pivots and the rows of the sample they come from; rows of a block; bits of an anchor's place in its group.
PIVOTS, SAMPLE, BLOCK, GROUP_BITS = 32, 2_000, 16_384, 9
#: Bytes of pairs of a group and a block that a Python worker takes at a time.
PAIR_BYTES = 64 << 20
HUGE = 1 << 28


def prepare(rows: DataFrame, id_col: str, vector_col: str, label_col: str, space: Workspace) -> DataFrame:
    """Written table (id, label, vector, norm): quantised rows that take part; norm is the squared length."""
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * SCALE))
    usable = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < HUGE))
    known = rows.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.size(F.col(f"`{vector_col}`")) > 0) & usable)
    found = known.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.cast("array<long>").alias("vector"))
    return space.save(found.withColumn("norm", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)), "rows")


def choose_pivots(vectors: np.ndarray, k: int) -> np.ndarray:
    """k of the vectors, each the farthest from those before it; fewer if fewer differ."""
    picked = [0]
    least = ((vectors - vectors[0]) ** 2).sum(1)
    while len(picked) < k and least.max() > 0:
        picked.append(int(least.argmax()))
        least = np.minimum(least, ((vectors - vectors[picked[-1]]) ** 2).sum(1))
    return vectors[picked]


class Geometry:
    """Pivots in the augmented space, in which every row has the squared length ``top``. Anchors have no augmented coordinate."""

    def __init__(self, pivots: np.ndarray, top: int):
        self.pivots, self.top, self.dim = pivots, float(top), pivots.shape[1]
        #: Distances are rounded; bounds give way by this much.
        self.slack = 1e-6 * (1.0 + float(np.sqrt(top)))

    def matrix(self, vectors: pa.Array, extra: np.ndarray | None = None) -> np.ndarray:
        """Rows of a list column as a matrix, padded, with the augmented coordinate if ``extra`` gives the squared lengths."""
        flat, at = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        sizes = np.diff(at)
        out = np.zeros((len(vectors), self.dim))
        line = np.repeat(np.arange(len(vectors)), sizes)
        out[line, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
        if extra is not None:
            out[:, -1] = np.sqrt(np.maximum(self.top - extra, 0.0))
        return out

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To each pivot. By differences, pivot by pivot: close points keep their small distances."""
        return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in self.pivots], 1)


def geometry(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> tuple[Geometry, float] | None:
    """Pivots fitted on the ``sample`` rows whose hash is least, and half the median distance to them; None if there are no rows."""
    top, longest = rows.agg(F.max("norm"), F.max(F.size("vector"))).first()
    if top is None:
        return None
    few = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(sample).select("vector", "norm").collect()
    blank = Geometry(np.zeros((1, longest + 1)), top)
    points = blank.matrix(pa.array([r["vector"] for r in few], pa.list_(pa.int64())), np.array([float(r["norm"]) for r in few]))
    found = Geometry(choose_pivots(points, pivots), top)
    return found, float(np.median(found.distances(points).min(1))) / 2


_KEYED = "id long, label long, vector array<long>, norm long, ds array<double>, pivot int, distance double"


def _keyed(rows: DataFrame, g: Geometry, augmented: bool) -> DataFrame:
    """rows in the order of (nearest pivot, distance, id) within and across partitions, with their distances to all pivots."""
    shared = rows.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = shared.value.distances(shared.value.matrix(b.column("vector"), b.column("norm").to_numpy().astype(float) if augmented else None))
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            ds = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, ds, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], [*b.schema.names, "ds", "pivot", "distance"])

    order = ["pivot", "distance", "id"]
    return rows.select("id", "label", "vector", "norm").mapInArrow(run, _KEYED).repartitionByRange(*order).sortWithinPartitions(*order)


_BLOCKS = "pivot int, low double, high double, ids array<long>, labels array<long>, vectors array<array<long>>"


def index(rows: DataFrame, g: Geometry, space: Workspace, size: int = BLOCK) -> DataFrame:
    """Written blocks of rows stored by (pivot, distance): block, pivot, low and high distance, ids, labels, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def block(part: pa.Table) -> pa.RecordBatch:
            d = part["distance"].to_numpy()
            row = {"pivot": [part["pivot"][0].as_py()], "low": [float(d[0])], "high": [float(d[-1])]}
            one = lambda name, kind: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part[name].combine_chunks().cast(kind))
            return pa.RecordBatch.from_arrays([pa.array(row["pivot"], pa.int32()), pa.array(row["low"]), pa.array(row["high"]), one("id", pa.int64()), one("label", pa.int64()), one("vector", pa.list_(pa.int64()))], ["pivot", "low", "high", "ids", "labels", "vectors"])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while len(held):
                pivots = held["pivot"].to_numpy()
                n = int(np.searchsorted(pivots, pivots[0], "right"))
                if n == len(held) and n < size:
                    break  # may go on in the next batch
                yield block(held.slice(0, min(n, size)))
                held = held.slice(min(n, size))
        if held is not None and len(held):
            yield block(held)

    blocks = _keyed(rows, g, True).drop("norm", "ds").mapInArrow(run, _BLOCKS)
    return space.save(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def anchors_of(rows: DataFrame, g: Geometry, space: Workspace, bits: int = GROUP_BITS) -> DataFrame:
    """Written table of anchors: number (``a``), group, id, label, vector, norm, ds (distances to the pivots)."""
    numbered = _keyed(rows.distinct(), g, False).drop("pivot", "distance").withColumn("a", F.monotonically_increasing_id())
    return space.save(numbered.withColumn("grp", F.shiftright("a", bits)), "anchors")


#: What an anchor searches: slots of scores from least to most.
_SLOTS = "array<struct<slot:int,least:long,most:long>>"
_FOUND = "a long, slot int, id long, score long"


def _scan(shared, k: int, same: bool):
    """Of pairs of a group of anchors and a block: the best k rows of the block in each slot of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        kind = np.float64 if g.top < 1 << 53 else np.int64  # products are exact
        for b in batches:
            for r in range(b.num_rows):
                ids, labels = (b.column(n)[r].values.to_numpy() for n in ("ids", "labels"))
                rows = g.matrix(b.column("vectors")[r].values)[:, :-1].astype(kind)
                some = b.column("anchors")[r].values
                of = {n: some.field(n) for n in ("a", "id", "label", "vector", "slots")}
                scores = g.matrix(of["vector"])[:, :-1].astype(kind) @ rows.T
                allowed = labels[None, :] == of["label"].to_numpy()[:, None]
                allowed = (allowed if same else ~allowed) & (ids[None, :] != of["id"].to_numpy()[:, None])
                out = []
                for a, slots, score, ok in zip(of["a"].to_pylist(), of["slots"].to_pylist(), scores, allowed, strict=True):
                    for s in slots:
                        at = np.flatnonzero(ok & (score >= s["least"]) & (score <= s["most"]))
                        if len(at) > k:
                            at = at[score[at] >= np.partition(score[at], -k)[-k]]
                        at = at[np.lexsort((ids[at], -score[at]))[:k]]
                        out += [(a, s["slot"], int(i), int(x)) for i, x in zip(ids[at], score[at], strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["a", "slot", "id", "score"])  # noqa: B905

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each slot of each anchor: (a, slot, rank, id, score)."""
    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("a", "slot", "rank", "id", "score")


def search(anchors: DataFrame, wanted: DataFrame, blocks: DataFrame, g: Geometry, k: int, same: bool, space: Workspace, name: str) -> tuple[DataFrame, list[int]]:
    """The k best rows of each slot (see ``best``), and how many pairs of a group and a block each round scanned.

    ``wanted``: a, slots, near and far (distances that bound what counts), radius (the first). ``same``: whether rows have the anchor's
    label or any other.
    """
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(g)
    directory = blocks.select("block", F.col("pivot").alias("b_pivot"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    active, found, scanned, rounds = space.save(wanted, f"{name}-wanted-0"), None, None, []
    while not active.isEmpty():
        t = len(rounds)
        of = active.join(anchors.select("a", "grp", "id", "label", "vector", "norm", "ds"), "a")
        keys = of.select("grp", "radius", "near", F.posexplode("ds").alias("pivot", "d")).groupBy("grp", "pivot")
        reach = keys.agg((F.min(F.col("d") - F.col("radius")) - g.slack).alias("low"), (F.max(F.col("d") + F.col("radius")) + g.slack).alias("high"), F.max("d").alias("d"), (F.min("near") - g.slack).alias("near"))
        meets = (F.col("pivot") == F.col("b_pivot")) & (F.col("b_high") >= F.col("low")) & (F.col("b_low") <= F.col("high")) & (F.col("d") + F.col("b_high") >= F.col("near"))
        pairs = reach.join(directory, meets).select("grp", "block")
        if scanned is not None:
            pairs = pairs.join(scanned, ["grp", "block"], "left_anti")
        pairs = space.save(pairs, f"{name}-pairs-{t}")
        rounds.append(pairs.count())
        scanned = pairs if scanned is None else scanned.unionByName(pairs)
        groups = of.groupBy("grp").agg(F.collect_list(F.struct("a", "id", "label", "vector", "slots")).alias("anchors"))  # at most 2^bits
        met = pairs.join(groups, "grp").join(blocks.select("block", "ids", "labels", "vectors"), "block").select("ids", "labels", "vectors", "anchors")
        with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(PAIR_BYTES)}):
            new = space.save(met.mapInArrow(_scan(shared, k, same), _FOUND), f"{name}-found-{t}")
        found = space.save(best(new if found is None else found.drop("rank").unionByName(new), k), f"{name}-best-{t}")
        # How far the k-th best of the slots is; as far as anything counts where there are fewer.
        last = found.filter(F.col("rank") == k).groupBy("a").agg(F.min("score").alias("worst"), F.count("*").alias("full"))
        still = of.select(*active.columns, "norm").join(last, "a", "left")
        at = F.sqrt(F.greatest(F.col("norm") + F.lit(g.top) - 2 * F.col("worst"), F.lit(0.0)))
        whole = F.coalesce(F.col("full"), F.lit(0)) == F.size("slots")
        needs = F.when(whole, F.least(at, F.col("far"))).otherwise(F.col("far"))
        wider = F.when(whole, needs).otherwise(F.least(2 * F.col("radius"), F.col("far")))
        active = space.save(still.filter(F.col("radius") < needs).withColumn("radius", wider).select(*active.columns), f"{name}-wanted-{t + 1}")
    empty = spark.createDataFrame([], "a long, slot int, rank int, id long, score long")
    return (empty if found is None else found), rounds


def mine(rows: DataFrame, is_anchor: str, space: Workspace, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, bits: int = GROUP_BITS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``is_anchor`` is a condition on ``id``."""
    known = prepare(rows, id_col, vector_col, label_col, space)
    fitted = geometry(known, pivots, sample)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    g, first = fitted
    blocks, anchors = index(known, g, space, block), anchors_of(known.filter(is_anchor), g, space, bits)
    farthest = 2.0 * float(np.sqrt(g.top)) + g.slack
    anywhere = F.array(F.struct(F.lit(0).alias("slot"), F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("most"))).cast(_SLOTS)
    wanted = anchors.select("a", anywhere.alias("slots"), F.lit(0.0).alias("near"), F.lit(farthest).alias("far"), F.lit(max(first, g.slack)).alias("radius"))
    near, _ = search(anchors, wanted, blocks, g, positives, True, space, "positives")
    # Scores n of negatives: LEAST * p <= 100 * n <= MOST * p.
    windows = near.filter("score >= 0").select("a", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = windows.selectExpr("*", f"({LEAST} * positive_score + 99) div 100 AS least", f"({MOST} * positive_score) div 100 AS most").filter("least <= most")
    windows = space.save(windows.join(anchors.select("a", F.col("id").alias("anchor_id"), "norm"), "a"), "windows")
    at = lambda c: F.sqrt(F.greatest(F.col("norm") + F.lit(g.top) - 2 * F.col(c), F.lit(0.0)))
    wanted = windows.groupBy("a").agg(F.collect_list(F.struct("slot", "least", "most")).cast(_SLOTS).alias("slots"), F.min(at("most")).alias("near"), (F.max(at("least")) + g.slack).alias("far"), F.max(at("most")).alias("begin"))
    wanted = wanted.withColumn("radius", (F.col("begin") + F.col("far")) / 2).drop("begin")
    found, _ = search(anchors, wanted, blocks, g, negatives, False, space, "negatives")
    result = found.join(windows.select("a", "slot", "anchor_id", "positive_id", "positive_score"), ["a", "slot"])
    return result.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
