"""Near-duplicates by SimHash fingerprints, found with anchor-point covering.

Fingerprint. Of the XXH64 hashes (seed 42) of a document's 4-word shingles, bit i is 1 if it is set in over half.

Method. Fingerprints at 4 or fewer differing bits link. Such a pair differs in at most 2 bits in one of the two 32-bit
halves, so each half is searched for pairs within t = 2. Anchors of a half are the words of a covering code: the perfect
Hamming code of length 31 with bit 31 free, covering radius R = 1, 2^27 anchors. A fingerprint is replicated to every
anchor within R plus its part of the threshold: two words within t have a midpoint within t/2 of both and an anchor
within R of that midpoint, so R + t/2 = 2 meets every pair (R + t would find the same pairs ten times as often). That is
16.5 anchors a half on average. All fingerprints at an anchor are compared, over all 64 bits.

An anchor with more than ``CROWD`` fingerprints, which only crowds of nearly equal texts make, is searched again with
the anchors of its other half, where the rest of the threshold, t = 4, needs radius R + 2 = 3.

Scale. Equal fingerprints are one node, so copies cost nothing. Replicas are 33 a distinct fingerprint, always, and are
sorted by anchor; a task holds one anchor at a time. Of a large anchor only a spanning forest of its links leaves the
task, never all pairs. Components come from alternating large-star and small-star steps on written tables; the tables
are distributed, nothing of the corpus goes to the driver.

Defined results. Null text counts as empty; a text without words has fingerprint 0, which links like any other; fewer than
4 words are one shingle. Rows with null ids are linked but never name a component (null if all ids in it are null).
Repeated rows share a component; very long texts are hashed in parts of bounded size. An empty table gives no rows. Extra
columns are ignored or carried whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, join_hot, shuffle_partitions, with_locator

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Replication radius of a half: covering radius 1 plus half of its threshold 2. 3, covering radius plus threshold, finds the same.
RADIUS = 2
CROWD = 20_000
#: Up to this many fingerprints at an anchor are compared pair by pair in one vector operation per offset.
FEW = 48
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    # bytes.lower() changes A-Z only and bytes.split() splits at ASCII white space only.
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else iter([b" ".join(w)])  # noqa: B905
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        h = np.fromiter(hashes, np.uint64, min(CHUNK, n - start))
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """(carry..., fp): fp is the fingerprint's bits as a signed long."""
    schema = docs.select(*carry).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], names=[*carry, "fp"])

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("__ll_text"), *carry).mapInArrow(run, schema)


def _masks(radius: int) -> list[np.ndarray]:
    """By syndrome (of the low 31 bits): what to flip in a 32-bit word to get each anchor within ``radius``."""
    found: list[list[int]] = [[] for _ in range(32)]
    for weight in range(radius + 1):
        for places in combinations(range(1, 32), weight):
            syndrome, mask = 0, 0
            for p in places:
                syndrome ^= p
                mask |= 1 << (p - 1)
            found[syndrome].append(mask)
            if weight < radius:
                found[syndrome].append(mask | 1 << 31)
    return [np.array(x, np.uint32) for x in found]


_CHECKS = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
_WITHIN = {r: _masks(r) for r in (2, 3)}


def _anchors(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into half, anchor) for every anchor within radius of each 32-bit word."""
    syndrome = np.zeros(len(half), np.uint8)
    for k, check in enumerate(_CHECKS):
        syndrome |= (np.bitwise_count(half & check) & 1).astype(np.uint8) << k
    at, out = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    for s, masks in enumerate(_WITHIN[radius]):
        i = np.flatnonzero(syndrome == s)
        at.append(np.repeat(i, len(masks)))
        out.append((half[i][:, None] ^ masks[None, :]).ravel())
    return np.concatenate(at), np.concatenate(out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x.astype(np.uint64)).view(np.int64))


def _replicate(radius: int):
    """mapInArrow function fp -> (key, sub, fp) for each half's anchors within radius; bit 32 of the key names the half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                i, anchor = _anchors((fps >> np.uint64(32 * half)).astype(np.uint32), radius)
                key = anchor.astype(np.uint64) | np.uint64(half << 32)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(np.zeros(len(i), np.int64)), _signed(fps[i])], names=["key", "sub", "fp"])

    return run


def _replicate_crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) of crowded anchors -> (key, sub, fp): the other half's anchors within 3."""
    for b in batches:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        other = np.where(keys >> 32 & 1, fps, fps >> np.uint64(32)).astype(np.uint32)
        for start in range(0, len(fps), 4096):  # about 170 replicas each
            i, anchor = _anchors(other[start : start + 4096], 3)
            yield pa.RecordBatch.from_arrays([pa.array(keys[start + i]), pa.array(anchor.astype(np.int64)), _signed(fps[start + i])], names=["key", "sub", "fp"])


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what pairs within DISTANCE connect, each fingerprint reached once."""
    left, links = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found, left = left[near], left[~near]
                links += [(x, y) for y in found]
                queue += list(found)
    return links


def _linker(crowd: int):
    """mapInArrow function over rows sorted by (key, sub): kind 0 is a link (a, b), kind 1 a fingerprint b put off with its crowded anchor a."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64))], names=["kind", "a", "b"])

    def compare(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole anchors: key has one number for each."""
        if len(fp) < 2:
            return
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        few = np.repeat(lengths <= FEW, lengths)
        k, f = key[few], fp[few]
        for step in range(1, FEW):
            same = k[step:] == k[:-step] if step < len(k) else np.zeros(0, bool)
            if not same.any():
                break
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(f[i] ^ f[i + step]) <= DISTANCE]
            if len(i):
                yield out(0, f[i], f[i + step])
        for s, n in zip(starts[lengths > FEW], lengths[lengths > FEW], strict=True):
            if links := _forest(fp[s : s + n]):
                yield out(0, np.array([x for x, _ in links], np.uint64), np.array([y for _, y in links], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, subs, fps = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        put_off = None  # anchor whose rows are being put off
        for b in batches:
            k, s, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f = f.view(np.uint64)
            if put_off is not None:
                of = k == put_off
                if of.any():
                    yield out(1, k[of], f[of])
                    k, s, f = k[~of], s[~of], f[~of]
                if not len(k):
                    continue
                put_off = None
            keys, subs, fps = np.r_[keys, k], np.r_[subs, s], np.r_[fps, f]
            change = np.flatnonzero((keys[1:] != keys[:-1]) | (subs[1:] != subs[:-1]))
            cut = change[-1] + 1 if len(change) else 0
            if cut:
                number = np.cumsum(np.r_[0, (keys[1:cut] != keys[: cut - 1]) | (subs[1:cut] != subs[: cut - 1])])
                yield from compare(number, fps[:cut])
                keys, subs, fps = keys[cut:], subs[cut:], fps[cut:]
            if crowd and len(keys) > crowd:
                put_off = keys[0]
                yield out(1, keys, fps)
                keys, subs, fps = keys[:0], subs[:0], fps[:0]
        yield from compare(np.zeros(len(fps), np.int64), fps)

    return run


_LINKS = "kind int, a long, b long"


def links(fps: DataFrame, space: Workspace, crowd: int = CROWD, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect exactly what all pairs within DISTANCE connect."""
    parts = shuffle_partitions(fps.sparkSession)

    def search(replicas: DataFrame, limit: int, name: str) -> DataFrame:
        return space.save(replicas.repartition(parts, "key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_linker(limit), _LINKS), name)

    found = search(fps.select("fp").mapInArrow(_replicate(radius), "key long, sub long, fp long"), crowd, "links")
    crowded = found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    edges = found.filter("kind = 0")
    if not crowded.isEmpty():
        # Words within R + 3 of two anchors: their number has a bound that doesn't depend on the corpus.
        edges = edges.unionByName(search(crowded.mapInArrow(_replicate_crowd, "key long, sub long, fp long"), 0, "crowd").filter("kind = 0"))
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the smallest node reachable."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        joined = both.join(least, F.col("a") == F.col("n"))
        if large:  # larger neighbours to the least neighbour
            return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # smaller neighbours and the node itself to the least neighbour
        return joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    e, turn = space.save(edges.filter("a > b"), "edges0"), 0
    now = state(e)
    while now[0]:
        turn += 1
        e = space.save(star(star(e, True), False), f"edges{turn}")
        before, now = now, state(e)
        space.drop(f"edges{turn - 1}")
        if before == now:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), space: Workspace | None = None, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, the columns named in carry, fp (signed long), root (the component's key), component_id."""
    space = space or Workspace(docs.sparkSession, "simhash")
    rows = space.save(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("__in"), *carry), "__in", ["id", *carry]), "fingerprints")
    nodes = space.save(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, space, crowd), space)
    of_root = space.save(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "of-root")
    named = space.save(of_root.groupBy(F.col("root").alias("n_root")).agg(F.min("least").alias("component_id"), F.count("*").alias("fps"), F.sum("n").alias("rows")), "components")
    fps, total = named.agg(F.coalesce(F.sum("fps"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    # Components of many fingerprints and fingerprints of many rows don't meet in one task.
    of_fp = join_hot(of_root, named.select("n_root", "component_id", "fps"), "root", "n_root", "fps", fps).select(F.col("fp").alias("n_fp"), "root", "component_id", "n")
    return join_hot(rows, space.save(of_fp, "named"), "fp", "n_fp", "n", total).select("id", *carry, "fp", "root", "component_id")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id, then the first by locator."""
    space = Workspace(docs.sparkSession, "simhash")
    located = with_locator(docs, space)
    thin = located.select(F.col(f"`{id_col}`").alias("__ll_id"), F.col(f"`{text_col}`").alias("__t"), F.col("__ll_file"), F.col("__ll_row"))
    rows = space.save(groups(thin, "__ll_id", "__t", ("__ll_file", "__ll_row"), space), "rows")
    # Every component has a row with its id, several only if that id repeats in it.
    first = rows.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("__ll_file", "__ll_row")).alias("stays"))
    stay = first.select("stays.*").select(F.col("__ll_file").alias("s_file"), F.col("__ll_row").alias("s_row"))
    gone = space.save(rows.join(stay, (F.col("__ll_file") == F.col("s_file")) & (F.col("__ll_row") == F.col("s_row")), "left_anti").select(F.col("__ll_file").alias("__ll_g_file"), F.col("__ll_row").alias("__ll_g_row")), "gone")
    left = located.join(broadcast_if_small(gone), (F.col("__ll_file") == F.col("__ll_g_file")) & (F.col("__ll_row") == F.col("__ll_g_row")), "left_anti")
    return left.select(*[left[f"`{c}`"] for c in docs.columns])
