"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Views. Text: shares of character classes (by byte), word lengths, distinct words, repeated lines. Metadata: language,
source and length class, hashed to one-hot features; it never sees the text.

Method. Each view has a logistic classifier, first fitted to its part of the labelled rows. In every round each one scores
all rows that are not in the labelled sample and were not taken before; its most confident answers, as many of each class as
the labels' proportions ask and only where it is surer than the labels' own share of that class, become pseudo-labels in the
*other* view's training set. After the last round both are calibrated (Platt scaling) on labelled rows kept aside, and a
logistic combination of the two calibrated log-odds, fitted on the same rows, scores all documents.

Learning is on at most ``LABELLED`` labelled rows (a documented parameter), those with the lowest id hashes, none of them held
out (crc32 of the id as text, mod 5, is 0). Unlabelled rows have no bound: every round reads them all.

Scale. Texts are read once: features are written (about a quarter of the texts' size) and all rounds and the scoring read
them. A round is one narrow pass in which a task keeps its best ``PER_ROUND`` answers by view and class; Spark merges these
to the best overall, and only their features come to the driver, as many at every size of the corpus. Sums over rows are
linear in the text, also for very long ones.

Defined results. Null text counts as empty; null language or source are values of their own. Without labels of both
classes every document scores 1 (nothing is rejected without evidence). Answers of equal confidence are taken in the order
of id hashes. Repeated rows are scored one by one; of repeated ids among the labelled rows one row is learned from; a null
id is held out. An empty table gives no rows. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

LABELLED, ROUNDS, PER_ROUND = 6_000, 5, 200
META = 128
#: Rows of a batch that are turned into features at a time.
ROWS = 1_000


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def text_view(text: str) -> np.ndarray:
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w = max(1, len(words))
    ascii_part = c[32:127]  # each printable sign by itself
    groups = [c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum(), c[9:14].sum(), c[32]]
    shape = [len(set(words)) / w, sum(map(len, words)) / w / 10, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 10, len(words) < 50, len(words) < 5]
    return np.r_[1.0, np.sqrt(ascii_part), groups, shape]


def meta_view(lang: str | None, source: str | None, length: int | None) -> np.ndarray:
    x = np.zeros(META)
    x[0] = 1.0
    size = "none" if length is None else str(int(length).bit_length())
    for value in (f"lang={lang}", f"source={source}", f"size={size}"):
        x[1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (META - 1)] = 1.0
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton's method with an L2 penalty (not on the first column, the bias)."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # (a, b) by view
    combine: np.ndarray  # bias, text, meta

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and their combination."""
        z = [self.platt[i, 0] + self.platt[i, 1] * (x @ w) for i, (x, w) in enumerate(((xt, self.text), (xm, self.meta)))]
        return _sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.combine[0] + self.combine[1] * z[0] + self.combine[2] * z[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            b = whole.slice(start, ROWS)
            t = [text_view(x.as_py() or "").astype(np.float32) for x in b.column(0)]
            m = [np.flatnonzero(meta_view(*x)).astype(np.int32) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[4:], pa.array(t, pa.list_(pa.float32())), pa.array(m, pa.list_(pa.int32()))], names=[*b.schema.names[4:], "t", "m"])


def features(docs: DataFrame, space: Workspace) -> DataFrame:
    """Written table (id, held_out, h, n, t, m): of each row of docs (doc_id, text, lang, source, n_chars) its views; h is the
    id's hash and n a number of its own. m lists the metadata features that are 1."""
    read = docs.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"),
        F.col("doc_id").alias("id"), held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id").alias("h"), F.monotonically_increasing_id().alias("n"),
    )
    schema = read.select("id", "held_out", "h", "n").schema.add("t", T.ArrayType(T.FloatType())).add("m", T.ArrayType(T.IntegerType()))
    return space.save(read.mapInArrow(_features, schema), "features")


def _views(t: pa.Array, m: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Dense matrices of both views."""
    xt = t.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1 if len(t) else 1)
    xm = np.zeros((len(m), META))
    xm[np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy())), m.flatten().to_numpy()] = 1.0
    return xt, xm


def _kinds(share: float, per_round: int) -> list[tuple[int, int, int, float]]:
    """(view, label, how many, least confidence) of the answers that a round takes, in the order in which they are taken."""
    return [(i, label, n, max(0.9, share if label else 1 - share)) for i in (0, 1) for label, n in ((1, round(per_round * share)), (0, round(per_round * (1 - share))))]


def _best(table: DataFrame, weights: list[np.ndarray], kinds: list[tuple[int, int, int, float]], taken: set[int]) -> DataFrame:
    """(kind, sure, h, n): by kind the most confident rows of the table, enough of them even if every other kind takes first."""
    most = sum(k[2] for k in kinds)
    shared = table.sparkSession.sparkContext.broadcast((weights, np.array(sorted(taken), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, gone = shared.value
        held = [np.empty((0, 3)) for _ in kinds]
        ids = [np.empty((0, 2), np.int64) for _ in kinds]
        for b in batches:
            h, n = (b.column(i).to_numpy() for i in (0, 1))
            xs = _views(b.column(2), b.column(3))
            free = ~np.isin(n, gone)
            p = [_sigmoid(x @ v) for x, v in zip(xs, w, strict=True)]
            for j, (i, label, _, floor) in enumerate(kinds):
                sure = p[i] if label else 1 - p[i]
                at = free & (sure >= floor)
                s, k = np.r_[held[j][:, 0], sure[at]], np.r_[ids[j], np.c_[h[at], n[at]]]
                top = np.lexsort((k[:, 1], k[:, 0], -s))[:most]
                held[j], ids[j] = s[top][:, None], k[top]
        for j in range(len(kinds)):
            if len(ids[j]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids[j]), j, np.int32)), pa.array(held[j][:, 0]), pa.array(ids[j][:, 0]), pa.array(ids[j][:, 1])], names=["kind", "sure", "h", "n"])

    found = table.select("h", "n", "t", "m").mapInArrow(run, "kind int, sure double, h long, n long")
    # Four groups, of ``most`` rows a task; a rank limit keeps as many of each before and after the exchange.
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("sure"), "h", "n"))
    return found.withColumn("place", place).filter(F.col("place") <= most).orderBy("kind", "place").select("kind", "n")


def _fetch(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """(first column, text view, metadata view) of a bounded number of rows (first, t, m)."""
    got = rows.collect()
    t = pa.array([r["t"] for r in got], pa.list_(pa.float32()))
    m = pa.array([r["m"] for r in got], pa.list_(pa.int32()))
    return [r[0] for r in got], *_views(t, m)


def train(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model | None:
    """table is that of ``features``; labels has doc_id, quality. None without labels of both classes."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("l_id"), "l_id").limit(labelled)
    mine = table.join(F.broadcast(chosen), F.col("id") == F.col("l_id")).groupBy("l_id", "y", "h").agg(F.min_by(F.struct("n", "t", "m"), "n").alias("x"))
    first, xt, xm = _fetch(mine.orderBy("h", "l_id").select(F.struct("y", "x.n").alias("first"), "x.t", "x.m"))
    y = np.array([f["y"] for f in first])
    if len(set(y)) < 2:
        return None
    aside = np.arange(len(y)) % 4 == 0
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside = np.zeros(len(y), bool)
    own = [([x[~aside]], [y[~aside]]) for x in (xt, xm)]
    weights = [fit(np.vstack(a), np.concatenate(b)) for a, b in own]
    kinds, taken = _kinds(float(y[~aside].mean()), per_round), {f["n"] for f in first}
    for _ in range(rounds):
        label_of: dict[int, tuple[int, int]] = {}  # row -> (the view that answers, its answer)
        left = [k[2] for k in kinds]
        for r in _best(table, weights, kinds, taken).collect():
            if left[r["kind"]] and r["n"] not in label_of:
                label_of[r["n"]] = kinds[r["kind"]][:2]
                left[r["kind"]] -= 1
        if not label_of:
            break
        taken |= set(label_of)
        wanted = table.sparkSession.createDataFrame([(n,) for n in label_of], "w_n long")
        ns, ut, um = _fetch(table.join(F.broadcast(wanted), F.col("n") == F.col("w_n")).orderBy("h", "n").select("n", "t", "m"))
        for i in (0, 1):
            at = np.array([label_of[n][0] == i for n in ns])
            own[1 - i][0].append((um, ut)[i][at])
            own[1 - i][1].append(np.array([float(label_of[n][1]) for n, a in zip(ns, at, strict=True) if a]))
        weights = [fit(np.vstack(a), np.concatenate(b)) for a, b in own]
    test = aside if aside.any() else np.ones(len(y), bool)
    z = [x[test] @ w for x, w in zip((xt, xm), weights, strict=True)]
    platt = np.array([fit(np.c_[np.ones(len(v)), v], y[test], 1e-2) for v in z])
    cal = [a + b * v for (a, b), v in zip(platt, z, strict=True)]
    return Model(weights[0], weights[1], platt, fit(np.c_[np.ones(len(cal[0])), cal[0], cal[1]], y[test], 1e-2))


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of a table of ``features``: doc_id, held_out, p_text, p_meta, score, kept."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    named = table.select(F.col("id").alias("doc_id"), "held_out", "t", "m")
    schema = T.StructType([*named.schema[:2], *[T.StructField(n, T.DoubleType()) for n in ("p_text", "p_meta", "score")], T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.scores(*_views(b.column(2), b.column(3))) if shared.value and b.num_rows else [np.ones(b.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, p), pa.array(p[2] >= 0.5)], names=schema.names)

    return named.mapInArrow(run, schema)
