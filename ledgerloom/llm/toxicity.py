"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Method. A token that doesn't look like plain writing (digits or signs at or inside a word, doubled letters), and every run
of single characters set apart by spaces, becomes a lattice: each character can stand for the letters it is used for in
disguise, separators and repeats can be dropped, each at a channel cost. A walk of the toxic words' trie over the lattice
finds the windows between signs (between any characters in a spaced run), of whatever length, that can mean a toxic word
at all. Viterbi search with a character language model then finds the likeliest intended word of each such window; one
without letters may also be a number as written. Words of the text as written and as restored are looked up among the toxic words
learned from labels, and a logistic model of these gives the score.

Learning. From all labelled rows that aren't held out (in the word counts exact copies count once, as toxic if one of them is):
words that toxic documents hold far more often than chance make the lexicon, however few documents they are if not one of all
words would get there by chance; the language model is counted over all their words and, with a higher weight, over the
lexicon. Only text is an input; language, source, id and labels are not.

Scale. Word counts are a Spark aggregation; the logistic model is Spark's, over the counts of each set of lexicon words and label. Both
counts are written once, so that labelled texts are read twice, however often the counts are. What
reaches the driver is the lexicon and the counts of runs of ``CONTEXT`` + 1 letters, not words: an alphabet bounds them. Scoring is narrow, in Arrow batches, without a shuffle; tokens and windows of up to ``REMEMBERED`` characters are remembered per worker up to ``MEMORY``
entries each. The walk keeps one state, the cheapest, for a trie node at a position, so work is linear in the text.

Defined results. Null text counts as empty and scores like a text without any toxic word. Without labels of both classes
every score is 0. Repeated rows are scored one by one; a null id is held out. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import broadcast_if_small
from .common import Workspace

MEMORY = 200_000
#: Letters of context of the language model; longest token that is remembered (longer ones are looked up each time).
CONTEXT, REMEMBERED = 3, 32

#: Letters that a character stands for in disguise.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "£": "l", "€": "e", "¡": "i",
}
#: Characters that are set between letters or hide one.
SEPARATORS, MASKS = frozenset(" .-_~'`·,:;/\\^=*#%&"), frozenset("*#%?&")
#: Signs that can be punctuation, not letters, at the ends of a window.
PUNCTUATION = frozenset("!¡?(<|+")
#: Channel costs (negative log probabilities): a substitution, a masked letter, a dropped separator, a dropped repeat.
SWAP, MASK, GAP, REPEAT = 1.0, 3.5, 0.5, 0.7
#: Costs of a number as written: that it is one, each digit, each sign.
NUMBER, DIGIT, SIGN = 3.0, math.log(10), math.log(32)

_PLAIN = re.compile(r"[^\W\d_]+\Z")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_EDGES = ".,;:!?\"'()[]{}<>*#%&$|~-_+=/\\`"


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


class LanguageModel:
    """Log probability of a letter after up to CONTEXT letters; shorter contexts are interpolated (Witten-Bell).

    runs: (letters before, letter, weight) of words that are counted already, see ``letter_runs``.
    """

    def __init__(self, weights: dict[str, float], runs: Iterable[tuple[str, str, float]] = ()):
        self.counts: dict[str, dict[str, float]] = {}
        for before, letter, n in runs:
            for k in range(len(before) + 1):
                c = self.counts.setdefault(before[len(before) - k :], {})
                c[letter] = c.get(letter, 0.0) + n
        for word, n in weights.items():
            line = "^" + word + "$"
            for i in range(1, len(line)):
                for k in range(CONTEXT + 1):
                    if i - k < 0:
                        break
                    c = self.counts.setdefault(line[i - k : i], {})
                    c[line[i]] = c.get(line[i], 0.0) + n
        self.letters = sorted({c for c in self.counts.get("", {}) if c != "$"})
        self.totals = {h: sum(c.values()) for h, c in self.counts.items()}
        self.known: dict[tuple[str, str], float] = {}

    def probability(self, h: str, c: str) -> float:
        lower = self.probability(h[1:], c) if h else 1.0 / (len(self.letters) + 2)
        found = self.counts.get(h)
        if not found:
            return lower
        n, kinds = self.totals[h], len(found)
        return (found.get(c, 0.0) + kinds * lower) / (n + kinds)

    def cost(self, h: str, c: str) -> float:
        key = (h, c)
        v = self.known.get(key)
        if v is None:
            v = self.known[key] = -math.log(self.probability(h, c))
        return v


def _options(c: str) -> list[tuple[str, float]]:
    """Letters that a character other than a mask can stand for, with their channel costs."""
    return ([(c, 0.0)] if c.isalpha() else []) + [(x, SWAP) for x in LEET.get(c, "")]


def restore(token: str, lm: LanguageModel, bound: float = math.inf) -> str:
    """Likeliest intended word of a lower-case token, by Viterbi search over its lattice; empty for a number.

    A state is the last CONTEXT letters written; of equal states the cheapest stays. Costs only grow, so states beyond
    ``bound``, the cost of some word that the token can mean, can't lead to the likeliest one.
    """
    bound += 1e-9
    # Letters written are a chain (before, letter).
    states: dict[str, tuple[float, tuple | None]] = {"^": (0.0, None)}
    for i, c in enumerate(token):
        after: dict[str, tuple[float, tuple | None]] = {}

        def put(h: str, cost: float, before: tuple | None, x: str = "", after=after) -> None:
            if cost <= bound and (h not in after or cost < after[h][0]):
                after[h] = (cost, (before, x) if x else before)

        options = _options(c)
        if c in MASKS:
            options += [(x, MASK) for x in lm.letters]
        letters = {x for x, _ in options}
        drop = c in SEPARATORS or not options or c in PUNCTUATION and i in (0, len(token) - 1)
        for h, (cost, written) in states.items():
            for x, channel in options:
                put((h + x)[-CONTEXT:], cost + channel + lm.cost(h, x), written, x)
            if drop:
                put(h, cost + GAP, written)
            elif written and h[-1] in letters:
                put(h, cost + REPEAT, written)
        states = after
    cost, chain = min(((cost + lm.cost(h, "$"), written) for h, (cost, written) in states.items()), default=(0.0, None), key=lambda s: s[0])
    if not any(c.isalpha() for c in token) and NUMBER + sum(DIGIT if c.isdigit() else SIGN for c in token) < cost:
        return ""
    out = []
    while chain:
        chain, x = chain
        out.append(x)
    return "".join(reversed(out))


@dataclass
class Model:
    lexicon: dict[str, int]
    weights: list[float]
    bias: float
    lm: LanguageModel | None

    def __post_init__(self):
        self.memory: dict[str, tuple[int, ...]] = {}
        self.restored: dict[str, str] = {}
        # The lexicon's trie: children, last letter, cost of that letter, cost of ending as a word (None: not one).
        self.children: list[dict[str, int]] = [{}]
        self.letter, self.step, self.end = [""], [0.0], [None]
        for w in self.lexicon if self.lm else ():
            at, h = 0, "^"
            for x in w:
                if x not in self.children[at]:
                    self.children[at][x] = len(self.children)
                    self.children.append({})
                    self.letter.append(x)
                    self.step.append(self.lm.cost(h, x))
                    self.end.append(None)
                at, h = self.children[at][x], (h + x)[-CONTEXT:]
            self.end[at] = self.lm.cost(h, "$")
        # Letters that a node is away from the end of a word at least; children come after their parents.
        self.least = [0 if cost is not None else math.inf for cost in self.end]
        for at in range(len(self.end) - 1, -1, -1):
            self.least[at] = min([self.least[at], *(self.least[x] + 1 for x in self.children[at].values())])

    def feature(self, token: str) -> tuple[int, ...]:
        """Lexicon numbers of a lower-case token and its parts, as written or as restored."""
        found = self.memory.get(token)
        if found is None:
            found = self._look_up(token)
            if len(token) <= REMEMBERED:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[token] = found
        return found

    def _look_up(self, token: str) -> tuple[int, ...]:
        core = token.strip(_EDGES)
        if core in self.lexicon:
            return (self.lexicon[core],)
        if self.lm is None or len(token) < 3:
            return ()
        if _PLAIN.match(core) and not _DOUBLE.search(core) and not any(c in LEET or c in MASKS for c in token[: token.index(core)] + token[token.index(core) + len(core) :]):
            return ()
        return tuple(sorted(self._spots(token, False)))

    def _spots(self, token: str, anywhere: bool) -> set[int]:
        """Lexicon numbers of windows of the token, which start and end beside a sign or at its ends, or anywhere."""
        n, out = len(token), set()
        edge = [anywhere or i in (0, n) or not (token[i - 1].isalnum() and token[i].isalnum()) for i in range(n + 1)]
        # By trie node: cost of the letters so far, start of the window, whether it was tried as a word since its last letter.
        states: dict[int, tuple[float, int, bool]] = {}
        least = self.least
        for i, c in enumerate(token):
            if not states and not edge[i]:
                continue
            left = n - 1 - i  # a character is one letter at most, so nodes further from an end than that lead to no word
            options = _options(c)
            mask = c in MASKS
            letters = {x for x, _ in options}
            drop = c in SEPARATORS or not options and not mask
            after: dict[int, tuple[float, int, bool]] = {}

            def put(node: int, cost: float, start: int, tried: bool, after=after) -> None:
                if node not in after or (cost, -start) < (after[node][0], -after[node][1]):
                    after[node] = (cost, start, tried)

            for node, (cost, start, tried) in [*states.items(), *([(0, (0.0, i, False))] if edge[i] else [])]:
                for x, channel in options:
                    if (child := self.children[node].get(x)) is not None and least[child] <= left:
                        put(child, cost + channel + self.step[child], start, False)
                if mask:
                    for child in self.children[node].values():
                        if least[child] <= left:
                            put(child, cost + MASK + self.step[child], start, False)
                if node and least[node] <= left and (drop or mask or self.letter[node] in letters):
                    put(node, cost + (GAP if drop else REPEAT), start, tried)
            if edge[i + 1]:
                for node, (cost, start, tried) in after.items():
                    if self.end[node] is not None and not tried:
                        after[node] = (cost, start, True)
                        window = token[start : i + 1]
                        f = self.lexicon.get(window if window in self.lexicon else self._restore(window, cost + self.end[node]), -1)
                        if f >= 0:
                            out.add(f)
            states = after
        return out

    def _restore(self, window: str, bound: float) -> str:
        """``restore``, remembered: every bound that a reading gives leads to the same word, and rows of signs come again and again."""
        word = self.restored.get(window)
        if word is None:
            word = restore(window, self.lm, bound)
            if len(window) <= REMEMBERED:
                if len(self.restored) >= MEMORY:
                    self.restored.clear()
                self.restored[window] = word
        return word

    def features(self, text: str) -> set[int]:
        words = text.lower().split()
        memory = self.memory.get
        found = set()
        for w in set(words):
            f = memory(w)
            if f is None:
                f = self.feature(w)
            if f:
                found.update(f)
        if self.lm is not None:
            # Runs of at least three single characters: a word set apart by spaces, or several of them.
            marks = bytes(len(w) == 1 for w in words)
            at = marks.find(b"\x01\x01\x01")
            while at >= 0:
                end = at
                while end < len(words) and marks[end]:
                    end += 1
                found |= self._spots("".join(words[at:end]), True)
                at = marks.find(b"\x01\x01\x01", end)
        return found

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        hits = self.features(text)
        z = self.bias + sum(self.weights[f] for f in hits) + (self.weights[-1] if hits else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [sorted({c for w in set((t.as_py() or "").lower().split()) if (c := w.strip(_EDGES)) and _PLAIN.match(c)}) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.string()))], names=["toxic", "h", "words"])


def letter_runs(words: DataFrame) -> DataFrame:
    """(before, letter, n) of words (w, n): each letter after the CONTEXT letters before it (all, if fewer), as the language model marks a word's ends."""
    line = words.select("n", F.concat(F.lit("^"), "w", F.lit("$")).alias("l"))
    at = line.select("n", "l", F.explode(F.sequence(F.lit(1), F.length("l") - 1)).alias("i")).withColumn("k", F.least("i", F.lit(CONTEXT)))
    runs = at.select("n", F.substring("l", F.col("i") - F.col("k") + 1, F.col("k")).alias("before"), F.substring("l", F.col("i") + 1, F.lit(1)).alias("letter"))
    return runs.groupBy("before", "letter").agg(F.sum("n").cast("double").alias("n"))


def _fit(rows: DataFrame, n: int) -> tuple[list[float], float]:
    """Logistic weights of n lexicon words and of having any, and the bias. rows: (toxic, hits); equal ones are one weighted row."""
    counts = Workspace(rows.sparkSession, "toxicity").save(rows.groupBy("toxic", "hits").agg(F.count("*").cast("double").alias("weight")), "hits")  # the fit reads them again and again
    vector = F.udf(lambda hits: Vectors.sparse(n + 1, [*hits, n] if hits else [], [1.0] * (len(hits) + bool(hits))), VectorUDT())
    fitted = LogisticRegression(labelCol="label", weightCol="weight", regParam=1e-5, standardization=False).fit(counts.select(F.col("toxic").cast("double").alias("label"), "weight", vector("hits").alias("features")))
    return [float(w) for w in fitted.coefficients], float(fitted.intercept)


def _odd(words: DataFrame, docs_t: int, docs_n: int, kinds: int) -> DataFrame:
    """Words (w, t, n) of some length that mostly toxic texts hold, far more often than chance, oddest first.

    They are in a hundredth of the toxic texts, or else in so many more than expected (Chernoff's bound) that of all ``kinds`` words
    less than one would be by chance: among many words some rare ones always are in toxic texts only.
    """
    p, r = docs_t / docs_n, F.col("t") / F.col("n")
    expected = F.col("n") * F.lit(p)
    z = (F.col("t") - expected) / F.sqrt(expected)
    clean = F.when(F.col("t") < F.col("n"), (1 - r) * F.log((1 - r) / F.lit(1 - p))).otherwise(0.0)
    sure = F.col("n") * (r * F.log(r / F.lit(p)) + clean) >= math.log(max(kinds, 1))
    likely = (F.col("t") >= 4) & (F.col("t") * 2 > F.col("n")) & (F.length("w") > 2)
    return words.filter(likely).withColumn("z", z).filter((F.col("z") >= 4.5) & ((F.col("t") >= docs_t // 100) | sure)).orderBy(F.col("z").desc(), "w")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("l_id")).agg(F.max("toxic").alias("toxic"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).join(broadcast_if_small(known), F.col("id") == F.col("l_id")).select("toxic", "text")
    words = sample.select("toxic", F.sha2("text", 256).alias("h"), "text").mapInArrow(_plain_words, "toxic int, h string, words array<string>")
    lists = words.groupBy("h").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words"))
    counts = Workspace(docs.sparkSession, "toxicity").save(lists.select("toxic", F.explode(F.concat(F.array(F.lit("")), "words")).alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")), "counts")
    # The empty word counts documents. Runs of letters and words that may be toxic are few; the rest stays on the executors.
    total = counts.filter("w = ''").first()
    if total is None or total["t"] in (0, total["n"]):
        return Model({}, [], 0.0, None)
    docs_t, docs_n = total["t"], total["n"]
    words = counts.filter("w <> ''")
    size = words.agg(F.count("*").alias("kinds"), F.sum("n").alias("mass")).first()
    odd = _odd(words, docs_t, docs_n, size["kinds"]).collect()  # as many as the labelled texts show
    lexicon = {r["w"]: i for i, r in enumerate(odd)}
    lm = LanguageModel({r["w"]: size["mass"] / len(odd) for r in odd}, ((r["before"], r["letter"], r["n"]) for r in letter_runs(words).collect()))  # half of the model's weight to the lexicon, evenly
    model = Model(lexicon, [], 0.0, lm)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [sorted(shared.value.features(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    w, b = _fit(sample.mapInArrow(run, "toxic int, hits array<int>"), len(lexicon))
    return Model(lexicon, w, b, model.lm)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.select(F.col(f"`{id_col}`")).schema[0], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.fromiter((m.score(t.as_py() or "") for t in b.column(2)), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("__ll_text")).mapInArrow(run, schema)
