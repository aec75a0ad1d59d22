"""SentencePiece encoding and decoding with exact N-best segmentation.

Method. White space becomes the piece alphabet's word mark, one mark is put in front, and the text is cut into chunks no
piece can cross. Every chunk has a lattice of vocabulary pieces; a character outside the vocabulary is one edge that
stands for its UTF-8 byte pieces. A forward Viterbi pass gives the best score of every prefix. These scores are exact
completion costs for an A* search backwards from the end of the chunk, which so yields segmentations best first. Because
the heuristic is exact, the second-best score is read off the first backward walk (the best edge left aside), and the
search goes on only for chunks that can matter to the document: of a whole text's N best segmentations, only the N-1
chunks that lose least by a change take part, and a second best-first search combines their alternatives.

Scores are the model's own piece scores, added; the best segmentation is that of the largest sum. (A BPE model's encoder
applies its merges greedily instead; both decode to the same text.)

Scale. Narrow: one pass over the rows, Arrow batches, no shuffle. The vocabulary (its size is fixed by the model) is read
on the driver and broadcast, so executors need no model file. Each worker remembers segmented chunks, twice ``MEMORY``
entries at most; long chunks are never remembered. Work is linear in the text, also for texts without any space.

Defined results. A null text counts as empty; an empty text has no pieces and one segmentation, of score 0. Fewer than N
segmentations exist for very short texts: then all are returned. Equal scores come in a fixed order. Repeated rows are
encoded one by one and alike; an empty table gives no rows. Extra columns are ignored or carried whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N = 4
MARK = "▁"
#: Remembered chunks of a worker, and the longest remembered chunk.
MEMORY, LONGEST = 400_000, 48
#: Less than the worst piece score by this much: a character that the vocabulary lacks.
UNKNOWN = 10.0
ROWS = 2_000


@dataclass
class Vocabulary:
    """Scores and ids of pieces that stand for text, ids of byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: dict[int, str] = field(default_factory=dict)

    def __post_init__(self):
        self.unknown = min((s for s in self.scores.values() if s > -1e8), default=0.0) - UNKNOWN
        self.texts = {i: p for p, i in self.ids.items()}
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        self.longest = max(map(len, self.scores), default=1)

    @cached_property
    def trie(self) -> dict:
        """By first character: (score or None, the same by the next character)."""
        root: dict = {}
        for piece in sorted(self.scores):
            node = root
            for c in piece[:-1]:
                node = node.setdefault(c, (None, {}))[1]
            node[piece[-1]] = (self.scores[piece], node[piece[-1]][1] if piece[-1] in node else {})
        return root

    @cached_property
    def chunk(self) -> re.Pattern:
        """Chunks: a new line, or marks and what follows up to the next mark; cut between a letter and a sign that follows a
        letter in no piece."""
        after_letter = {p[k] for p in self.scores for k in range(1, len(p)) if p[k - 1].isalpha()}
        signs = "".join(re.escape(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~" if c not in after_letter)
        # The run before a sign ends there or nowhere, so nothing of it is given back.
        cut = rf"{MARK}*+[^{MARK}\n{signs}]++(?=[{signs}])(?<=[^\W\d_])|" if signs else ""
        return re.compile(rf"\n|{cut}{MARK}*[^{MARK}\n]+|{MARK}+")

    @classmethod
    def read(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        text = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        names = {i: m.id_to_piece(i) for i in text}
        return cls({p: i for i, p in names.items()}, {p: m.get_score(i) for i, p in names.items()}, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def spell(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))


class Lattice:
    """All segmentations of one chunk, best first."""

    def __init__(self, chunk: str, v: Vocabulary):
        self.chunk, self.v = chunk, v
        root, unknown, longest = v.trie, v.unknown, v.longest
        n = len(chunk)
        alpha, back = [0.0] + [-float("inf")] * n, [0] * (n + 1)
        #: By end: (start, score) of its edges, by start.
        self.edges: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        edges = self.edges
        for i in range(n):
            here, next_ = alpha[i], root
            for j, c in enumerate(chunk[i : i + longest], i + 1):
                node = next_.get(c)
                if node is None:  # no piece begins like this
                    break
                s, next_ = node
                if s is not None:
                    edges[j].append((i, s))
                    if (s := here + s) > alpha[j]:
                        alpha[j], back[j] = s, i
            if chunk[i] not in v.scores:  # no piece by itself: its bytes
                edges[i + 1].append((i, unknown))
                if here + unknown > alpha[i + 1]:
                    alpha[i + 1], back[i + 1] = here + unknown, i
        self.alpha = alpha
        ends = [n]
        while ends[-1]:
            ends.append(back[ends[-1]])
        self.cuts = ends[::-1]
        self.best = alpha[n]
        self.ids = tuple(i for a, b in zip(self.cuts, self.cuts[1:]) for i in v.spell(chunk[a:b]))  # noqa: B905
        self.second = self._second(ends)

    def _second(self, ends: list[int]) -> float:
        """Score of the second-best segmentation: the best edge beside the best path, completed by it on both sides."""
        most, behind, alpha = -float("inf"), 0.0, self.alpha
        for j, used in zip(ends, ends[1:]):  # noqa: B905
            here = 0.0
            for i, s in self.edges[j]:
                if i == used:
                    here = s
                elif (f := alpha[i] + s + behind) > most:
                    most = f
            behind += here
        return most

    def search(self, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best: backward A*, an entry is (-(best prefix + score behind), position, order, score behind, cuts behind).

        Among equal scores the entry nearest to the start goes first, so a chunk with ever so many equal segmentations is
        walked straight down.
        """
        out, order, end = [], 0, len(self.chunk)
        heap = [(-self.best, end, 0, 0.0, (end, None))]
        while heap and len(out) < n:
            f, j, _, behind, cuts = heapq.heappop(heap)
            if j == 0:
                ids, (a, rest) = [], cuts
                while rest is not None:
                    b, after = rest
                    ids += self.v.spell(self.chunk[a:b])
                    a, rest = b, after
                out.append((-f, tuple(ids)))
                continue
            for i, s in self.edges[j]:
                order += 1
                heapq.heappush(heap, (-(self.alpha[i] + s + behind), i, order, s + behind, (i, cuts)))
        return out


class Encoder:
    def __init__(self, v: Vocabulary, n: int = N):
        self.v, self.n = v, n
        #: Remembered chunks: the newer ones, and those that were newer before.
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        #: Of chunks that were searched, (loss, ids) of their N best.
        self.searched: dict[str, list] = {}

    def chunks(self, text: str) -> list[str]:
        return self.v.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def first(self, chunk: str) -> tuple:
        """(ids, best score, what the second best loses)."""
        found = self.known.get(chunk)
        if found is None:
            found = self.older.get(chunk)
            if found is None:
                x = Lattice(chunk, self.v)
                found = (x.ids, x.best, x.best - x.second)
            if len(chunk) <= LONGEST:
                if len(self.known) >= MEMORY:
                    self.older, self.known = self.known, {}
                self.known[chunk] = found
        return found

    def options(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the N best segmentations of a chunk."""
        found = self.searched.get(chunk)
        if found is None:
            x = Lattice(chunk, self.v)
            found = [(x.best - s, ids) for s, ids in x.search(self.n)]
            if len(chunk) <= LONGEST:
                if len(self.searched) >= MEMORY // 10:
                    self.searched.clear()
                self.searched[chunk] = found
        return found

    def encode(self, text: str) -> tuple[list[int], list[float], list[list[tuple[int, tuple[int, ...]]]]]:
        """(best ids, scores best first, per segmentation its changes against the best: chunk number and ids)."""
        chunks = self.chunks(text)
        known = self.known.get
        firsts = [known(c) or self.first(c) for c in chunks]
        ids = [i for f in firsts for i in f[0]]
        total = sum(f[1] for f in firsts)
        if self.n <= 1 or not chunks:
            return ids, [total], [[]]
        loses = [f[2] for f in firsts]
        # Any of the N best changes only chunks among the N-1 whose second best loses least.
        some = [k for k in heapq.nsmallest(self.n - 1, range(len(loses)), key=loses.__getitem__) if loses[k] < float("inf")]
        options = [self.options(chunks[k]) for k in some]
        heap, seen, scores, changes = [(0.0, (0,) * len(some))], {(0,) * len(some)}, [], []
        while heap and len(scores) < self.n:
            lost, pick = heapq.heappop(heap)
            scores.append(total - lost)
            changes.append(sorted((some[i], options[i][p][1]) for i, p in enumerate(pick) if p))
            for i, p in enumerate(pick):
                after = (*pick[:i], p + 1, *pick[i + 1 :])
                if p + 1 < len(options[i]) and after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (sum(options[j][q][0] for j, q in enumerate(after)), after))
        return ids, scores, changes


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(model: str, n: int, v: Vocabulary) -> Encoder:
    """The worker's encoder, kept from task to task with what it remembers."""
    if (model, n) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model, n] = Encoder(v, n)
    return _ENCODERS[model, n]


def decode(ids: list[int], v: Vocabulary) -> str:
    """Text of a sequence of piece ids."""
    if any(i in v.bytes for i in ids):
        parts, run = [], bytearray()
        for i in ids:
            if i in v.bytes:
                run.append(v.bytes[i])
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(v.texts.get(i, ""))
        parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
    else:
        text = "".join([v.texts.get(i, "") for i in ids])
    return text.replace(MARK, " ")[1:] if text[:1] == MARK else text.replace(MARK, " ")


CHANGE = pa.list_(pa.struct([("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))]))
_IDS = T.ArrayType(T.IntegerType())
RESULT = [
    T.StructField("n_pieces", T.LongType()),
    T.StructField("ids", _IDS),
    T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("changes", T.ArrayType(T.ArrayType(T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("ids", _IDS)])))),
    T.StructField("round_trip", T.BooleanType()),
]


def encode(docs: DataFrame, text_col: str, carry: list[str], n: int = N, model: str = MODEL) -> DataFrame:
    """The columns named in carry plus n_pieces, ids (best segmentation), scores (N best), changes (of each of the N best
    against the best: chunk numbers and their pieces) and round_trip (the ids decode to the text).

    The word mark itself stands for a space in this alphabet, so a text that holds U+2581 reads back with spaces.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.read(model))
    schema = T.StructType([*docs.select(*carry).schema, *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = _encoder(model, n, v)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                sizes, flat, scores, changes, same = [0], [], [], [], []
                for t in b.column(0):
                    text = t.as_py() or ""
                    ids, s, c = encoder.encode(text)
                    flat += ids
                    sizes.append(len(flat))
                    scores.append(s)
                    changes.append([[{"chunk": k, "ids": x} for k, x in one] for one in c])
                    same.append(decode(ids, v) == text)
                offsets = pa.array(sizes, pa.int32())
                counts = pa.array([y - x for x, y in zip(sizes, sizes[1:])], pa.int64())  # noqa: B905
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[1:], counts, lists, pa.array(scores, pa.list_(pa.float64())), pa.array(changes, pa.list_(CHANGE)), pa.array(same)], names=schema.names)

    from pyspark.sql import functions as F

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("__ll_text"), *carry).mapInArrow(run, schema)


def decoded(encoded: DataFrame, ids_col: str, carry: list[str], model: str = MODEL) -> DataFrame:
    """The columns named in carry plus text, read from a column of piece ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    schema = T.StructType([*encoded.select(*carry).schema, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode(x.as_py() or [], shared.value) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(ids_col, *carry).mapInArrow(run, schema)
