"""Token-ID files: whole documents as token ids, entropy-coded by a static range asymmetric numeral system.

Method. Texts are encoded with a public byte-level vocabulary, an end id is appended to each, and the ids of all documents are
counted. The counts, scaled to 2^20, are the frequency table that every block shares. A block holds whole documents in order;
its ids are dealt round robin to interleaved lanes, each a state of 64 bits that gives off 32-bit words, so that one step
codes an id of every lane at once. Blocks are independent. Inside a block, checkpoints keep the lanes' states and the place in the
words at every so many ids, so that a long block can be decoded from any checkpoint on; the words of each checkpoint and
the ids they stand for carry a checksum each.

File: magic; blocks; directory (a row a block: offset, bytes, first id, ids, documents, checkpoints); offset of the directory,
its checksum, magic. Block: counts; document ids and lengths, deflated; checkpoints (place, checksums, states); words. All
numbers are little-endian.

Reading. Directories give the units of work: a block and a run of its checkpoints. A unit owns the documents that start in its
ids and decodes on past its end until the last of them is whole.

Scale. Texts are encoded where they are read; only compressed ids are shuffled, once, into ranges of (document id, place in the
input), which also split the rows of one id. Tasks write files under names no other attempt uses and report them, so that lost
executors leave no half files in the archive. What passes the driver: the frequency table, bounded by the vocabulary. A
file's first id is a running sum over the manifest, a row per file.

Segments of a text are encoded once per worker and remembered (twice ``MEMORY`` at most). Segments are cut only where the
vocabulary's own rule always cuts, such as before a single space, so their ids are those of the whole text. Vocabularies of
another kind are applied to whole texts.

Defined results. Null text is the empty text: the end id alone. Rows without an id come last; rows that repeat an id come in
the order of their places in the input, each a document of its own. An empty table gives no files and no rows. Extra columns are
ignored whatever their names. A string of the text that equals a special token becomes that token, as the library has it.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Workspace, filesystem, shuffle_partitions, with_locator

END = 0
#: Frequencies add up to 2^SCALE; states stay in [2^31, 2^63).
SCALE, LOW = 20, 1 << 31
LANES = 1024
#: Ids of a block, once reached it is closed; ids between checkpoints; checkpoints of a unit of reading.
BLOCK, EVERY, SPAN = 1 << 18, 1 << 17, 2
#: Remembered segments of a worker, and the longest remembered one.
MEMORY, LONGEST = 300_000, 48
#: Bytes of text that are cut at a time.
SLICE = 6 << 20
MAGIC = b"LLTOKEN1"
_BLOCK, _POINT, _ENTRY, _END = struct.Struct("<IQIII"), struct.Struct("<QII"), np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("first", "<u8"), ("ids", "<u8"), ("docs", "<u4"), ("points", "<u4")]), struct.Struct("<QI8s")


# Encoding ------------------------------------------------------------------------------------------------------------

#: Characters on which this module cuts words itself; a segment with any other goes to the library whole.
_PLAIN = re.compile(r"[\n\t\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: The word pattern of the vocabulary file, in terms of these characters; NUL ends a segment.
_WORD = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s\x00]|_)+|\s+(?![^\s\x00])|\s+")
#: Segments that are one word for sure.
_SINGLE = r"^(?: ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|[.,\n])$"
_CUT = re.compile(r" (?=\S)")
#: A text without any of this is ordinary: two spaces of any kind in a row, a dot or comma behind other than a plain letter or
#: digit, NUL. The vocabulary's rule always cuts it at the places below, so that its words can be told apart by plain search.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\pZ][\s\x0b\x1c-\x1f\x{85}\pZ]|[^0-9A-Za-zÀ-ÖØ-öø-ÿĀ-žА-я][.,]|\x00"
_CUTS = {" ": "\x00 ", "\n": "\x00\n\x00", ".": "\x00.", ",": "\x00,"}


def _byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on, in order. NUL, which no
    word handled here has, becomes the line feed between words."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)} | {0: "\n"}


class Encoder:
    """Ids of texts, with a memory of segments."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        #: The same model on words that are cut and spelled in its alphabet already.
        self.speller, self.alphabet = Tokenizer(self.tokenizer.model), _byte_alphabet()
        self.speller.add_special_tokens(["\n"])
        self.between = self.speller.token_to_id("\n")
        kind = json.loads(vocabulary)
        split, added = kind.get("pre_tokenizer") or {}, kind.get("added_tokens") or []
        model = kind["model"]
        known = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not kind.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        odd = [a for a in added if re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"]]
        #: Whether texts may be cut into segments.
        self.by_segment = bool(known and not odd)
        self.special = [a["content"] for a in added]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _find(self, keys: list[str]) -> list[bytes | None]:
        found = list(map(self.recent.get, keys))
        if self.older:
            again = {k: ids for k, ids in ((k, self.older.get(k)) for k, ids in zip(keys, found, strict=True) if ids is None) if ids is not None}
            if again:
                self.recent |= again
                found = [again.get(k) if ids is None else ids for k, ids in zip(keys, found, strict=True)]
        return found

    def _keep(self, keys: list[str], ids: list[bytes]) -> None:
        self.recent.update(x for x in zip(keys, ids, strict=True) if len(x[0]) <= LONGEST)
        if len(self.recent) >= MEMORY:
            self.older, self.recent = self.recent, {}

    def _spell(self, words: list[str]) -> list[bytes]:
        """Ids of words that this module cut."""
        if not words:
            return []
        spelled = "\x00".join([*words, ""]).encode().decode("latin-1").translate(self.alphabet)
        found = np.array(self.speller.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int32)
        stops = found == self.between
        ends = np.flatnonzero(stops)
        ids = found[~stops].astype(self.dtype).tobytes()
        ends = ((ends - np.arange(len(ends))) * self.dtype.itemsize).tolist()
        made = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self._keep(words, made)
        return made

    def segments(self, wanted: list[str], words: list[bool] | None = None) -> list[bytes]:
        """Ids of segments; those that aren't remembered are cut into words and spelled together. ``words``: which are single words."""
        out = self._find(wanted)
        new = [k for k, ids in enumerate(out) if ids is None]
        if words is not None:
            single = [k for k in new if words[k]]
            for k, ids in zip(single, self._spell([wanted[k] for k in single]), strict=True):
                out[k] = ids
            new = [k for k in new if not words[k]]
        if not new:
            return out
        fresh = list({wanted[k]: None for k in new})
        plain = [s for s in fresh if _PLAIN.fullmatch(s) and not any(x in s for x in self.special)]
        made = {s: self._pack(self.tokenizer.encode(s, add_special_tokens=False).ids) for s in set(fresh).difference(plain)}
        if plain:
            cut = _WORD.findall("\x00".join([*plain, ""]))
            different = list(set(cut) - {"\x00"})
            known = dict(zip(different, self._find(different), strict=True))
            missing = [w for w, ids in known.items() if ids is None]
            known |= dict(zip(missing, self._spell(missing), strict=True))
            known["\x00"] = None
            parts, at = [], 0
            for ids in map(known.__getitem__, cut):
                if ids is None:
                    made[plain[at]] = b"".join(parts) if len(parts) != 1 else parts[0]
                    parts, at = [], at + 1
                else:
                    parts.append(ids)
        self._keep(list(made), list(made.values()))
        for k in new:
            out[k] = made[wanted[k]]
        return out

    def text(self, text: str) -> bytes:
        """Ids of one text, whatever its white space."""
        if not self.by_segment:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = _CUT.split(text)
        return b"".join(self.segments([first, *[" " + s for s in rest]]))

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of many texts. Ordinary ones are cut and put together as arrays."""
        if not self.by_segment or not len(texts):
            return [self.text(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        others = iter([self.text(t) for t in texts.filter(pa.array(odd)).to_pylist()])
        if odd.all():
            return list(others)
        ordinary = texts.filter(pa.array(~odd)) if odd.any() else texts
        for sign, cut in _CUTS.items():
            ordinary = pc.replace_substring(ordinary, sign, cut)
        parts = pc.split_pattern(ordinary, "\x00")
        at = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        single = pc.match_substring_regex(coded.dictionary, _SINGLE).to_numpy(zero_copy_only=False).tolist()
        made = pa.array(self.segments(coded.dictionary.to_pylist(), single), pa.binary())
        whole = made.take(coded.indices)  # in the texts' order, one after the other
        ends, ids = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, whole.offset * 4), whole.buffers()[2] or pa.py_buffer(b"")
        cuts = ends[at - at[0]].tolist()
        found = (ids[a:b].to_pybytes() for a, b in zip(cuts, cuts[1:]))  # noqa: B905
        return [next(others if x else found) for x in odd.tolist()]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, kept from task to task with what it remembers."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE)) + 1
        yield texts[start:stop]
        start = stop


def tokens(docs: DataFrame, vocabulary: str, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (id, file, row, ids): compressed ids of each row's text with the end id."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__ll_text")
    located = with_locator(docs.select(F.col(f"`{id_col}`").cast("long").alias("__ll_id"), text), space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = _encoder(shared.value), zstandard.ZstdCompressor(3)
        end = encoder._pack([END])
        for b in batches:
            done = 0
            for texts in _slices(b.column(0)):
                ids = pa.array([pack.compress(x + end) for x in encoder.texts(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(done, len(texts)) for c in b.columns[1:]], ids], ["id", "file", "row", "ids"])
                done += len(texts)

    return space.save(located.select("__ll_text", "__ll_id", "__ll_file", "__ll_row").mapInArrow(run, "id long, file long, row long, ids binary"), "tokens")


def counts(rows: DataFrame, size: int, dtype: str) -> DataFrame:
    """(token, n) over all ids of a token table; each task gives one row per id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor(), np.zeros(size, np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                ids = b"".join([unpack.decompress(x.as_py()) for x in b.column(0)[start : start + 500]])
                total += np.bincount(np.frombuffer(ids, dtype), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["token", "n"])

    return rows.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequencies(n: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to 2^scale: at least 1 for each id that occurs."""
    total = int(n.sum())
    out = np.zeros(len(n), np.int64)
    if not total:
        return out
    if np.count_nonzero(n) > 1 << scale:
        raise ValueError("more ids than the table has places")
    used = n > 0
    out[used] = np.maximum(1, np.floor(n[used] * ((1 << scale) / total))).astype(np.int64)
    over = int(out.sum()) - (1 << scale)
    for k in np.argsort(-n, kind="stable"):  # the most frequent ids take what rounding left
        if over == 0:
            break
        take = min(over, int(out[k]) - 1) if over > 0 else over
        out[k] -= take
        over -= take
    return out


# Coding --------------------------------------------------------------------------------------------------------------


class Coder:
    """The shared table, and blocks of ids coded by it."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq, self.scale = freq.astype(np.uint64), np.uint64(scale)
        self.cum = np.cumsum(self.freq) - self.freq
        self.most = self.freq << np.uint64(63 - scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """(words, checkpoints as (place in the words, states)) of ids; a checkpoint at each multiple of ``every`` ids."""
        steps, per = -(-len(ids) // lanes), every // lanes
        x, given, points = np.full(lanes, LOW, np.uint64), [], {}
        f, c, most = self.freq[ids], self.cum[ids], self.most[ids]
        for t in range(steps - 1, -1, -1):
            here = slice(t * lanes, min((t + 1) * lanes, len(ids)))
            s, ft = x[: here.stop - here.start], f[here]
            full = s >= most[here]
            given.append((s[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            s = np.where(full, s >> np.uint64(32), s)
            q = s // ft
            x[: len(s)] = (q << self.scale) + (s - q * ft) + c[here]
            if t % per == 0:
                points[t] = x.copy()
        given.reverse()
        at = np.concatenate([[0], np.cumsum([len(g) for g in given], dtype=np.int64)])
        words = np.concatenate(given) if given else np.zeros(0, "<u4")
        return words, [(int(at[t]), points[t]) for t in sorted(points)]

    def decode(self, words: np.ndarray, states: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(n ids, states after them, words read), from the words at a checkpoint on and its states."""
        x, lanes, at = states.astype(np.uint64), len(states), 0
        out = np.empty(n, np.int32)
        for start in range(0, n, lanes):
            s = x[: min(lanes, n - start)]
            low = s & self.mask
            ids = self.slot[low]
            out[start : start + len(s)] = ids
            s = self.freq[ids] * (s >> self.scale) + low - self.cum[ids]
            less = np.flatnonzero(s < LOW)
            s[less] = (s[less] << np.uint64(32)) | words[at : at + len(less)]
            at += len(less)
            x[: len(s)] = s
        return out, x, at


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_block(docs: list[tuple[int | None, np.ndarray]], coder: Coder, lanes: int = LANES, every: int = EVERY) -> tuple[bytes, int, int]:
    """(block, ids in it, checkpoints) of whole documents."""
    ids = np.concatenate([d for _, d in docs])
    lanes = max(1, min(lanes, every, len(ids)))
    every = every // lanes * lanes
    words, points = coder.encode(ids, lanes, every)
    table = np.array([[i is None, i or 0, len(d)] for i, d in docs], "<i8").T
    table[1] = np.diff(table[1], prepend=0)  # ids ascend
    head = zlib.compress(table.tobytes(), 6)
    ends = [p for p, _ in points[1:]] + [len(words)]
    out = [_BLOCK.pack(len(docs), len(ids), lanes, every, len(points)), struct.pack("<I", len(head)), head]
    for k, ((p, states), end) in enumerate(zip(points, ends, strict=True)):
        out += [_POINT.pack(p, zlib.crc32(words[p:end].tobytes()), _crc(ids[k * every : (k + 1) * every])), states.astype("<u8").tobytes()]
    return b"".join([*out, words.tobytes()]), len(ids), len(points)


def unpack_block(data: bytes, coder: Coder, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(document id, place in the block's ids, ids) of the documents that start at the checkpoints first to last - 1."""
    n_docs, n, lanes, every, n_points = _BLOCK.unpack_from(data)
    at = _BLOCK.size + 4
    size = struct.unpack_from("<I", data, _BLOCK.size)[0]
    null, ids, lengths = np.frombuffer(zlib.decompress(data[at : at + size]), "<i8").reshape(3, n_docs)
    ids, ends = np.cumsum(ids), np.cumsum(lengths)
    points, step = at + size, _POINT.size + 8 * lanes
    words = np.frombuffer(data, "<u4", offset=points + n_points * step)
    last = n_points if last is None else min(last, n_points)
    starts = ends - lengths
    # Every document has an end id at least, so starts ascend strictly.
    a, b = np.searchsorted(starts, [first * every, last * every if last < n_points else n])
    if a == b:
        return
    held, base, k = np.zeros(0, np.int32), first * every, first
    for d in range(a, b):
        parts = [held]
        have = base + len(held)
        while have < ends[d]:
            p, words_crc, ids_crc = _POINT.unpack_from(data, points + k * step)
            states = np.frombuffer(data, "<u8", lanes, points + k * step + _POINT.size)
            end = _POINT.unpack_from(data, points + (k + 1) * step)[0] if k + 1 < n_points else len(words)
            if zlib.crc32(words[p:end].tobytes()) != words_crc:
                raise ValueError("words of a block don't have the checksum of their checkpoint")
            got, states, _ = coder.decode(words[p:end], states, int(min(every, n - k * every)))
            if _crc(got) != ids_crc or (k + 1 == n_points and (states != LOW).any()):
                raise ValueError("ids of a block don't have the checksum of their checkpoint")
            parts.append(got)
            have += len(got)
            k += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if null[d] else int(ids[d])), int(starts[d]), held[starts[d] - base : ends[d] - base]
        held, base = held[ends[d] - base :], int(ends[d])


# Files ---------------------------------------------------------------------------------------------------------------


def directory(entries: list[tuple], at: int) -> bytes:
    """What closes a file whose blocks end at ``at``."""
    rows = np.array(entries, _ENTRY).tobytes()
    return rows + _END.pack(at, zlib.crc32(rows), MAGIC)


def write(docs: DataFrame, space: Workspace, vocabulary_file: str, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES, block: int = BLOCK, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Write docs as token files; returns the written manifest (file, start, ids, docs) and frequency table (token, frequency)."""
    spark = docs.sparkSession
    with open(vocabulary_file, encoding="utf-8") as f:
        vocabulary = f.read()
    known = Encoder(vocabulary)
    size, dtype = known.tokenizer.get_vocab_size(), known.dtype
    rows = tokens(docs, vocabulary, space, id_col, text_col)
    found = counts(rows, size, dtype.str).collect()  # a row per id of the vocabulary at most
    n = np.zeros(size, np.int64)
    for token, k in found:
        n[token] = k
    freq = frequencies(n)
    table = space.save(spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "token int, frequency int"), "frequencies")
    shared, folder = spark.sparkContext.broadcast(freq), space.path("archive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, unpack = Coder(shared.value), zstandard.ZstdDecompressor()
        out, held, waiting, entries, at, done = None, [], 0, [], len(MAGIC), 0

        def flush():
            nonlocal held, waiting, at, done
            data, ids, points = pack_block(held, coder, lanes, every)
            out.write(data)
            entries.append((at, len(data), done, ids, len(held), points))
            at, done, held, waiting = at + len(data), done + ids, [], 0

        for b in batches:
            for doc_id, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    system, base = filesystem(folder)
                    system.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.tok"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(MAGIC)
                ids = np.frombuffer(unpack.decompress(packed.as_py()), dtype)
                held.append((doc_id, ids))
                waiting += len(ids)
                if waiting >= block:
                    flush()
        if out is not None:
            if held:
                flush()
            out.write(directory(entries, at))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [f"{folder}/{name}"], "ids": [done], "docs": [sum(e[4] for e in entries)]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))

    order = [F.col("id").asc_nulls_last(), F.col("file"), F.col("row")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")
    files = space.save(ranges.mapInArrow(run, "part int, file string, ids long, docs long"), "files")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    return space.save(files.select("file", F.coalesce(before, F.lit(0)).cast("long").alias("start"), "ids", "docs"), "manifest"), table


def read_directory(uri: str) -> np.ndarray:
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        at, crc, magic = _END.unpack(f.read_at(_END.size, size - _END.size))
        data = f.read_at(size - _END.size - at, at)
        if magic != MAGIC or zlib.crc32(data) != crc or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
    return np.frombuffer(data, _ENTRY)


UNITS = "file string, offset long, bytes long, start long, first int, last int"


def units(manifest: DataFrame, span: int = SPAN) -> DataFrame:
    """Units of reading: a block and a run of ``span`` of its checkpoints; start is the block's place among the ids of all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(uri, int(e["offset"]), int(e["bytes"]), start + int(e["first"]), k, k + span) for e in read_directory(uri) for k in range(0, int(e["points"]), span)]
                yield pa.RecordBatch.from_pydict(dict(zip(["file", "offset", "bytes", "start", "first", "last"], map(list, zip(*rows)), strict=True)), pa.schema([("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("start", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))  # noqa: B905

    return manifest.select("file", "start").mapInArrow(run, UNITS)


def read(manifest: DataFrame, table: DataFrame, span: int = SPAN, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and with ``ids`` the ids themselves."""
    spark: SparkSession = manifest.sparkSession
    known = table.collect()  # a row per id of the vocabulary at most
    freq = np.zeros(max((r["token"] for r in known), default=0) + 1, np.int64)
    for r in known:
        freq[r["token"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(freq)
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            for u in b.to_pylist():
                system, path = filesystem(u["file"])
                with system.open_input_file(path) as f:
                    data = f.read_at(u["bytes"], u["offset"])
                rows = [(i, u["start"] + s, len(x), _crc(x), *([x] if ids else [])) for i, s, x in unpack_block(data, coder, u["first"], u["last"])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(zip(*rows), kinds, strict=True)], [name for name, _ in kinds])  # noqa: B905

    spread = units(manifest, span).repartition(shuffle_partitions(spark), "file", "offset", "first")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
