"""Token files: ids against the library's own on whole texts, coder round trips, checkpoints, checksums, odd tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import token_files
from ledgerloom.llm.common import Workspace, filesystem

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, encoding="utf-8") as f:
        return token_files.Encoder(f.read())


ODD = [
    "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n a", "tab\t x", "it's they'll I'VE 'tis don't", "x1 2y 33 4²½ Ⅷ五 ٣", "_under_ __ ªº µ", "naïve Straße çà ÷ ×", "日本語 テキスト 한국어", " nbsp   em    x",
    "\x1c\x1d a \x1e b\x1f", "\x85 a \x85b", "é ä 😀 👩‍👩‍👧 ", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b <|endof text|>", "\x00 \x00x", "'s 't ' s", "a' b'' c\"", "...  ...!? #$%", "word " * 500, "x" * 3000, "﻿ a ​ b", "a\r\n b \r\nc",
]


def texts(n, seed=5):
    r = random.Random(seed)
    parts = ["the", "Of", "naïve", "it's", "'ll", "123", "  ", "\n", " \n ", "\t", " ", "日本", "é", "_", "#", "<|endoftext|>", "x-y", "½", "\x1c", "Zürich,", "end.", "😀", "'"]
    return ["".join(r.choice(parts) + r.choice(["", " ", " ", " "]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_ids_are_the_library_s(library, encoder):
    some = ODD + texts(1500)
    want = [library.encode(t, add_special_tokens=False).ids for t in some]
    assert encoder.by_segment
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.texts(pa.array(some))] == want
    assert [np.frombuffer(encoder.text(t), encoder.dtype).tolist() for t in some] == want
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.texts(pa.array(some)[7:40])] == want[7:40]


def test_memory_does_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 3)
    with open(VOCABULARY, encoding="utf-8") as f:
        small = token_files.Encoder(f.read())
    some = texts(200, 6)
    assert [np.frombuffer(x, small.dtype).tolist() for x in small.texts(pa.array(some))] == [library.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize(("n", "lanes", "every", "alphabet"), [(1, 4, 8, 1), (5, 8, 8, 3), (1000, 7, 21, 500), (4096, 64, 256, 1), (10_000, 512, 1024, 40_000), (10_001, 16, 160, 2)])
def test_coder_round_trip_from_every_checkpoint(n, lanes, every, alphabet):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), alphabet) - 1
    coder = token_files.Coder(token_files.frequencies(np.bincount(ids)))
    words, points = coder.encode(ids, lanes, every)
    for k, (at, states) in enumerate(points):
        got, after, read = coder.decode(words[at:], states, n - k * every)
        assert (got == ids[k * every :]).all() and (after == token_files.LOW).all() and read == len(words) - at
    entropy = -np.sum(np.bincount(ids) * np.log2(np.maximum(np.bincount(ids), 1) / n)) / 8
    assert 4 * len(words) <= entropy * 1.02 + 8 * lanes + 16


def test_frequencies():
    for n in ([1], [0, 5, 0], [1] * 1000, [10**12, 1, 1], list(range(5000))):
        f = token_files.frequencies(np.array(n))
        assert f.sum() == 1 << token_files.SCALE and ((f > 0) == (np.array(n) > 0)).all()
    assert token_files.frequencies(np.zeros(4, np.int64)).sum() == 0


def test_block_from_any_run_of_checkpoints():
    r = np.random.default_rng(1)
    docs = [(None if k == 40 else 3 * k - 20, r.integers(0, 300, r.integers(1, 1500 if k % 9 else 20_000))) for k in range(41)]
    coder = token_files.Coder(token_files.frequencies(np.bincount(np.concatenate([d for _, d in docs]))))
    data, n, points = token_files.pack_block(docs, coder, 32, 1000)
    for span in (1, 3, points):
        got = [x for k in range(0, points, span) for x in token_files.unpack_block(data, coder, k, k + span)]
        assert [i for i, _, _ in got] == [i for i, _ in docs] and all((a == b).all() for (_, _, a), (_, b) in zip(got, docs, strict=True))
        assert [s for _, s, _ in got] == (np.cumsum([len(d) for _, d in docs]) - [len(d) for _, d in docs]).tolist()
    spoiled = bytearray(data)
    spoiled[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.unpack_block(bytes(spoiled), coder))


def expected(library, docs):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("small", [{}, {"lanes": 8, "block": 400, "every": 64}])
def test_write_and_read(spark, library, small):
    docs = [(k * 7 % 1009, t) for k, t in enumerate(ODD + texts(300) + ["many words " * 2_000])] + [(-5, None), (5000, ""), (None, "no id")]
    manifest, table = token_files.write(spark.createDataFrame(docs, SCHEMA).repartition(5), Workspace(spark, "tokens-test"), VOCABULARY, **small)
    rows = token_files.read(manifest, table, span=1, ids=True).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == [(*r[:4], r[4]) for r in expected(library, docs)]
    assert manifest.agg({"docs": "sum"}).first()[0] == len(docs)


def test_rows_that_repeat_an_id(spark, library):
    docs = [(3, "one"), (3, "two words"), (3, "one"), (1, "first"), (9, "last")] + [(4, "the same")] * 200
    rows = token_files.read(*token_files.write(spark.createDataFrame(docs, SCHEMA), Workspace(spark, "tokens-test"), VOCABULARY, block=50)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(i for i, _ in docs)
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    assert sorted(r["ids_crc32"] for r in rows) == sorted(r[3] for r in expected(library, docs))


def test_empty_table_and_clashing_columns(spark, library):
    assert token_files.read(*token_files.write(spark.createDataFrame([], SCHEMA), Workspace(spark, "tokens-test"), VOCABULARY)).count() == 0
    rows = spark.createDataFrame([(1, "some text", "x", 5, "y", 2, True)], SCHEMA + ", ids string, file int, row string, start int, id boolean")
    got = token_files.read(*token_files.write(rows, Workspace(spark, "tokens-test"), VOCABULARY)).collect()
    assert [tuple(r) for r in got] == [r[:4] for r in expected(library, [(1, "some text")])]


def test_a_spoiled_file_is_not_read(spark):
    manifest, table = token_files.write(spark.createDataFrame([(1, "some text")], SCHEMA), Workspace(spark, "tokens-test"), VOCABULARY)
    system, path = filesystem(manifest.first()["file"])
    with system.open_input_file(path) as f:
        data = f.read()
    with system.open_output_stream(path, compression=None) as f:
        f.write(data[:-30])
    with pytest.raises(Exception, match="no whole token file"):
        token_files.read(manifest, table).collect()
