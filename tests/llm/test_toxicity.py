"""Toxicity: planted disguises on held-out rows."""

import random
import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import toxicity

TOXIC = ("idiot", "moron", "bastard", "idiots", "bigot")
CLEAN = "the quick brown fox jumps over a lazy dog while seven sailors tell their old story about good weather and a better harbour".split()
DISGUISED = {
    "plain": "idiot", "stretched": "i" * 40 + "diot", "long joined": "-".join(CLEAN[:9]) + "-idiot", "comma": "hello,idiot", "hyphen": "idiot-like", "slash": "you/idiot",
    "possessive": "moron's", "digits": "1d1075", "no letter": "81907", "digits and sign": "1d!07", "spaced": "i i i d i i o t", "long spaced": "b b b b a a s t a r r r d", "separated": "hello,m-o-r-o-n",
    "masked": "b*st*rd", "long separated": "-----".join("bastard"), "sign at the end": "b4st4rd!!", "two words": "x,m0r0n,y",
}
UNTOUCHED = ("hello,story", "good-weather", "a quick one at 10:45", "brown/fox", "it cost 3,107.50 or $455", "s t o r y", "tell???", "what a harbour!!!", "gooood weather", "https://dog.example.com/old?story=12&fox=7", "2024-10-07", "1107", "-" * 60)


def rows(n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(30)]
        if i % 3 == 0:
            words[rng.randrange(30)] = TOXIC[i // 3 % len(TOXIC)]
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_planted_forms_on_held_out_rows(spark):
    train = rows()
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(TOXIC) == set(model.lexicon)
    held = [i for i in range(10_000, 12_000) if zlib.crc32(str(i).encode()) % 5 == 0]
    planted = [(i, f"the quick {text} tells a story") for i, text in zip(held, DISGUISED.values(), strict=False)]
    clean = [(i, f"the quick {text} tells a story") for i, text in zip(held[100:], UNTOUCHED, strict=False)]
    got = {r["doc_id"]: (r["held_out"], r["predicted"]) for r in toxicity.score(spark.createDataFrame(planted + clean, "doc_id long, text string"), model).collect()}
    assert all(h for h, _ in got.values())
    assert [text for i, text in planted if not got[i][1]] == []
    assert [text for i, text in clean if got[i][1]] == []


def test_pruned_search_finds_what_the_whole_search_finds():
    lm = toxicity.LanguageModel({**dict.fromkeys(CLEAN, 5.0), **dict.fromkeys(TOXIC, 40.0)})
    model = toxicity.Model({w: i for i, w in enumerate(TOXIC)}, [], 0.0, lm)
    for token in ("1d107", "m0r*n", "b**tard", "iidiiot", "m-o-r-o-n", "mor?n", "b4$+4rd"):
        want = model.lexicon.get(toxicity.restore(token, lm), -1)
        assert want >= 0 and want in model.feature(token), token


def test_long_tokens_take_linear_time():
    lm = toxicity.LanguageModel(dict.fromkeys(TOXIC, 1.0))
    model = toxicity.Model({w: i for i, w in enumerate(TOXIC)}, [], 0.0, lm)
    assert model.features("i-" * 20_000 + "d-i-o-t") == {0}
    assert model.features("x" * 50_000) == set() and model.features("1-" * 20_000) == set()


def test_every_labelled_row_is_learned_from(spark):
    """A word that only a few of 30,000 labelled rows hold: a sample of 20,000 would see some of them."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 2000 < 20, concat('a bigot ', id), concat('good story ', id)) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2000 < 20 AS INT) AS toxic")
    model = toxicity.train(docs, labels)
    kept = labels.filter(~toxicity.held_out(labels["doc_id"]))
    assert kept.count() > 20_000
    weights, bias = toxicity._fit(kept.selectExpr("toxic", "IF(toxic = 1, array(0), CAST(array() AS array<int>)) AS hits"), 1)
    assert "bigot" in model.lexicon and model.score("a bigot") > 0.5 > model.score("a story")
    assert abs(model.bias - bias) < 1e-3 and weights[0] > 0


def test_labelled_texts_are_read_twice(spark):
    """Once for the word counts, once for what the logistic model is fitted to."""
    train, read = rows(), spark.sparkContext.accumulator(0)

    def text(t):
        read.add(1)
        return t

    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string").withColumn("text", F.udf(text)("text"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int")
    assert set(TOXIC) == set(toxicity.train(docs, labels).lexicon)
    assert 0 < read.value <= 4 * len(train)  # Spark may evaluate the function where it is used, so twice a reading


def test_language_model_counts_all_words(spark, monkeypatch):
    """Runs of letters counted by Spark are those of all words, however many there are."""
    monkeypatch.setattr(toxicity, "VOCABULARY", 5, raising=False)
    train = rows()
    docs = spark.createDataFrame([r[:2] for r in train], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in train], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    counts = {}
    for text in {text for i, text, _ in train if zlib.crc32(str(i).encode()) % 5}:
        for w in set(text.split()):
            counts[w] = counts.get(w, 0) + 1.0
    mass = sum(counts.values())
    want = toxicity.LanguageModel({w: counts.get(w, 0) + (w in model.lexicon) * mass / len(model.lexicon) for w in counts})
    assert len(counts) > 5 and model.lm.letters == want.letters and model.lm.counts.keys() == want.counts.keys()
    assert all(abs(model.lm.probability(h, c) - want.probability(h, c)) < 1e-9 for h, some in want.counts.items() for c in some)


def test_rare_words_are_learned_if_not_by_chance(spark):
    """A word in fewer than a hundredth of the toxic texts, and in no other."""
    docs = spark.range(16_000).selectExpr("id AS doc_id", "CASE WHEN id % 800 = 0 THEN concat('a moron ', id) WHEN id % 4 = 0 THEN concat('a bigot ', id) ELSE concat('good story ', id) END AS text")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS INT) AS toxic"))
    assert set(model.lexicon) == {"bigot", "moron"}
    assert model.score("a moron") > 0.5 > model.score("a story")
