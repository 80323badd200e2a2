"""Language identification: held-out accuracy, reading against a plain loop, awkward tables."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import languages

SCHEMA = "doc_id long, text string, lang string"
#: Syllables of invented languages; those of one family share half of them.
SOUNDS = {
    "de": "sch ung ver ei", "nl": "sch ung ij oe", "fr": "eau tion que ou", "es": "ción tion que ado", "xx": "kli wop zu qa", "xy": "kli wop ня жо",
}


def say(lang, n, r):
    word = lambda: "".join(r.choices(SOUNDS[lang].split(), k=r.randint(1, 4)))
    return " ".join(word() for _ in range(n)).capitalize() + r.choice([".", "!", " 12", ""])


def sample(n=360, seed=5):
    r = random.Random(seed)
    return [(k, say(lang, r.randint(4, 80), r), lang) for k in range(n) for lang in [r.choice(sorted(SOUNDS))]]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit(spark.createDataFrame(sample(), SCHEMA))


def test_held_out_accuracy(spark, model):
    rows = [x for x in sample() if held(x[0])] + [(10_000 + k, t, x) for k, t, x in sample(200, 6)]
    got = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame(rows, SCHEMA).repartition(3), model).collect()}
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([got[k]["score"] for k, _, lang in rows if got[k]["lang_pred"] == lang]) > 0.8


def test_pairs_stay_in_families(model):
    assert dict(model.families)["germanic"] == ["de", "nl"] and dict(model.families)["romance"] == ["es", "fr"]
    assert sum(len(xs) for _, xs in model.families) == len(SOUNDS)
    for (_, names), (pairs, weights) in zip(model.families, model.pairs, strict=True):
        assert pairs == list(combinations(range(len(names)), 2)) and weights.shape[1] == len(pairs)


def test_held_out_rows_and_columns_teach_nothing(spark, model):
    rows = sample()
    lies = [(k, t, "fr") if held(k) else (k, t, lang) for k, t, lang in rows] + [(None, None, "de"), (3, "12 34", "es"), (4, "text", None)]
    lies = [x for x in lies if not (x[0] in (3, 4) and x not in rows)] + rows[:5]
    again = languages.fit(spark.createDataFrame(lies, SCHEMA))
    texts = [t for _, t, _ in sample(60, 9)]
    assert again.predict(texts)[0] == model.predict(texts)[0] and np.allclose(again.predict(texts)[1], model.predict(texts)[1])


def test_sample_is_bounded_and_spread(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(languages, "train", lambda sample, families: seen.extend(x[0] for x in sample))
    languages.fit(spark.createDataFrame(sample(), SCHEMA), per_lang=10)
    assert {x: seen.count(x) for x in seen} == dict.fromkeys(SOUNDS, 10)


def test_awkward_texts(spark, model):
    r = random.Random(1)
    rows = [(1, None, "de"), (2, "", "de"), (3, "12 *** 34\n", None), (None, "Schung ver ei", None), (None, "Schung ver ei", None), (6, say("fr", 60_000, r), None), (7, "\0sch\0ung verung ei", None), (8, "é", None), (9, "́", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("SCORE", F.lit("x")).withColumn("h", F.lit(1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = languages.identify(df, model).collect()
    assert len(got) == len(rows) and "h" in got[0].asDict()
    by = {(r["doc_id"], (r["text"] or "")[:9]): (r["lang_pred"], r["score"]) for r in got}
    assert by[1, ""] == by[2, ""] == by[3, "12 *** 34"] == by[9, "́"] == ("und", 0.0)
    assert [r["lang_pred"] for r in got if r["doc_id"] is None] == ["de", "de"]
    assert [r["lang_pred"] for r in got if r["doc_id"] in (6, 7)] == ["fr", "de"]


def test_empty_tables(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    assert languages.identify(empty, model).collect() == []
    nothing = languages.fit(empty)
    assert [tuple(r) for r in languages.identify(spark.createDataFrame([(1, "word", None)], SCHEMA), nothing).collect()] == [(1, "word", None, "und", 0.0)]
    one = languages.fit(spark.createDataFrame([(k, "word of one", "en") for k in range(9)], SCHEMA))
    assert one.predict(["anything", "7"])[0] == ["en", "und"]


def test_reading_equals_a_plain_loop():
    texts = ["Äb  cé-12d", "", "x", " ab\ncd " * 5]
    weights = np.random.Generator(np.random.PCG64(2)).normal(size=(2**languages.LOG_D + 1, 2))
    weights[-1] = 0
    together = languages.read(texts)
    for k, t in enumerate(texts):
        chars = " " + "".join(c.lower() if c.isalpha() else " " for c in t) + " "
        while "  " in chars:
            chars = chars.replace("  ", " ")
        want, n = np.zeros(2), 0
        for size in range(1, languages.ORDERS + 1):
            for i in range(len(chars) - size + 1):
                h = 0
                for j in range(size):
                    h = (h * 0x9E3779B1 + ord(chars[i + j]) + j + 1) % 2**32
                want += weights[(((h ^ (h >> 15)) * 0x85EBCA6B) % 2**32) >> (32 - languages.LOG_D)]
                n += 1
        assert np.allclose(together.sums(weights)[k], want) and together.total[k] == n
        assert np.allclose(languages.read([t]).sums(weights)[0], want)
    of = np.array([True, False, False, True])
    assert np.allclose(together.sums(weights, of), together.sums(weights)[of])


def test_svm_finds_the_widest_margin():
    rows = [(np.array([0, 1]), np.array(v) / np.linalg.norm(v)) for v in ([1.0, 0.2], [1.0, -0.2], [-1.0, 0.3], [-1.0, -0.3])]
    w = languages.svm(rows, np.array([1, 1, -1, -1]), cost=1000, rounds=2000)
    assert all((w[at] @ x > 0) == (k < 2) for k, (at, x) in enumerate(rows)) and abs(w[1]) < 0.05 * abs(w[0])


def test_families_of_unlisted_languages():
    a, b = np.array([1.0, 1, 0, 0]), np.array([0.0, 0, 1, 1])
    profiles = {"de": a, "zz": a + 0.1 * b, "qq": b}
    assert languages.group(["qq", "zz", "de"], profiles) == [("germanic", ["de", "zz"]), ("of qq", ["qq"])]
