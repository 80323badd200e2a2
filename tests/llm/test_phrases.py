"""Phrase mining against plain counting."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def sample(seed=1, n=600):
    r = random.Random(seed)
    words = [*"abcde", "aa", "cc"] + ["É", "ü x", "A", "Bb"]
    ends = [" "] * 8 + [". ", ",", "\n", "\t", "  ", ";;", "\x0b", "!? "]
    say = lambda k: "".join(r.choice(words) + r.choice(ends) for _ in range(k))
    rows = [(k, say(r.randint(1, 60)), r.choice(["en", "en", "fr", None])) for k in range(n)]
    rows += [(n + k, "one two three four five", "en") for k in range(40)] + [(n + 50 + k, "Zed ONE two. zed", None) for k in range(35)]
    return rows + [(None, "zed one two", None), (900, None, "en"), (901, "", None), (902, " \t\n", "de"), (903, "a b c " * 4000, "fr"), rows[0], rows[0]]


def counts(rows, depth):
    f = collections.Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, depth + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    return f


def brute(rows, least=30, share=80, top=2000):
    f = counts(rows, 4)
    n = collections.Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and inside(p, q) and 100 * c >= share * a for (x, q), c in cand.items()):
            continue
        score, k, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, x, y) in enumerate(sorted(xs)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("seed", "size", "top"), [(1, 10**6, 2000), (2, 300, 5)])
def test_collocations_equal_brute_force(spark, seed, size, top):
    rows = sample(seed)
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size, top=top))
    want = brute(rows, top=top)
    assert got == want and len(want) > 10 and {x[0] for x in want} >= {"en", "fr", "und"}


def test_counts_do_not_depend_on_filters(spark, monkeypatch):
    """Full Bloom filters prune nothing and lose nothing."""
    rows = sample(3)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert rows_of(phrases.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_other_depths(spark):
    rows = sample(4, 60)
    for depth in (1, 2, 5):
        got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.phrase_counts(spark.createDataFrame(rows, SCHEMA), depth, 20).filter("words > 0").collect()}
        assert got == {(lang, " ".join(p)): c for (lang, p), c in counts(rows, depth).items() if c >= 20}


def test_empty_and_clashing(spark):
    assert rows_of(phrases.collocations(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], SCHEMA))) == []
    df = spark.createDataFrame([(k, "left right", "en", 1, "x", {"a": 1}) for k in range(30)], SCHEMA + ", phrase int, h string, f map<string,int>")
    assert rows_of(phrases.collocations(df)) == [("en", 1, "left right", 30, 30, 30, 60, 1_000_000)]


def test_states_are_classes_of_end_positions():
    rows = [(k, t, "en") for k, t in enumerate(["a b c a b d. a b c", "b c a b c", "d d d d d"])]
    batch = pa.RecordBatch.from_arrays([pa.array([x[2] for x in rows]), pa.array([x[1] for x in rows])], ["lang", "text"])
    (shard,) = phrases.shards(iter([batch]), 10**6)
    levels = phrases.automaton(shard, 4, lambda k, h: np.ones(len(h), bool))
    ends = collections.defaultdict(set)
    for d, (_, text, _) in enumerate(rows):
        for p, piece in enumerate(text.split(".")):
            ws = piece.split()
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    ends[tuple(ws[i : i + k])].add((d, p, i + k))
    texts: dict = {}
    said = lambda k, p: tuple(phrases._say(shard, levels, texts, k, p).split(" "))
    seen = {}
    for k, of, count in phrases.states(levels):
        for p, c in zip(of.tolist(), count.tolist(), strict=True):
            assert said(k, p) not in seen
            seen[said(k, p)] = c
            if k > 1:
                assert said(k - 1, int(levels[k - 1].link[p])) == said(k, p)[1:]
            if k < 4:
                longer = [q for q in ends if len(q) == k + 1 and q[1:] == said(k, p) and ends[q] == ends[said(k, p)]]
                assert levels[k - 1].absorbed[p] == bool(longer)
    assert seen == {p: len(e) for p, e in ends.items()}


def test_sql_equals_operator(spark, tmp_path):
    import duckdb

    rows = sample(5)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({phrases.ORACLE})").fetchall())
    assert rows_of(phrases.collocations(df)) == want
