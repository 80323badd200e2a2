"""Collocations: phrases whose words occur together far more often than apart, mined with suffix automata.

The texts a task reads are cut into shards. Each shard becomes a generalised suffix automaton over the words
of its pieces, bounded in depth: a state is a class of phrases that end at the same positions, has their number
(its endpos count), its longest phrase, and a suffix link to the class of the longest shorter suffix that ends
elsewhere too. The automaton is built breadth first, one sort per depth, instead of word by word; its states and
links are the same. Walking the states enumerates each phrase of the shard once, with its count.

Counts are reduced over all shards in rounds, since a phrase is frequent only if all its parts are:

1. words, 2. pairs of frequent words, 3. longer phrases of frequent pairs are counted by 64-bit hashes. What is
   frequent becomes a Bloom filter of bounded size, which prunes the automata of the next round. It never loses a
   frequent phrase, so a full filter or equal hashes cost work and no result.
4. The phrases that pass all filters are counted again by their text, exactly.

A phrase is subsumed by way of links: of the longer phrases that hold it, the most frequent one is a word longer,
so its suffix link, or the same link of the reversed texts (without the last word), leads to the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm._common import lean, stored

U = np.uint64
#: Words of the longest phrase and least count of a candidate.
DEPTH, LEAST = 4, 30
#: A longer phrase with this share (in percent) of a phrase's count subsumes it.
SHARE = 80
#: Phrases reported for a language.
TOP = 2000
#: Words of a shard. Larger shards move fewer rows; some 150 bytes of memory a word.
SHARD = 750_000
#: Bytes of text split into words at once; a longer text is taken alone.
BLOCK = 1 << 20
#: Bits of a Bloom filter for each frequent phrase, and at most (32 MB; beyond it the filter prunes less).
BITS, MOST_BITS = 16, 1 << 28

_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)
    return h ^ (h >> U(32))


# -- words of a shard


def split_words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(words, text, piece) of the texts that begin at starts in data (UTF-8, one after the other; all but empty)."""
    kind = _KIND[data]
    word = kind == 0
    first = np.zeros(len(data) + 1, bool)
    first[starts] = first[-1] = True
    begins = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    piece = np.cumsum((kind == 2) | first[:-1])[begins]
    at = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(ends - begins, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[word]])])
    return words, np.searchsorted(starts, begins, side="right") - 1, piece


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts) of the texts that are not empty, in blocks."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1))
        rows = i + np.flatnonzero(at[i + 1 : j + 1] > at[i:j])
        if len(rows):
            yield rows, data[at[i] : at[j]], at[rows] - at[i]
        i = j


@dataclass
class Shard:
    """Words in order of text: term of each position, its piece, and of each term language, word and hash.
    A term is a word of one language."""

    term: np.ndarray
    piece: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    word_of: np.ndarray
    words: list[bytes]
    hashes: np.ndarray


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    """Shards of batches of (lang, text), none null, of about size words; one text is never cut."""
    held: list[tuple] = []
    n = last = 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for rows, data, starts in _texts(batch.column(1)):
            words, text, piece = split_words(data, starts)
            if not len(words):
                continue
            held.append((words.dictionary_encode(), [names[c] for c in codes[rows]], text, piece + last))
            last += int(piece[-1])
            n += len(words)
            if n >= size:
                yield _shard(held)
                held, n, last = [], 0, 0
    if held:
        yield _shard(held)


def _shard(held: list[tuple]) -> Shard:
    whole = pa.chunked_array([words for words, *_ in held]).unify_dictionaries()
    words = whole.chunk(0).dictionary.to_pylist()
    codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks]).astype(np.int64)
    langs = list(dict.fromkeys(x for _, names, *_ in held for x in names))
    number = {x: k for k, x in enumerate(langs)}
    lang = np.concatenate([np.array([number[x] for x in names], np.int64)[text] for _, names, text, _ in held])
    terms, term = np.unique(lang * len(words) + codes, return_inverse=True)
    lang_of, word_of = terms // len(words), terms % len(words)
    seed = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], U)
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in words], U)
    return Shard(term, np.concatenate([p for *_, p in held]), langs, lang_of, word_of, words, _mix(hashes[word_of] ^ seed[lang_of]))


# -- automata


@dataclass
class Phrases:
    """The phrases of one depth: endpos counts, suffix links (phrases of the depth before), the phrase without the
    last word, the last term, hashes, and whether a phrase ends where one of the next depth does, so that its class
    has a longer phrase."""

    count: np.ndarray
    link: np.ndarray
    head: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    absorbed: np.ndarray


def automaton(shard: Shard, depth: int, passes) -> list[Phrases]:
    """The generalised suffix automaton of a shard down to a depth, without what passes(depth, hashes) refuses."""
    at = shard.term  # phrase that starts at each position, -1: none
    none = np.zeros(0, np.int64)
    n = len(shard.hashes)
    out = [Phrases(np.bincount(at, minlength=n), none, none, np.arange(n), shard.hashes, np.zeros(n, bool))]
    at = np.where(passes(1, shard.hashes)[at], at, -1)
    for k in range(2, depth + 1):
        if len(at) < 2:
            break
        before = out[-1]
        fits = (at[:-1] >= 0) & (at[1:] >= 0) & (shard.piece[: len(at) - 1] == shard.piece[k - 1 :])
        where = np.flatnonzero(fits)
        pair, one, which, count = np.unique(at[where] * n + shard.term[where + k - 1], return_index=True, return_inverse=True, return_counts=True)
        head, last = pair // n, pair % n
        link = at[where[one] + 1]
        hashes = _mix(before.hash[head] * U(0xA0761D6478BD642F) + shard.hashes[last])
        before.absorbed[link[count == before.count[link]]] = True
        out.append(Phrases(count, link, head, last, hashes, np.zeros(len(count), bool)))
        open_ = passes(k, hashes)
        at = np.full(len(at) - 1, -1)
        at[where[open_[which]]] = which[open_[which]]
    return out


def states(levels: list[Phrases]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, phrases, counts) for all phrases, each once: every state gives its longest phrase and, along the
    links, the shorter ones that share its endpos count."""
    for top in range(len(levels), 0, -1):
        of = np.flatnonzero(~levels[top - 1].absorbed)
        count, k = levels[top - 1].count[of], top
        while len(of):
            yield k, of, count
            if k == 1:
                break
            link = levels[k - 1].link[of]
            same = levels[k - 2].count[link] == count
            of, count, k = link[same], count[same], k - 1


# -- rounds


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & U(bits - 1), (h >> U(32)) & U(bits - 1)


@dataclass(frozen=True)
class Bloom:
    """Two bits for each hash; says no only to what is not in it."""

    bits: int
    words: np.ndarray

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for p in _positions(h, self.bits):
            hit &= (self.words[(p >> U(6)).astype(np.int64)] >> (p & U(63)) & U(1)).astype(bool)
        return hit


def bloom(hashes: DataFrame) -> Bloom:
    """Of a column h of hashes; at most MOST_BITS / 64 numbers reach the driver."""
    n = hashes.count()
    bits = 64
    while bits < min(BITS * n, MOST_BITS):
        bits *= 2
    p = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("p")
    rows = hashes.select(p).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows["at"].to_numpy()] = rows["b"].to_numpy()
    return Bloom(bits, words.view(U))


def _counted(docs: DataFrame, depths: tuple[int, ...], filters: dict[int, Bloom], least: int, size: int) -> DataFrame:
    """Hashes (h) of the phrases of these depths that may be frequent."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passing(sent.value)
        for shard in shards(batches, size):
            levels = automaton(shard, max(depths), passes)
            for k, of, count in states(levels):
                if k in depths:
                    yield pa.RecordBatch.from_arrays([pa.array(levels[k - 1].hash[of].view(np.int64)), pa.array(count)], ["h", "c"])

    counts = docs.mapInArrow(lean(run), "h long, c long")
    return stored(counts.repartition("h").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("h"), "phrase-hashes")


def _passing(filters: dict[int, Bloom]):
    return lambda k, h: filters[k](h) if k in filters else np.ones(len(h), bool)


def phrase_counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, size: int = SHARD) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of at most depth words that occur least times or more, and one row of
    no words for each language, with the number of its words.

    docs has lang and text. Null languages are 'und', null texts empty; texts without a word give nothing, not even a
    row of no words. Shards have about size words, which changes no result. Very long texts are taken whole; repeated rows count as often as they occur; other columns are
    not read. An empty table gives no rows.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    filters = {1: bloom(_counted(docs, (1,), {}, least, size))}
    if depth > 1:
        filters[2] = bloom(_counted(docs, (2,), filters, least, size))
    if depth > 2:
        more = tuple(range(3, depth + 1))
        longer = bloom(_counted(docs, more, filters, least, size))
        filters |= dict.fromkeys(more, longer)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _passing(sent.value)
        for shard in shards(batches, size):
            total = np.bincount(shard.lang_of[shard.term], minlength=len(shard.langs))
            yield _rows(shard.langs, [""] * len(total), 0, total)
            levels, texts = automaton(shard, depth, passes), {}
            found = [(k, of[ok], count[ok]) for k, of, count in states(levels) for ok in (passes(k, levels[k - 1].hash[of]),)]
            for k, of, count in sorted(found, key=lambda x: x[0]):
                said = [_say(shard, levels, texts, k, p) for p in of.tolist()]
                yield _rows([shard.langs[x] for x in shard.lang_of[levels[k - 1].last[of]]], said, k, count)

    return docs.mapInArrow(lean(run), "lang string, phrase string, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("words") == 0))


def _say(shard: Shard, levels: list[Phrases], texts: dict[tuple[int, int], str], k: int, p: int) -> str:
    """The text of phrase p of depth k; what is said once is kept."""
    if (k, p) not in texts:
        word = shard.words[shard.word_of[levels[k - 1].last[p]]].decode()
        texts[k, p] = word if k == 1 else f"{_say(shard, levels, texts, k - 1, int(levels[k - 1].head[p]))} {word}"
    return texts[k, p]


def _rows(langs: list[str], said: list[str], k: int, count: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array(said, pa.string()), pa.array(np.full(len(said), k, np.int32)), pa.array(count.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "f"])


# -- scores


def _part(phrase: Column, start, length) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, share: int = SHARE, top: int = TOP, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best top phrases of 2 to depth words for each language.

    score: 2,000,000 a / (l + r), rounded down, at the cut after word k that makes it least, the first of equal
    ones; a, l, r: how often the phrase, its part up to the cut, and the rest occur; n: words of the language.
    A phrase inside a longer one with share percent of its count or more goes. Ties rank by a, then by the bytes of
    the phrase. Nulls, empty and very long texts, repeated rows and empty tables: see phrase_counts. Numbers are
    decimals of 38 digits where products may pass 64 bits.
    """
    counts = stored(phrase_counts(docs, depth, least, size), "phrases")
    f = counts.filter("words > 0")
    phrases = f.filter("words > 1").withColumnRenamed("f", "a")
    links = F.array_distinct(F.array(_part(F.col("phrase"), F.lit(2), F.col("words") - 1), _part(F.col("phrase"), F.lit(1), F.col("words") - 1)))
    cover = phrases.filter("words > 2").select("lang", F.explode(links).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = phrases.join(cover, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (big("longer") * F.lit(100).cast("decimal(3,0)") < big("a") * F.lit(share).cast("decimal(3,0)")))
    cut = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("*", _part(F.col("phrase"), F.lit(1), F.col("k")).alias("first"), _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20,0)) * CAST(2000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    least_cut = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    total = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the query, from the meaning of the counts alone.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), ws AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k AS words, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM ws, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k
), f AS (
  SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), cand AS (
  SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words > 1 AND f >= 30
), inside AS (
  SELECT lang, a AS longer, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM cand, range(1, 4) AS r(i), (VALUES (2), (3)) AS ks(k) WHERE k < words AND i + k - 1 <= words
), kept AS (
  SELECT c.* FROM cand c LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL) i USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 80 * a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM kept c, range(1, 4) AS ks(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')
  WHERE k < c.words
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
