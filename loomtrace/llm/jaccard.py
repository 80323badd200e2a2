"""N-gram Jaccard join by parity sketches.

The shingles of a document are hashed to 64 bits. A sketch has a row of words: each shingle is
XORed into the word of its part of the hash range, so one shingle changes one word, and the number
of differing words is at most the symmetric difference D of the two sets. In a size band the sketch
has a fixed number of words. Jaccard of t or more bounds D by (1 - t) / (1 + t) (a + b) for sizes
a and b, so of any D + 1 words of one document one is equal in the other (pigeonhole): documents
meet on equal words. A 1024-bit parity sketch of single bits then rejects by its Hamming distance,
which is also at most D, and the exact sets decide.

Which D + 1 words a document shows is free as long as both sides rank words by content alone: words
with more rare shingles come first (a counting table of fixed size says which are frequent), so
passages that many documents share do not bring them together.

Components are exact without all pairs: copies are one class; each word's documents are first
linked to its hub; only then do pairs that still lie in different components meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm._common import lean, stored
from loomtrace.llm.components import components

U = np.uint64
#: Bits of the table of shingle counts (fixed size, whatever the input) and rows it travels in.
COUNT_BITS, CHUNKS = 20, 64
#: Shingles per sketch word, and words of the bit sketch.
PER_WORD, BIT_WORDS = 3, 16
#: Distinct words whose hashes, and sets whose digests, a task keeps at once; it forgets all beyond that,
#: which costs time and changes no result.
CACHE, SEEN = 100_000, 500_000
#: Ids that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_IDS = 200_000
GROWTH = 1.5


def _bands() -> list[int]:
    out, x = [1], 1.0
    while out[-1] < 2**40:
        x *= GROWTH
        if int(np.ceil(x)) > out[-1]:
            out.append(int(np.ceil(x)))
    return out


BANDS = _bands()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, k: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; ASCII letters are lowered. With fewer words
    the whole sequence is one shingle; without words there is none."""
    ws = text.encode("utf-8", "replace").lower().split() if text else []
    if not ws:
        return np.zeros(0, U)
    h = np.fromiter(map(cache.__getitem__, ws), U, len(ws))
    if len(h) < k:
        h = np.concatenate([h, np.zeros(k - len(h), U)])
        extra = U(len(ws))
    else:
        extra = U(0)
    n = len(h) - k + 1
    s = h[:n] + extra
    for j in range(1, k):  # in order: an odd multiplier between words
        s *= U(0x9E3779B97F4A7C15)
        s += h[j : j + n]
    s = _mix(s)
    s.sort()
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


class Threshold:
    """Jaccard of num / den or more."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def most(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def largest(self, n: int) -> int:
        """Largest size that a set of n can link with."""
        return n * self.den // self.num


def sketch_keys(s: np.ndarray, rare: np.ndarray, limit: Threshold) -> list[np.ndarray]:
    """Keys of the words that a set shows, in its size band and, if it can link there, later ones."""
    n, out = len(s), []
    j = int(np.searchsorted(BANDS, n, side="right")) - 1
    top = limit.largest(n)
    while j < len(BANDS) - 1 and BANDS[j] <= top:
        low, high = BANDS[j], BANDS[j + 1] - 1
        need = limit.most(n + min(top, high)) + 1
        parts = max(-(-high // PER_WORD), limit.most(high + limit.largest(high)) + 2)
        part = ((s >> U(32)) * U(parts)) >> U(32)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sig = np.bitwise_xor.reduceat(s, start)
        at = part[start]
        if len(start) > need:
            count = np.diff(np.append(start, n))
            order = np.lexsort((sig, -count, -np.add.reduceat(rare, start)))[:need]
            sig, at = sig[order], at[order]
        elif len(start) < need:  # few words hold shingles: empty words must serve too
            free = np.setdiff1d(np.arange(parts, dtype=U), at)
            sig, at = np.concatenate([sig, np.zeros(len(free), U)]), np.concatenate([at, free])
        out.append(_mix(sig ^ _mix(at + U(low << 20))))
        j += 1
    return out


def _bit_sketch(s: np.ndarray) -> np.ndarray:
    bit = _mix(s + U(77)) >> U(54)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _counts(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Bits of the count table whose shingles are in many more documents than the mean."""
    size = 1 << COUNT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache, seen = np.zeros(size, np.uint32), WordHash(), set()
        for batch in batches:
            got, held = [], 0
            for t in batch.column(0):
                s = shingles(t.as_py(), k, cache)
                sig = xxhash.xxh64_intdigest(s.tobytes())
                if sig in seen:  # a task's copies count once
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sig)
                got.append(s >> U(64 - COUNT_BITS))
                held += len(s)
                if held > 1 << 18:
                    np.add.at(table, np.concatenate(got).astype(np.int64), np.uint32(1))
                    got, held = [], 0
            if got:
                np.add.at(table, np.concatenate(got).astype(np.int64), np.uint32(1))
        parts = table.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "n"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(size // CHUNKS, np.int64)
        for b in rows.column("n"):
            total += np.frombuffer(b.as_buffer(), np.uint32)
        return pa.table({"chunk": rows.column("chunk")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    tables = docs.select(text).mapInArrow(lean(count), "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary")
    out = np.zeros((CHUNKS, size // CHUNKS), np.int64)
    for r in tables.collect():  # CHUNKS rows of fixed size
        out[r["chunk"]] = np.frombuffer(r["n"], np.int64)
    out = out.ravel()
    return out > 4 * out.mean() + 16


def _describe(docs: DataFrame, text: str, k: int, limit: Threshold) -> DataFrame:
    """(doc_id, n, sig, bits, keys): a task's second and later copies of a set show no keys, nor do rows
    without an id."""
    frequent = docs.sparkSession.sparkContext.broadcast(_counts(docs, text, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, cache, seen = frequent.value, WordHash(), set()
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                n, sig, bits, keys = [], [], [], []
                for named, t in zip(batch.column(0).is_valid().to_pylist(), batch.column(1).to_pylist(), strict=True):
                    s = shingles(t, k, cache)
                    n.append(len(s))
                    sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bits.append(_bit_sketch(s) if len(s) else np.zeros(0, np.int64))
                    first = named and len(s) and sig[-1] not in seen
                    if first:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(sig[-1])
                    rare = (~heavy[(s >> U(64 - COUNT_BITS)).astype(np.int64)]).astype(np.int64)
                    keys.append(np.concatenate(sketch_keys(s, rare, limit)).view(np.int64) if first else np.zeros(0, np.int64))
                lists = lambda x: pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists(bits), lists(keys)], ["doc_id", "n", "sig", "bits", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(lean(run), "doc_id long, n long, sig binary, bits array<long>, keys array<long>")


def _within(limit: Threshold, d: Column, total: Column) -> Column:
    return (limit.den + limit.num) * d <= (limit.den - limit.num) * total


def _may_link(limit: Threshold) -> Column:
    """Whether the sizes and bit sketches of the sides a and b allow a link."""
    differ = sum((F.bit_count(F.get("sa", k).bitwiseXOR(F.get("sb", k))) for k in range(1, BIT_WORDS)), F.bit_count(F.get("sa", 0).bitwiseXOR(F.get("sb", 0))))
    total = F.col("na") + F.col("nb")
    return _within(limit, F.abs(F.col("na") - F.col("nb")), total) & _within(limit, differ, total)


def _survivors(pairs: DataFrame, info: DataFrame, limit: Threshold) -> DataFrame:
    """Pairs (a, b) whose sizes and bit sketches allow a link."""
    side = lambda x: info.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_may_link(limit)).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, text: str, k: int, limit: Threshold) -> DataFrame:
    """The pairs (a, b) that link, by their exact sets."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", text).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, k, cache).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and limit.den * both >= limit.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # written once: both sides of the join read it, and no task runs more than one Python worker
    s = stored(texts.mapInArrow(lean(sets), "doc_id long, s binary"), "pair-sets")
    side = lambda x: s.select(F.col("doc_id").alias(x), F.col("s").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, copy_of).

    Documents link when den * intersection >= num * union of their k-word shingle sets, with num
    over half of den. component_id is the least id that links reach; copy_of is the least id with
    the same set. No caps and no sampling: every word of every sketch that the bound calls for is
    joined.

    Null and empty texts (or without words) have no shingles and link with nothing; very long ones
    are shingled whole. Repeated rows are copies; rows that share an id are one document of several
    texts. Rows with a null id come back with a null component. Of hubs of equal weight the one of
    least id stands, which changes the order of the work and no result. An empty table gives an
    empty one; other columns are not read. Ids are whole numbers, else it is an error.
    """
    if not isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError("doc_id must be a whole number")
    limit = Threshold(num, den)
    told = stored(_describe(docs, text, k, limit), "sketches")
    info = told.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "sig", "bits").dropDuplicates(["doc_id", "sig"])
    # written, so that the engine may split the group of a text that many documents copy
    first = stored(info.groupBy("n", "sig").agg(F.min("doc_id").alias("rep")), "sets")
    rep = stored(info.select("doc_id", "n", "sig").join(first, ["n", "sig"]).select("doc_id", "rep"), "copies")
    reps = info.join(rep.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")  # all texts of an id
    links = rep.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    shown = told.filter("doc_id IS NOT NULL").select("doc_id", F.explode("keys").alias("key"))
    shared = shown.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    met = stored(shown.join(shared, "key").join(rep, "doc_id").groupBy("key", "rep").agg(F.max("c").alias("c")), "met")
    # the hub of a word is its document that shares most words with most others: the text that
    # edited copies stem from, if it is there, is nearer to each copy than the copies are to each other
    weight = met.groupBy("rep").agg(F.sum("c").alias("w"))
    hubs = met.join(weight, "rep").groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("m"))).alias("hub"))
    stars = met.select("key", F.col("rep").alias("a")).join(hubs, "key").select("a", (-F.col("hub.m")).alias("b"), F.col("hub.w").alias("w")).filter("a <> b").distinct()
    kept = _survivors(stars.select("a", "b"), reps, limit)
    stars = stored(stars.join(kept, ["a", "b"]), "stars")

    # each document against its heaviest hub, then the stars that are still apart
    near = stars.groupBy("a").agg(F.max_by("b", F.struct("w", (-F.col("b")).alias("m"))).alias("b"))
    stars = stars.select("a", "b")
    links = stored(links.unionByName(_verified(near, docs, text, k, limit)), "links")
    own = components(links)

    def apart(pairs: DataFrame, own: DataFrame) -> DataFrame:
        of = lambda x: own.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest = stored(apart(stars, own), "apart")
    if not rest.isEmpty():
        links = stored(links.unionByName(_verified(rest, docs, text, k, limit)), "links")
        own = components(links)

    # every other pair that meets on a word and is still apart
    placed = met.select("key", "rep").join(own.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    sized = info.select(F.col("doc_id").alias("rep"), "n", "bits").dropDuplicates(["rep", "bits"])
    placed = stored(placed.join(mixed, "key").join(sized, "rep"), "placed")
    if not placed.isEmpty():
        # sketches are compared inside the join, so only pairs that may link leave it
        side = lambda x: placed.select("key", F.col("rep").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
        pairs = side("a").join(side("b"), "key").filter(F.expr("ca <> cb AND a > b") & _may_link(limit)).select("a", "b").distinct()
        pairs = stored(pairs.join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross")
        if not pairs.isEmpty():
            links = stored(links.unionByName(_verified(pairs, docs, text, k, limit)), "links")
            own = components(links)
    ids = rep.groupBy("doc_id").agg(F.min("rep").alias("copy_of"))
    back = told.select("doc_id", F.col("n").alias("n_shingles")).join(ids, "doc_id", "left").join(own.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return back.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))
