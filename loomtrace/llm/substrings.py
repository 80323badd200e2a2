"""Exact substring deduplication by bucket-pointer refinement of sampled suffixes.

A suffix stands in the bucket of its first q bytes (q is half of the length that counts), and the
bucket of 2 q bytes is the pair of the bucket identifiers at offsets 0 and q. Of all suffixes only
anchors are sorted at first: every stretch of windows names the least q-gram that all of them hold,
which depends on nothing outside a window, so equal windows name equal anchors at equal offsets.

1. Anchors are sorted into buckets; an anchor alone in its bucket has no repeated window.
2. Buckets are refined by the identifiers at the later offsets that the anchor's windows reach:
   members of one refined bucket repeat each other in all these windows at once, and one of them
   stands for all from here on.
3. Buckets that split are refined down to single windows, one representative per refined bucket.

Each level sorts only what the level before left open and reuses its identifiers. Copies of whole
texts are settled by digest. Hot buckets are counted with map-side sums; joins have no fixed
partitioning, so the engine may split them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm._common import lean, stored

U = np.uint64
#: Bytes taken together; a longer text is taken alone.
BLOCK = 1 << 19
#: Rows, and spans in them (16 bytes each, so 16 MB and 8 MB of ids), that a broadcast side may have; beyond it the same
#: join shuffles.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 1_000_000
#: Digests of texts that a task keeps at once; beyond it all are forgotten, which changes no result.
SEEN = 500_000
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}
_LOW = U(0xFFFFFFFF)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, b, U)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def buckets(data: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the q-grams that start at each byte."""
    n = len(data)
    up, down = _powers(n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(_TABLE[data] * up[:n], dtype=U, out=c[1:])
    return _mix((c[q:] - c[:-q]) * down[: n - q + 1])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * U(0xA0761D6478BD642F) + b)


def zones(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of each run of windows with one anchor.

    b: identifiers of a block of texts, which lie at [starts, ends). Windows have 2 q bytes.
    """
    w, n = q + 1, len(b)
    key = (b & ~_LOW) | np.arange(n, dtype=U)
    rows = -(-n // w)
    pad = np.full(rows * w, ~U(0), U)
    pad[:n] = key
    pad = pad.reshape(rows, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    count = np.maximum(0, ends - starts - 2 * q + 1)
    text = np.repeat(np.arange(len(starts)), count)
    p = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    anchor = (np.minimum(behind[p], ahead[p + w - 1]) & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(p) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(p)) - 1 if len(p) else new
    return text[new], p[new], p[last], anchor[new]


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts, ends) of the texts, in blocks."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        j = min(j, len(texts))
        yield np.arange(i, j), data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i]
        i = j


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_rows(q: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for rows, data, starts, ends in _blocks(batch.column(1)):
                if len(data) < 2 * q:
                    continue
                raw = data.tobytes()
                keep = []  # a task's second copy of a text brings nothing new
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    d = xxhash.xxh3_128_digest(raw[s:e]) if e - s >= 2 * q else b""
                    keep.append(bool(d) and d not in seen)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                keep = np.array(keep, bool)
                b = buckets(data, q)
                text, lo, hi, at = zones(b, starts[keep], ends[keep], q)
                if not len(text):
                    continue
                if not full:
                    yield pa.RecordBatch.from_arrays([_signed(b[at])], ["bucket"])
                    continue
                refined = _pair(_pair(_pair(b[lo], b[lo + q]), _pair(b[hi], b[hi + q])), ((at - lo) * 4096 + hi - lo).astype(U))
                first = starts[keep][text]
                yield pa.RecordBatch.from_arrays(
                    [_signed(b[at]), _signed(refined), pa.array(rid[rows[keep][text]]), pa.array((lo - first).astype(np.int64)), pa.array((hi - lo).astype(np.int16))],
                    ["bucket", "refined", "rid", "lo", "more"])

    return run


def _window_rows(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, spans = batch.column(0).to_numpy(), batch.column(2)
            for rows, data, starts, _ in _blocks(batch.column(1)):
                lists = spans.slice(int(rows[0]), len(rows))
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
                lo, more, single = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                b = buckets(data, q)
                n = more.astype(np.int64) + 1
                p = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(owner, n)
                at = p + starts[own]
                yield pa.RecordBatch.from_arrays(
                    [_signed(_pair(b[at], b[at + q])), pa.array(rid[rows[own]]), pa.array(p), pa.array(np.repeat(single.astype(bool), n))], ["win", "rid", "p", "single"])

    return run


def _merge_rows(length: int):
    """Maximal covered runs of each row's spans, as arrays: one sort, one running maximum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            lo, more = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            order = np.lexsort((lo, owner))
            owner, lo, hi = owner[order], lo[order], (lo + more + length)[order]
            # rows stand one behind another on a line, far enough apart not to touch
            base = owner * (int(hi.max(initial=0)) + 2)
            reach = np.maximum.accumulate(base + hi)
            new = np.concatenate([[True], (base + lo)[1:] > reach[:-1]]) if len(lo) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(lo)) - 1 if len(first) else first
            starts, ends = lo[first], reach[last] - base[first]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(lists)))]).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends - starts - length)], ["lo", "more"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), runs)], ["rid", "spans"])

    return run


def _cut_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                kept, at, removed, runs = [], 0, 0, 0
                for lo, hi in _merged(spans.as_py() or [], length):
                    kept.append(raw[at:lo])
                    removed, runs, at = removed + hi - lo, runs + 1, hi
                kept.append(raw[at:])
                for k, v in enumerate((len(raw), removed, runs, hashlib.sha256(b"".join(kept)).hexdigest())):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _merged(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal covered runs of spans (first window, further windows)."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["lo"] + s["more"] + length) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _side(df: DataFrame) -> DataFrame:
    """df(rid, spans) as the smaller side of a join: broadcast while its checked size is small."""
    n = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("spans")).first()
    return F.broadcast(df) if n["rows"] <= BROADCAST_ROWS and n["spans"] <= BROADCAST_SPANS else df


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    A byte goes if a string of length bytes that covers it starts anywhere else too, in the same
    text or another; strings are judged on the input. n_spans counts maximal removed runs.
    length is even.

    Null texts are empty: nothing goes, and the digest is that of no bytes. Texts shorter than
    length keep all, very long ones are read whole. Repeated rows and rows without an id are texts as
    all others: copies lose all if they are long enough. Of equal windows all go, so ties decide
    nothing. An empty table gives an empty one; other columns are not read.
    """
    q = length // 2
    if length % 2 or not 2 <= q < 4096:
        raise ValueError("length must be even, and under 8192")
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    pairs = rows.select("rid", "text")
    zone_schema = "bucket long, refined long, rid long, lo long, more short"
    full = pairs.mapInArrow(lean(_anchor_rows(q, True)), zone_schema)
    met = stored(pairs.mapInArrow(lean(_anchor_rows(q, False)), "bucket long").groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket"), "buckets")
    open_ = stored(full.join(met, "bucket"), "zones")

    classes = stored(open_.groupBy("bucket", "refined").agg(F.count("*").alias("c"), F.min(F.struct("rid", "lo", "more")).alias("one")), "classes")
    whole = open_.join(classes.filter("c > 1").select("bucket", "refined"), ["bucket", "refined"]).select("rid", "lo", F.col("more").cast("long").alias("more"))
    split = classes.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    left = classes.join(split, "bucket").select("one.*", (F.col("c") == 1).alias("single"))
    asked = stored(left.groupBy("rid").agg(F.collect_list(F.struct("lo", "more", "single")).alias("spans")), "open-zones")

    win = stored(pairs.join(_side(asked), "rid").select("rid", "text", "spans").mapInArrow(lean(_window_rows(q)), "win long, rid long, p long, single boolean"), "windows")
    twice = win.groupBy("win").agg(F.count("*").alias("c")).filter("c > 1").select("win")
    single = win.filter("single").join(twice, "win").select("rid", F.col("p").alias("lo"), F.lit(0).cast("long").alias("more"))

    size = F.octet_length("text")
    same = rows.filter(size >= length).select(F.sha2("text", 256).alias("sha"), "rid", size.cast("long").alias("n"))
    copied = same.groupBy("sha").agg(F.count("*").alias("c")).filter("c > 1").select("sha")
    copies = same.join(copied, "sha").select("rid", F.lit(0).cast("long").alias("lo"), (F.col("n") - length).alias("more")).distinct()

    every = whole.unionByName(single).unionByName(copies).groupBy("rid").agg(F.collect_list(F.struct("lo", "more")).alias("spans"))
    spans = stored(every.mapInArrow(lean(_merge_rows(length)), "rid long, spans array<struct<lo:long,more:long>>"), "repeats")
    return rows.join(_side(spans), "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        lean(_cut_rows(length)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
