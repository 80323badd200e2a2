"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. A ledger holds the
(blob, rule version) pairs that have been scanned, with their findings. A scan reads only the pairs
that the ledger lacks, one representative per blob, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm._common import lean, stored

#: The base rules, in the order that breaks ties of equal starts.
_WORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind -> (pattern, group that is measured, its least length)
BASE_RULES = {
    "assign": (rf"({_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
_PEM = r"[A-Z ]{0,30}PRIVATE KEY-----"
#: A key whose END line is missing: its header lines, chunks of base64 and a short last chunk on a line of its own or
#: with padding. Line ends may be escaped or quoted. Possessive, so the time is linear in the text.
_GAP = r"(?:[\s\"',>#*]|\\[nrt])"
_BODY = rf"(?:\s*+(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{1,2}}+|[\r\n]++[A-Za-z0-9+/]{{1,15}}+(?=[\r\n]|\Z))?+"
#: What this operator adds to the base kinds.
MORE_RULES = {
    "pem": (rf"-----BEGIN {_PEM}(?:(?:[^-]|-(?!----))*+-----END {_PEM}|{_BODY})", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    "bearer": (r"[Bb]earer\x20+[A-Za-z0-9_.~+/-]{20,}=*", 0, 1),
    "urlcred": (r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]{3,}+@", 0, 1),
}
RULES = {**BASE_RULES, **MORE_RULES}
#: A text without this cannot match the rule.
NEEDLES = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ", "github": "gh", "slack": "xox", "bearer": "earer", "urlcred": "://"}
RULE_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]
#: New digests that a broadcast may hold, and bits of the bitmap that serves beyond it.
BROADCAST_ROWS, MARK_BITS = 50_000, 24
FINDINGS = "spans array<struct<kind:string,start:int,end:int>>"


def find_spans(text: str, rules: dict = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then by order of the rules.

    Matches are leftmost and do not overlap within a kind; one whose measured group is too short
    is dropped after it has taken its place.
    """
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(rules.items()):
        if NEEDLES.get(kind, "") not in text:
            continue
        for m in re.finditer(pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py())] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["blob", "spans"]).filter(pa.array([bool(s) for s in spans], pa.bool_()))


def blob_id(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256)


def scan_versions(versions: DataFrame, key: str, content: str, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings per row of versions, new ledger rows).

    versions: one row per historical version of a path; key names the version (unique or not),
    content holds its text. ledger: (blob, rule_version, spans) of earlier scans, or None.
    The first result is versions' key with blob and spans (empty if clean); the second is what the
    caller appends to the ledger: every blob scanned now, clean ones with null spans, so that they
    are not scanned again.

    Which blobs are new is decided on ids and digests alone. Only texts of new blobs move: a broadcast
    of the new digests, or beyond its bound a bitmap of them of fixed size, stops the others at the
    scan. Copies are merged in each task before they are dealt by blob, so a blob that has a third of
    all versions moves once for each task and is scanned once.
    Null content is the empty blob. Null and repeated keys and repeated rows are kept as they are.
    Of a ledger's repeated pairs any counts, as they are equal. Very long contents are scanned whole.
    Empty tables give empty ones. Columns other than key and content are not read.
    """
    blob = blob_id(F.col(content))
    ids = versions.select(F.col(key).alias("key"), blob.alias("blob"))
    texts = versions.select(blob.alias("blob"), F.col(content).cast("string").alias("content")).filter("length(content) > 0")
    known = None
    if ledger is None:
        found = texts.groupBy("blob").agg(F.first("content").alias("content"))
        fresh = ids.select("blob").distinct()
    else:
        known = ledger.filter(F.col("rule_version") == rule_version).select("blob", "spans")
        fresh = stored(ids.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"), "secret-unseen")
        n = fresh.count()
        if n <= BROADCAST_ROWS:
            found = texts.join(F.broadcast(fresh), "blob", "left_semi").groupBy("blob").agg(F.first("content").alias("content"))
        else:
            found = texts.filter(_marked(fresh)).groupBy("blob").agg(F.first("content").alias("content")).join(fresh, "blob", "left_semi")
    found = stored(found.mapInArrow(lean(_scan), f"blob string, {FINDINGS}"), "secret-findings")
    new = fresh.join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    hits = found.select("blob", "spans")
    if known is not None:
        hits = hits.unionByName(known.filter("spans IS NOT NULL").groupBy("blob").agg(F.first("spans").alias("spans")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    back = ids.join(hits, "blob", "left").select(F.col("key").alias(key), "blob", F.coalesce("spans", empty).alias("spans"))
    return back, new


def _slot(blob: Column) -> Column:
    return F.conv(F.substring(blob, 1, MARK_BITS // 4), 16, 10).cast("long")


def _marked(blobs: DataFrame) -> Column:
    """Whether a row's blob may be among blobs: a bitmap over the first bits of the digests."""
    bits = blobs.select(_slot(F.col("blob")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = [0] * (1 << (MARK_BITS - 6))
    for r in bits.collect():  # as many rows as the bitmap has numbers, at most
        table[r["k"]] = r["bits"]
    word = F.get(F.from_json(F.lit(json.dumps(table)), "array<bigint>"), F.shiftright(_slot(F.col("blob")), 6).cast("int"))
    return F.call_function("shiftrightunsigned", word, _slot(F.col("blob")).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mask(texts: pa.Array, spans: pa.Array) -> pa.Array:
    def one(text, found):
        if text is None or not found:
            return text
        out, at = [], 0
        for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
            if out and s["start"] < at:  # the run goes on
                at = max(at, s["end"])
                continue
            out += [text[at : s["start"]], "[SECRET]"]
            at = s["end"]
        return "".join([*out, text[at:]])

    return pa.array([one(t.as_py(), s.as_py()) for t, s in zip(texts, spans, strict=True)], pa.string())


def mask_spans(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by [SECRET]; null stays null."""
    return F.arrow_udf(_mask, "string")(text, spans)
