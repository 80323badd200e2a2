"""I-Match fingerprints with randomised lexicon subsets. DataFrame operations only.

The lexicon keeps the terms whose document frequency lies in a band. Frequencies are exact, counted
by 64-bit term hashes over all documents. A lexicon term stands in a share LOW of the documents or
more, so there are at most (mean number of distinct terms of a document) / LOW of them, whatever the
size of the corpus: the lexicon goes to the executors inside the plan, as a hash table. A text's
distinct lexicon terms are sorted and hashed once for each of several random subsets of the lexicon:
four levels that sample the lexicon at rates 1, 1/4, 1/16 and 1/64, each dealt into 16 subsets. Long
texts still agree in the sparse levels after edits, short ones in the dense levels.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm._common import let, stored

SPLIT = r"[\x20\x09-\x0D.,;:!?]+"
#: Bits of a term hash that no subset is dealt by.
FREE_BITS = 20
#: Band of document frequency, as shares of all documents.
LOW, HIGH = 0.001, 0.03
LEVELS, CELLS = 4, 16
NONE = "-" * 8
#: Rows of a range that the order of ids is worked out in.
RANGE_ROWS = 100_000


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the terms of a text; empty for null."""
    ws = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")
    return F.array_distinct(F.transform(ws, lambda w: F.xxhash64(w)))


def learn_lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Sorted hashes of the terms in the band; all documents count."""
    terms = docs.select(F.explode(term_hashes(F.col(text))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    total = docs.select(F.count("*").alias("n"))
    kept = df.join(F.broadcast(total), (F.col("df") >= F.greatest(F.lit(2), F.col("n") * low)) & (F.col("df") <= F.greatest(F.lit(2), F.col("n") * high)))
    return sorted(r[0] for r in kept.select("term").collect())  # bounded, see above


def _table(lexicon: list[int]) -> tuple[Column, int]:
    """The lexicon as an array of slots, a power of two of them, that hold the hashes of their low bits."""
    size = 1
    while size < len(lexicon):
        size *= 2
    slots: list[list[int]] = [[] for _ in range(size)]
    for h in lexicon:
        slots[h & (size - 1)].append(h)
    return F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>"), size - 1


def fingerprint(text: Column, lexicon: list[int]) -> Column:
    """LEVELS * CELLS hashes of 8 hex digits in a row, dashes for subsets without a term; a digest
    of the text (t and 16 digits) if no term of it is in the lexicon."""
    slots, mask = _table(lexicon)

    def known(h: Column) -> Column:
        return F.array_contains(F.get(slots, h.bitwiseAND(mask).cast("int")), h)

    def digest(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(0xFFFFFFFF))), 8, "0")).otherwise(NONE)

    def sampled(terms: Column, level: int) -> Column:
        return F.filter(terms, lambda h: F.shiftrightunsigned(h, 40).bitwiseAND((1 << 2 * level) - 1) == 0) if level else terms

    def dealt(terms: Column, at: int) -> Column:
        cell = lambda c: F.filter(terms, lambda h: F.shiftrightunsigned(h, at).bitwiseAND(CELLS - 1) == c)
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: let(cell(c), digest))

    def level_rows(terms: Column, level: int) -> Column:
        return let(sampled(terms, level), lambda s: dealt(s, FREE_BITS + 4 * level))

    def subsets(terms: Column) -> Column:
        rows = [level_rows(terms, level) for level in range(LEVELS)]
        own = F.concat(F.lit("t"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16))
        return F.when(F.size(terms) > 0, F.array_join(F.flatten(F.array(*rows)), "")).otherwise(own)

    return let(F.sort_array(F.filter(term_hashes(text), known)), subsets)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the best level's share of equal hashes among the subsets that
    either text has terms in, levels of fewer than three such subsets left out."""
    def level(n: int) -> Column:
        piece = lambda x, k: F.substr(x, F.lit(8) * (k + n * CELLS) + 1, F.lit(8))
        cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: F.struct(piece(a, k).alias("a"), piece(b, k).alias("b")))
        return let(F.filter(cells, lambda c: (c["a"] != NONE) | (c["b"] != NONE)), lambda c: F.when(
            F.size(c) >= 3, F.size(F.filter(c, lambda x: x["a"] == x["b"])) / F.size(c)).otherwise(0.0))

    lone = a.startswith("t") | b.startswith("t")
    return F.when(a == b, 1.0).when(lone, 0.0).otherwise(F.greatest(*[level(n) for n in range(LEVELS)]))


def neighbours(rows: DataFrame) -> DataFrame:
    """(rid, take, next_rid) of rows (rid, doc_id, take): next by falling doc_id, null ids last,
    ties by rid; the first follows the last. Ranges of (id, rid), so that shared and null ids are
    split too, are ordered each for itself, and their ends meet in a table with a row for each."""
    rows = stored(rows.distinct(), "order")
    order = (F.col("doc_id").desc_nulls_last(), F.col("rid").asc())
    parts = max(1, rows.count() // RANGE_ROWS + 1)
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    place = W.partitionBy("range").orderBy(*order)
    inner = ranged.withColumn("follow", F.lead("rid").over(place)).withColumn("k", F.row_number().over(place))
    first = inner.filter("k = 1").select("range", F.col("rid").alias("head"))
    ends = first.select("range", F.coalesce(F.lead("head").over(W.orderBy("range")), F.first("head").over(
        W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("wrap"))
    return inner.join(F.broadcast(ends), "range").select("rid", "take", F.coalesce("follow", "wrap").alias("next_rid"))


def compare_edited(docs: DataFrame, lexicon: list[int] | None = None, text: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, next_doc_id).

    The edited text is the text with its last third replaced by the start of the next document's,
    by falling doc_id; the last is followed by the first. Null texts are empty; very long ones are
    taken whole. Repeated rows are one document in that order and each get a row. Null ids come last;
    ties of ids go by a digest of id and text. A lone document follows itself. An empty table gives
    an empty one; other columns are not read.
    """
    if lexicon is None:
        lexicon = learn_lexicon(docs, text)
    base = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    narrow = base.select("rid", "doc_id", F.floor(F.length("text") / 3).cast("int").alias("take"))
    after = stored(neighbours(narrow), "neighbours")
    full = base.withColumn("fingerprint", fingerprint(F.col("text"), lexicon)).repartition("rid")
    # all columns of full are used on both sides, so that they read one exchange
    heads = after.join(full.select(F.col("rid").alias("next_rid"), F.col("doc_id").alias("next_doc_id"), F.col("text").alias("t"), F.col("fingerprint").alias("next_fingerprint")), "next_rid").select(
        "rid", "take", "next_doc_id", F.substring("t", F.lit(1), F.col("take")).alias("head"), "next_fingerprint")
    if narrow.count() != after.count():
        heads = heads.dropDuplicates(["rid"])
    edited = full.join(heads, "rid").select(
        "doc_id", "next_doc_id", F.length("text").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("take")), "head").alias("edited"))
    out = edited.select("doc_id", "next_doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited"), lexicon).alias("edited_fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).cast("double").alias("near_next"), "next_doc_id")
