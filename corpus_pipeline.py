"""A pipeline over documents in five stages, each written as Parquet before the next reads it.

Every stage but the last returns the columns of its input, unchanged but for what it decides, and
takes further columns of any name. Null texts are empty ones; rows without an id are judged, masked
and mixed like all others, only near duplicates are sought among rows with one. Empty tables give
empty ones. Very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import jaccard, mixing, pieces, secrets, toxicity
from loomtrace.llm._common import fresh, stored, table

#: Words of a shingle and least similarity of near duplicates; op5 has a contract of its own.
WORDS, SIMILAR = 5, (80, 100)
#: Rows of findings that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window is likelier toxic than not go; a tie (0.5) goes. Repeated rows
    are judged alike."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    chance = fresh("score", docs.columns)
    return toxicity.score(docs, net, out=chance).filter(F.col(chance) < 0.5).select(*docs.columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates stays; rows without an id stay. Rows that share an id
    and a text are one document, and one of them stays: that of least digest over all columns, any of equal ones. Texts
    that share an id are documents of their own, told apart by a key of id and text, larger than ids, in the place of the id."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(text).alias("low"), F.max(text).alias("high"))
    shared = stored(ids.filter("n > 1").select("doc_id", (F.col("low") != F.col("high")).alias("several")), "shared-ids")
    key, several = fresh("key", docs.columns), fresh("several", docs.columns)
    if shared.isEmpty():
        keyed = docs.select("*", F.col("doc_id").alias(key), F.lit(None).cast("boolean").alias(several))
    else:
        side = shared.select(F.col("doc_id").alias(f"{key}_id"), F.col("several").alias(several))
        both = docs.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, F.col("doc_id") == F.col(f"{key}_id"), "left")
        own = F.when(F.col(several), F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 61))).otherwise(F.col("doc_id"))
        keyed = both.select(*docs.columns, own.alias(key), several)
    found = jaccard.jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), k=WORDS, num=SIMILAR[0], den=SIMILAR[1])
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "near-duplicates")
    kept = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
    if shared.isEmpty():
        return kept.select(*docs.columns)
    digest = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    one = kept.filter(F.col(several).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*docs.columns), digest).alias("least"))
    return kept.filter(F.col(several).isNull()).select(*docs.columns).unionByName(one.select("least.*"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. Findings depend on content alone, so rows without
    an id and repeated rows have theirs. n_chars follows the masked text."""
    found, _ = secrets.scan_versions(docs, "doc_id", "text")
    found = stored(found.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), "secrets")
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    both = docs.select(F.struct(*docs.columns).alias("whole"), secrets.blob_id(F.col("text")).alias("blob")).join(side, "blob", "left")
    masked = both.select("whole", "spans", secrets.mask_spans(F.when(F.col("spans").isNotNull(), F.col("whole.text")), F.col("spans")).alias("masked"))
    new = {"text": F.coalesce("masked", "whole.text"), "n_chars": F.when(F.col("spans").isNull(), F.col("whole.n_chars")).otherwise(F.length("masked").cast("long"))}
    return masked.select(*[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.copies_in_order(docs)


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    with open(pieces.default_model(), "rb") as f:
        return pieces.encode(docs, f.read())


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("secrets", _secrets),
    ("mixing", _mixing),
    ("encoding", _encoding),
]
#: A trained network and a vocabulary decide rows, which SQL can't express; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
