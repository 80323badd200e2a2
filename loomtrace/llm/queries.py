"""The queries of the corpus operators, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import imatch, jaccard, languages, licenses, mixing, phrases, pieces, rules, secrets, substrings, toxicity, urls
from loomtrace.llm._common import stored, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one ledger: the first has the blobs whose digest starts with 0 to 7, as an earlier
    state of the corpus; the second has all rows and scans only what the ledger lacks."""
    docs = table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_versions(docs.filter(secrets.blob_id(F.col("text")) < "8"), "doc_id", "text")
    found, _ = secrets.scan_versions(docs, "doc_id", "text", stored(ledger, "secret-ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secrets.BASE_RULES), F.sha2(secrets.digest(F.col("spans"), tuple(secrets.BASE_RULES)), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.dated(table(spark, sf_dir, "pages"))
    return urls.filter_captures(pages, urls.list_from_hosts(pages)).select("page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "entry", "category", "blocked")


def op7_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.in_training_order(mixed.select("*", *mixing.times(F.col("positions"))).drop("source", "positions"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(pieces.default_model(), "rb") as f:  # the vocabulary is a file of this machine, not of the input
        model = f.read()
    return pieces.encode(table(spark, sf_dir, "documents"), model)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.train())


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs.select("doc_id", "text"), languages.fit(docs)).select("doc_id", languages.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scans, op3_sentencepiece, op4_license_scans, op5_jaccard_join, op6_url_filters, op7_mix_to_weights, op8_imatch_fingerprints, op9_toxicity, op10_suffix_dedup, op11_phrase_mining, op12_language_id)}
ORACLES = {"op6_url_filters": urls.ORACLE, "op7_mix_to_weights": mixing.ORACLE, "op11_phrase_mining": phrases.ORACLE}
