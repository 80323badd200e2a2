"""Keep the directly-follows edges of dialogues up to date as files of turns arrive.

    python -m jobs.dialog_flow --input conversations/ --output flow/ --checkpoint flow-checkpoint/ --config jobs/dialog_flow.json

A turn (conv_id, turn, role, text) becomes an event: its case is the conversation, its activity the role and what
kind of text it is. The files that came since the last run are taken as a stream that ends (availableNow), in
batches. Each batch

1. adds its events under events/bucket=/batch= (a bucket holds whole conversations),
2. works out the edges of the buckets it touched from all their events and replaces these buckets under
   edges/bucket=: (conv_id, source, target, count, words), with a start and an end for each conversation,
3. says what it read and wrote under runs/batch=.

All three replace partitions that the batch names, so a batch that is run again after a failure writes the same. Turns
may come late, out of order and more than once. Turns without a conversation or a number have no place in a case; they
are kept under unplaced/batch=.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import arguments, log, read_config, session
from loomtrace.operators.cases import END, START
from loomtrace.operators.lives import neighbours

TURNS = "conv_id long, turn long, role string, text string"
EDGES = "conv_id long, source string, target string, count long, words long, bucket int"
#: buckets of conversations; files that a batch writes for each at most; files it reads; words from which a text is long.
DEFAULTS = {"buckets": 16, "files_per_bucket": 1, "files_per_batch": 1000, "long_words": 60}


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def events_of(turns: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(conv_id, turn, activity, words, digest, bucket) of turns. Null roles are 'unknown', null texts empty. The
    activity is the role and 'empty', 'question' (a question mark somewhere), 'long' or 'short'."""
    w = words(F.col("text"))
    kind = F.when(w == 0, "empty").when(F.col("text").contains("?"), "question").when(w >= config["long_words"], "long").otherwise("short")
    return turns.select(
        "conv_id", "turn", F.concat_ws(":", F.coalesce("role", F.lit("unknown")), kind).alias("activity"), w.cast("long").alias("words"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.pmod(F.xxhash64("conv_id"), F.lit(config["buckets"])).cast("int").alias("bucket"))


def edges_of(events: DataFrame) -> DataFrame:
    """(conv_id, source, target, count, words) of directly following activities, words those of the target. An event
    that came several times counts once; what shares a turn is ordered by activity and digest."""
    once = events.dropDuplicates(["conv_id", "turn", "activity", "digest"])
    order = ["turn", "activity", "digest"]
    before = neighbours(once, ["conv_id"], order, {"source": "activity"}, -1)
    inner = before.select("conv_id", F.coalesce("source", F.lit(START)).alias("source"), F.col("activity").alias("target"), "words")
    last = once.groupBy("conv_id").agg(F.max_by("activity", F.struct(*order)).alias("source")).select("conv_id", "source", F.lit(END).alias("target"), F.lit(0).cast("long").alias("words"))
    return inner.unionByName(last).groupBy("conv_id", "source", "target").agg(F.count("*").alias("count"), F.sum("words").alias("words"))


def dealt(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """df by bucket, so that tasks do not write a file each for every bucket; rows of one conversation may be split."""
    return df.repartition("bucket", F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"]), F.lit(config["files_per_bucket"])))


def replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions of path that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict[str, Any] | None = None) -> DataFrame:
    """Take the new files of source, wait for the end, and return all edges."""
    config = DEFAULTS | (config or {})
    replace(spark.createDataFrame([], EDGES), f"{output}/edges", "bucket")  # replaces nothing; the folder is there for readers

    def batch(turns: DataFrame, number: int) -> None:
        spark = turns.sparkSession
        placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
        replace(dealt(events_of(turns.filter(placed), config), config).withColumn("batch", F.lit(number)), f"{output}/events", "bucket", "batch")
        replace(turns.filter(~placed).withColumn("batch", F.lit(number)), f"{output}/unplaced", "batch")
        schema = events_of(turns, config).withColumn("batch", F.lit(number)).schema
        events = spark.read.schema(schema).parquet(f"{output}/events")
        own = events.filter(F.col("batch") == number).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row per bucket
        touched = sorted(r["bucket"] for r in own)
        if touched:
            known = events.filter(F.col("bucket").isin(*touched) & (F.col("batch") <= number))
            in_bucket = F.pmod(F.xxhash64("conv_id"), F.lit(config["buckets"])).cast("int").alias("bucket")
            replace(dealt(edges_of(known).select("*", in_bucket), config), f"{output}/edges", "bucket")
        unplaced = spark.read.schema(turns.withColumn("batch", F.lit(number)).schema).parquet(f"{output}/unplaced").filter(F.col("batch") == number).count()
        said = [(number, sum(r["n"] for r in own), unplaced, len(touched))]
        replace(spark.createDataFrame(said, "batch long, events long, unplaced long, buckets long").coalesce(1), f"{output}/runs", "batch")
        log.info("batch %d: read %d placed and %d unplaced turns, replaced the edges of %d buckets", *said[0])

    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    edges = spark.read.schema(EDGES).parquet(f"{output}/edges")
    log.info("%s: %d batches in this run; wrote to %s", source, len([p for p in query.recentProgress if p["numInputRows"]]), output)
    return edges


#: DuckDB SQL of the edges after all turns.
ORACLE = rf"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), e AS (
  SELECT conv_id, turn, words, sha256(text) AS digest, role || ':' || CASE WHEN words = 0 THEN 'empty' WHEN contains(text, '?') THEN 'question' WHEN words >= {DEFAULTS["long_words"]} THEN 'long' ELSE 'short' END AS activity FROM t
), n AS (
  SELECT conv_id, activity, words, lag(activity) OVER w AS before, lead(activity) OVER w AS after FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, activity, digest)
)
SELECT conv_id, source, target, count(*) AS count, sum(words)::BIGINT AS words FROM (
  SELECT conv_id, coalesce(before, '{START}') AS source, activity AS target, words FROM n
  UNION ALL SELECT conv_id, activity, '{END}', 0 FROM n WHERE after IS NULL
) GROUP BY ALL
"""


def main() -> None:
    args = arguments(__doc__, "input", "output", "checkpoint")
    spark = session("dialog_flow")
    try:
        run(spark, args.input, args.output, args.checkpoint, read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
