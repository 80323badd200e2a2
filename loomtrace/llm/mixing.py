"""Mixing sources to target weights by a time-varying curriculum. DataFrame operations only.

Every source has a weight, which sets its target of words, and a slope b, which tilts its share
over training time t in [0, 1]: its demand density is proportional to 1 + b (1 - 2 t). The
integral G(t) = t + b (t - t^2) is inverted in closed form, so the copy of a document that starts
at the c-th word of its source's demand is trained at position G^-1(c / target).

Prefix sums run in two levels (buckets of a source, rows of a bucket), so that a source holding a
third of all rows is spread over thousands of window groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm._common import SEPARATORS, fresh, stored

#: Weights and curriculum slopes by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
SLOPES = (0.5, 0.0, -0.5)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SEPARATORS), lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, slope, target) from rows (source, size).

    Targets share the sum of all sizes by weight; none is above max_epochs times its source, and
    what is cut off goes to the others by weight. With ratio r = cap / weight, the cut sources are
    the first of the order by r. Cutting one too many lowers the level, so the level is the largest
    of those that are consistent: running sums find it, no iteration does. The running sums go over
    one row per source in one task (about 40 bytes a source; the sort may spill).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % len(values) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", pick(weights).alias("weight"), pick(slopes).alias("slope"))
    cap = F.col("source_size") * max_epochs
    order = W.orderBy(F.col("r"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (
        ranked.withColumn("r", cap / F.col("weight"))
        .withColumn("cut", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("all") - F.col("cut")) / F.col("rest"))
        .withColumn("lambda", F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(W.partitionBy()))
    )
    target = F.least(cap.cast("double"), F.col("weight") * F.coalesce("lambda", F.lit(0.0)))
    return level.select("source", "source_size", "weight", "slope", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, partial: bool = True, weights=WEIGHTS, slopes=SLOPES, max_epochs: int = MAX_EPOCHS, row: Column | None = None) -> DataFrame:
    """One row per document (doc_id, source, size, source_size, target, taken, copies, position, positions).

    Documents of a source stand in the order of the MD5 of their id (without an id, of their text)
    and are taken round after round until the demand is met. partial: the last copy may be cut to
    the demanded words; else whole copies are taken, a copy if its middle lies within the demand.
    taken is in words, copies counts (partial) copies, positions are their training times in [0, 1],
    and position is the first of them (null if nothing is taken).

    Null text: size 0, never taken. Null source: a source of its own, ranked last. Repeated rows
    count each for itself; rows that tie in id and size are alike, so their order changes nothing
    but which of them is taken. Very long texts count whole. An empty table gives an empty one. Other
    columns are ignored. row: a digest that breaks ties of the order and comes back as the column row.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(F.col("text"), F.lit(""))))))
    carried = [] if row is None else [row.alias("row")]
    sizes = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("h"), F.substring(key, 1, 3).alias("bucket"), *carried), "mix-sizes")
    targets = source_targets(sizes, weights, slopes, max_epochs)
    buckets = (
        sizes.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
        .withColumn("before", F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("in_bucket"))
    )
    plan = buckets.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select(
        F.col("b.source").alias("p_source"), F.col("b.bucket").alias("p_bucket"), "before", "source_size", "target", "slope")
    own = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *(["row"] if carried else [])).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = sizes.withColumn("run", F.sum("size").over(own) - F.col("size")).join(
        plan, F.expr("source <=> p_source AND bucket = p_bucket"))
    start = F.col("before") + F.col("run")
    took = [_taken(start + e * F.col("source_size"), F.col("size"), F.col("target"), partial) for e in range(max_epochs)]
    b = F.col("slope")

    def at(demand: Column) -> Column:
        c = F.least(F.lit(1.0), demand / F.col("target"))
        return F.round(F.when(b == 0, c).otherwise(((1 + b) - F.sqrt((1 + b) * (1 + b) - 4 * b * c)) / (2 * b)), 9)

    places = F.array_compact(F.array(*[F.when(t > 0, at(start + e * F.col("source_size"))) for e, t in enumerate(took)]))
    out = rows.select("doc_id", "source", "size", "source_size", "target", sum(took[1:], took[0]).alias("taken"), places.alias("positions"), *(["row"] if carried else []))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.size("positions").cast("long").alias("copies"), F.get("positions", F.lit(0)).alias("position"), "positions", *(["row"] if carried else []))


def _taken(start: Column, size: Column, target: Column, partial: bool) -> Column:
    """Words taken of the copy that stands at start; the demand is rounded to whole words."""
    demand = F.floor(target + 0.5)
    if partial:
        return F.greatest(F.lit(0), F.least(size, demand - start)).cast("long")
    return F.when((size > 0) & (start + size / 2 <= demand), size).otherwise(0).cast("long")


def copies_in_order(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, sorted by range of training position.

    Rows are known by a digest of all their columns, so rows without an id or with a shared one are
    taken each for itself; rows equal in every column come as often as all of them are taken. An
    empty table gives an empty one. docs may have further columns of any name: they come back
    unchanged.
    """
    row = F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), 256)
    plan = stored(mix(docs, partial=False, row=row, **options).filter("copies > 0").select(F.col("row").alias("digest"), "positions"), "mix-plan")
    again = stored(plan.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "mix-again")
    packed = docs.select(F.struct(*docs.columns).alias("whole"), row.alias("digest"))
    if again.isEmpty():
        taken = packed.join(plan, "digest")
    else:  # one row stands for its equals
        one = packed.join(again, "digest", "left_semi").groupBy("digest").agg(F.first("whole").alias("whole"))
        taken = packed.join(again, "digest", "left_anti").join(plan, "digest").unionByName(one.join(plan, "digest").select("digest", "whole", "positions"), allowMissingColumns=False)
    out = taken.select("whole", F.explode("positions").alias("position"))
    return out.orderBy("position", "whole.doc_id", F.xxhash64("whole.text")).select("whole.*")


def in_training_order(df: DataFrame) -> DataFrame:
    """Sort by range of the position; what is not taken comes last."""
    return df.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def times(positions: Column) -> list[Column]:
    """position_2, position_3, ...: training times of the later copies, null where there is none."""
    return [F.get(positions, F.lit(e)).alias(f"position_{e + 1}") for e in range(1, MAX_EPOCHS)]


ORACLE = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, '')))) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS m FROM per),
w AS (SELECT source, source_size, m + 1 AS weight, CASE m WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS b,
             source_size * 3 / (m + 1)::DOUBLE AS r FROM k),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM w),
t AS (SELECT *, least((source_size * 3)::DOUBLE, weight * (max(CASE WHEN lev <= r THEN lev END) OVER ())) AS target FROM l),
c AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.b, floor(t.target + 0.5)::BIGINT AS d,
             (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(0, least(size, d - start)) + greatest(0, least(size, d - start - source_size)) + greatest(0, least(size, d - start - 2 * source_size)) AS taken,
             unnest([0, 1, 2]) AS e FROM c),
y AS (SELECT *, greatest(0, least(size, d - start - e * source_size)) > 0 AS now, least(1.0::DOUBLE, (start + e * source_size) / target) AS c FROM x),
z AS (SELECT *, CASE WHEN now THEN round(CASE WHEN b = 0 THEN c ELSE ((1 + b) - sqrt((1 + b) * (1 + b) - 4 * b * c)) / (2 * b) END, 9) + 0.0 END AS tm FROM y)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN ceil(taken / size)::BIGINT ELSE 0 END AS copies, tm AS position,
       b1 AS position_2, b2 AS position_3
FROM (SELECT *, lead(tm, 1) OVER w AS b1, lead(tm, 2) OVER w AS b2 FROM z WINDOW w AS (PARTITION BY doc_id, size, source_size, target, start ORDER BY e)) WHERE e = 0
"""
