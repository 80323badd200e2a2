"""Token replay and alignments of whole logs: once per variant, in batches on the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.plans.petri import COSTS, STATE_LIMIT, LimitReached, PetriNet, align, replay, replayable, worst_cost


#: The side of a move that does not take part.
NONE = ">>"


def token_replay(variants: DataFrame, net: PetriNet) -> DataFrame:
    """(trace, freq, produced, consumed, missing, remaining) per variant (trace, freq)."""
    replayable(net)
    sent = variants.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [replay(sent.value, t) for t in pdf["trace"]]
            yield pdf.assign(**{n: [g[k] for g in got] for k, n in enumerate(("produced", "consumed", "missing", "remaining"))})

    return variants.select("trace", "freq").mapInPandas(run, "trace array<string>, freq long, produced long, consumed long, missing long, remaining long")


def replay_summary(replayed: DataFrame) -> DataFrame:
    """One row: the four counts over all cases, and the fitness."""
    s = replayed.agg(*[F.sum(F.col(c) * F.col("freq")).alias(c) for c in ("produced", "consumed", "missing", "remaining")])
    part = lambda a, b: F.when(F.col(b) > 0, 1 - F.col(a) / F.col(b)).otherwise(1.0)
    return s.withColumn("fitness", F.round(0.5 * part("missing", "consumed") + 0.5 * part("remaining", "produced"), 6))


def alignments(variants: DataFrame, net: PetriNet, costs: dict[str, int] = COSTS, limit: int = STATE_LIMIT) -> DataFrame:
    """(trace, freq, cost, worst, moves, status) per variant; moves is `activity|transition` joined
    by spaces with >> for none, status ok, unreachable or limit."""
    sent = variants.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = worst_cost(sent.value, [], costs)
        for pdf in batches:
            rows = []
            for t in pdf["trace"]:
                t = list(t)
                worst = None if base is None else base + costs["log"] * len(t)
                try:
                    got = align(sent.value, t, costs, limit)
                    rows.append((None, worst, None, "unreachable") if got is None else (got[0], worst, " ".join(f"{a or '>>'}|{b or '>>'}" for a, b in got[1]), "ok"))
                except LimitReached:
                    rows.append((None, worst, None, "limit"))
            out = pdf.assign(status=[r[3] for r in rows], moves=[r[2] for r in rows])
            for k, n in enumerate(("cost", "worst")):
                out[n] = pd.array([r[k] for r in rows], dtype="Int64")
            yield out[["trace", "freq", "cost", "worst", "moves", "status"]]

    return variants.select("trace", "freq").mapInPandas(run, "trace array<string>, freq long, cost long, worst long, moves string, status string")


def moves_checked(aligned: DataFrame, run: str, silent: Iterable[str] = ()) -> DataFrame:
    """(trace, freq, cost, spelled, charged, matched, runs) of alignments: what the moves of the log spell, what the moves
    cost by themselves, whether moves of both sides agree, and whether the transitions form a run of the net, as a
    regular expression over their names (which are the labels) has it. Which of several best alignments is found is
    free; that it is one can be told from these."""
    moves = F.transform(F.filter(F.split("moves", " "), lambda x: x != ""), lambda x: F.split(x, r"\|"))
    only = lambda k: F.transform(F.filter(moves, lambda x: x[k] != NONE), lambda x: x[k])
    count = lambda f: F.size(F.filter(moves, f)).cast("long")
    charged = count(lambda x: x[1] == NONE) * COSTS["log"] + count(lambda x: (x[0] == NONE) & ~x[1].isin(*silent)) * COSTS["model"]
    both = F.forall(moves, lambda x: (x[0] == NONE) | (x[1] == NONE) | (x[0] == x[1]))
    return aligned.select("trace", "freq", "cost", only(0).alias("spelled"), charged.alias("charged"), both.alias("matched"), F.array_join(only(1), " ").rlike(run).alias("runs"))


def alignment_fitness(aligned: DataFrame) -> DataFrame:
    """One row: total cost, log fitness, average trace fitness, share of perfect cases, unsolved cases."""
    ok = F.col("status") == "ok"
    own = F.when(F.col("worst") > 0, 1 - F.col("cost") / F.col("worst")).otherwise(1.0)
    n = F.sum(F.when(ok, F.col("freq")))
    return aligned.agg(
        F.sum(F.when(ok, F.col("cost") * F.col("freq"))).alias("total_cost"),
        F.round(1 - F.sum(F.when(ok, F.col("cost") * F.col("freq"))) / F.sum(F.when(ok, F.col("worst") * F.col("freq"))), 6).alias("log_fitness"),
        F.round(F.sum(F.when(ok, own * F.col("freq"))) / n, 6).alias("average_fitness"),
        F.round(F.sum(F.when(ok & (F.col("cost") == 0), F.col("freq")).otherwise(0)) / n, 6).alias("perfect"),
        F.sum(F.when(ok, 0).otherwise(F.col("freq"))).alias("unsolved"))


def spark_fitness(spark, batch: int = 64):
    """How candidate places replay, counted over variants on the executors in parts and summed; for
    use with alpha.discover."""
    from loomtrace.plans.alpha import place_counts

    def fitness(variants, candidates, strict):
        if not candidates or not variants:
            return [(0, 0, 0.0)] * len(candidates)
        sent = spark.sparkContext.broadcast(candidates)

        def run(batches):
            for pdf in batches:
                got = place_counts(zip(pdf["trace"], pdf["freq"].tolist(), strict=True), sent.value, strict)
                rows = [(k, x, n, f) for k, r in got.items() for x, (n, f) in [*r[2].items(), ("", (r[0], r[1]))]]
                yield pd.DataFrame(rows, columns=["k", "act", "n", "f"])

        df = spark.createDataFrame([(list(t), n) for t, n in variants.items()], "trace array<string>, freq long").repartition(max(1, len(variants) // batch))
        out = [[0, 0, 1.0] for _ in candidates]
        sums = df.mapInPandas(run, "k long, act string, n long, f long").groupBy("k", "act").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).filter("n > 0")
        for r in sums.collect():  # candidates times activities
            if r["act"] == "":
                out[r["k"]][:2] = r["n"], r["f"]
            else:
                out[r["k"]][2] = min(out[r["k"]][2], r["f"] / r["n"])
        return [(n, f, low if n else 0.0) for n, f, low in out]

    return fitness


def variant_dict(variants: DataFrame) -> dict[tuple[str, ...], int]:
    """Variants on the driver, for discovery of a model; as many rows as there are variants."""
    return {tuple(r["trace"]): r["freq"] for r in variants.toLocalIterator()}
