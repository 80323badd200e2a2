"""The jobs as queries: each runs twice into a new folder of the cluster's shared one and returns its whole output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import dialog_flow, trade_performance


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under spark.checkpoint.dir that no other call has; a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_dialog_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_folder(spark, "job1-dialog-flow")
    source = f"{sf_dir}/conversations.parquet*"  # a file or a folder of files
    dialog_flow.run(spark, source, f"{to}/flow", f"{to}/checkpoint")
    return dialog_flow.run(spark, source, f"{to}/flow", f"{to}/checkpoint").drop("bucket")


def job2_trade_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = new_folder(spark, "job2-trade-performance")
    trade_performance.run(spark, sf_dir, to)
    return trade_performance.run(spark, sf_dir, to)


QUERIES = {f.__name__: f for f in (job1_dialog_flow, job2_trade_performance)}
ORACLES = {"job1_dialog_flow": dialog_flow.ORACLE, "job2_trade_performance": trade_performance.ORACLE}
