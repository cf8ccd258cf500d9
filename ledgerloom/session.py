"""Session settings and lineage cutting."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Runtime SQL settings the plans are designed around. Adaptive execution picks join
#: strategies from measured sizes, merges small shuffle partitions and splits hot ones
#: -- also below an aggregate, hence the forced skew-join rule.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


#: Settings fixed when a session starts. Recording a call site for every Column costs
#: more than planning when a query has hundreds of expressions; checkpoints nothing
#: refers to any more are deleted.
START_SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **START_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results, as named in ``spark.checkpoint.dir``.

    Without that setting it lies in the warehouse. Nothing is ever written to a folder that only one machine
    sees: on a cluster a warehouse on a local file system, as Spark sets it by default, is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not on_one_machine(sc.master) and is_local(warehouse):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share; the warehouse {warehouse} is local")
        sc.setCheckpointDir(f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def on_one_machine(master: str) -> bool:
    return re.match(r"local(\[|$|-cluster)", master) is not None


def is_local(path: str) -> bool:
    return path.startswith(("file:", "/"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and drop its lineage."""
    folder = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
