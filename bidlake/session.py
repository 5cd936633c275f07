"""Session construction and the cluster settings the library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on any cluster; sizes (executors, memory, shuffle partitions)
# belong to the submitter and are left alone.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "bidlake", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the library's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder that the session names, else one in its warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on the shared checkpoint folder so that lost executors cost one read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
