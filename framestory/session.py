"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "framestory", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the library expects (used by tests and bench)."""
    b = SparkSession.builder.appName(app)
    b = b.master(master or f"local[{cores}]")
    return (
        b.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framestory-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, shared by all executors."""
    import uuid

    _ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"
