"""Session helpers shared by tests, the bench and jobs that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "palimpsest", cores: str | int = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PALIMPSEST_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; only a local session may pick its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="palimpsest-ckpt-")
    sc.setCheckpointDir(made)
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage through compressed Parquet in the checkpoint folder; the shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    if any(kind == "void" for _, kind in df.dtypes):  # Parquet has no such column
        return checkpointed(df)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANS)
    spark.conf.set(_CLEANS, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove what ``settled`` wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_settled", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not share the driver's folder or path."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._palimpsest_shipped = True
