"""Session helpers shared by the queries, tests and the benchmark."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fragmenta")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys to spark.sql.shuffle.partitions tasks: a small file of many rows is read by
    few tasks, however much work each row makes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors see; a folder of this machine
    only where that is unset and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='fragmenta-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed or on their path."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(root) in on_path or getattr(sc, "_fragmenta_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "fragmenta_package.zip")  # the driver's own: Spark serves the file to the executors
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "fragmenta").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    if path in sys.path:
        sys.path.remove(path)
    sc._fragmenta_shipped = True
