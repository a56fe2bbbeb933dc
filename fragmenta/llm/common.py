"""What the operators of this subpackage share: paths, scratch tables and small joins."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = Path(__file__).resolve().parents[2]
#: White space that separates words, as a class in a regular expression.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed or on their path."""
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(ROOT) in on_path or getattr(sc, "_fragmenta_shipped", False):
        return
    folder = tempfile.mkdtemp()  # the driver's own: Spark serves the file to the executors
    path = os.path.join(folder, "fragmenta_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in (ROOT / "fragmenta").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
    sys.path.remove(path) if path in sys.path else None
    sc._fragmenta_shipped = True


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that every executor sees, under spark.checkpoint.dir.

    A folder of this machine serves only where the setting is missing and the session is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='fragmenta-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Lets Spark delete a query's shuffle files when the query has ended, instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table in the shared folder: cuts the lineage, survives lost executors. The
    shuffle files that made it go at once."""
    spark = df.sparkSession
    path, before = scratch(spark, what), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # the setting holds for queries planned from here on
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def freed(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that written() made. Nothing that reads them may run after this."""
    for t in tables:
        if t is not None and getattr(t, "_scratch", None):
            sc = t.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
            t._scratch = None


def join_small(left: DataFrame, right: DataFrame, on: str, how: str, max_rows: int = 20_000) -> DataFrame:
    """Join with a table that is broadcast only after its rows were counted and found few.

    right must be cheap to read again, as a written table is. Beyond max_rows, Spark chooses.
    """
    few = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if few else right, on, how)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def add_by_batch(docs: DataFrame, inputs: list[str], fields: str, start) -> DataFrame:
    """docs with further columns that Python makes, an Arrow batch at a time.

    start() is called once in a task and returns a function from the inputs (lists) to the new
    columns (lists or Arrow arrays), in the order of fields (DDL). Other columns pass through
    untouched; those named like a new one are replaced.
    """
    new = T.StructType.fromDDL(fields)
    keep = [f for f in docs.schema.fields if f.name not in new.fieldNames()]
    kinds = to_arrow_schema(new).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            made = work(*(c.to_pylist() for c in batch.columns[len(keep) :]))
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*(f.name for f in keep), *new.fieldNames()])

    columns = [F.col(f"`{f.name}`") for f in keep] + [F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)]
    return docs.select(*columns).mapInArrow(run, T.StructType([*keep, *new.fields]))


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose values in a column (strings, bytes or lists) take at most most bytes; a longer value has one of its own."""
    values = batch.column(column)
    width = values.type.value_type.bit_width // 8 if pa.types.is_list(values.type) else 1
    sizes = (pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64) * width), 0
    while start < len(values):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def sampled(df: DataFrame, id: str, most: int, of: int, seed: int = 0) -> DataFrame:
    """At most most rows, by a hash of the id. of: how many rows df has about.

    A first cut by the hash leaves little more than that, so no task sends many rows to the driver.
    """
    share = min(1.0, 1.5 * most / max(1, of) + 20 / max(1, of))
    h = F.xxhash64(F.col(f"`{id}`"), F.lit(seed))
    return df.where(F.pmod(h, F.lit(1 << 40)) <= int(share * (1 << 40))).orderBy(h, F.col(f"`{id}`")).limit(most)


def commonest(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the highest counts, so many whole classes of like counts as hold at most most rows.

    counts should be a written table. The classes are few, so nothing but their sizes is sorted.
    """
    kind = F.floor(F.log2(F.col(n)) * 16)
    sizes = sorted(((r.k, r.rows) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for k, rows in sizes:
        total += rows
        if total > most:
            break
        least = k
    return counts.where(kind >= least) if least is not None else counts.where("false")
