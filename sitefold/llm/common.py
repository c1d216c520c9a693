"""Shared helpers: table access, reliable cuts of the lineage, let-bindings, checked broadcasts."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.checkpoints import durable, shared_folder

__all__ = ["deleted", "durable", "let", "shared_folder", "shipped", "small", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as Parquet, which is smaller there than a checkpoint, and the path, to be ``deleted`` when done."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def deleted(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within ``limit``; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


#: Largest Arrow batches that are sent to Python, in bytes and rows; workers hold a few of them at a time.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def shipped(spark: SparkSession) -> SparkSession:
    """Lets the executors' Python import this package (sent once per application through Spark) and bounds the batches that they get."""
    context = spark.sparkContext
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = int(str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    if getattr(context, "_sitefold_sent", None) != context.applicationId:
        top, packed = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            for name in sorted(top.rglob("*.py")):
                out.write(name, str(name.relative_to(top.parent)))
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/sitefold_code.zip")
        stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        stream.write(packed.getvalue())
        stream.close()
        context.addPyFile(path.toString())
        context._sitefold_sent = context.applicationId
    return spark
