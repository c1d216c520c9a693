"""FASTQ reads: source, demultiplexing and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.schema import require

#: What of a read's header line names it.
NAME = r"[\w:\-+]+"


def read_fastq(spark: SparkSession, path: str, name_pattern: str = NAME) -> DataFrame:
    """file, read_index (from 1 in each file), id, seq and qual.

    Lines are numbered within each split of a file, and splits by the lines before them, so that large
    uncompressed files are read in parallel.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    sizes = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    run = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "split", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "split").orderBy("at"))
    numbered = lines.withColumn("place", place).join(before, ["file", "split"]).withColumn("line", F.col("before") + F.col("place") - 1)
    read = F.floor(F.col("line") / 4) + 1
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    reads = numbered.groupBy("file", read.alias("read_index")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"))
    return reads.select("file", "read_index", F.regexp_extract(F.expr("substring(head, 2)"), name_pattern, 0).alias("id"), "seq", "qual")


def demultiplex(reads: DataFrame, samples: DataFrame) -> DataFrame:
    """Reads with the sampleName that a table of (index, sampleName) gives them."""
    require(samples, "index", "sampleName")
    names = samples.select(F.col("index").cast("bigint").alias("read_index"), "sampleName")
    return reads.join(names, "read_index").select("sampleName", "read_index", "id", "seq", "qual")


def write_demultiplexed(reads: DataFrame, samples: DataFrame, out_folder: str, kind: str, compress: bool = True) -> list[str]:
    """Writes ``<out_folder>/<sample>.<kind>.fastq[.gz]``, one file a sample, in the order of reads; returns the paths.

    Existing files of these names are replaced.
    """
    spark = reads.sparkSession
    text = F.concat(F.lit("@"), F.col("id"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    rows = demultiplex(reads, samples).select("sampleName", "read_index", text.alias("value"))
    temporary = f"{out_folder}/_{kind}"
    ordered = rows.repartition("sampleName").sortWithinPartitions("sampleName", "read_index").select("sampleName", "value")
    ordered.write.mode("overwrite").partitionBy("sampleName").option("compression", "gzip" if compress else "none").text(temporary)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(temporary)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    made = []
    for folder in fs.listStatus(top):  # one folder a sample
        name = folder.getPath().getName()
        if not name.startswith("sampleName="):
            continue
        sample = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[len("sampleName=") :])
        target = jvm.org.apache.hadoop.fs.Path(f"{out_folder}/{sample}.{kind}.fastq{'.gz' if compress else ''}")
        for file in fs.listStatus(folder.getPath()):
            if fs.exists(target):
                fs.delete(target, False)
            fs.rename(file.getPath(), target)
        made.append(str(target.toString()))
    fs.delete(top, True)
    return sorted(made)
