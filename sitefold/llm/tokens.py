"""Token counts by a separator scan over flat token files.

A flat file is a run of 16-bit token ids without an index, each document ended by a separator id.  It is
read by byte ranges, one block at a time; every block is searched for separators at once (numpy), and
blocks are stitched by a prefix scan over their summaries: tokens so far, documents so far, place of the
last separator.  Only the summaries, one short row a block, are ordered within a file; a block's own
separators are joined back to them.  Files are read and written through Arrow's file systems (local or
mounted folders, HDFS, S3, GCS) by the executors, so ``spark.checkpoint.dir`` has to be one of those.

Defined cases: null text is a document without tokens; repeated rows are documents of their own;
tokens after the last separator are a document without an end; a last odd byte is no token; empty files
hold no documents; an empty table gives an empty result; a document may span any number of blocks; other
columns are ignored; ids that do not fit into 16 bits raise.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefold.llm.common import shared_folder, shipped, stored

#: Tokens in a block of a flat file.
BLOCK = 1 << 19
#: Bytes of flat files that one task searches.
SEARCHED = 128 << 20
_made: dict[int, object] = {}


def encoding(ranks: bytes, pattern: str):  # noqa: ANN201
    """The byte-level BPE of a file of ranks, made once by each worker."""
    import tiktoken

    key = hash(ranks)
    if key not in _made:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _made[key] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[key]


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, separator: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Writes flat files, one a partition, into ``folder`` (of its own in the shared folder if not given), and gives their blocks.

    A block: file, block, start, bytes and, apart from the file, ``ids`` of the documents that end in it.  Each attempt of a task
    writes a file of its own; the blocks name those of the attempts that succeeded.
    """
    spark = shipped(docs.sparkSession)
    if not 0 <= separator < 1 << 16:
        raise ValueError(f"separator {separator} does not fit into 16 bits")
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    schema = f"file string, block bigint, start bigint, bytes bigint, ids array<{dict(base.dtypes)['doc_id']}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(ranks.value, pattern)
        if code.max_token_value >= 1 << 16:
            raise ValueError("token ids do not fit into 16 bits")
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        out, written, block, kind = None, 0, 0, None
        ends: list = []  # documents that end in the open block
        done: list[tuple] = []  # full blocks not given yet

        def closed(tokens: int) -> None:
            nonlocal block, ends
            done.append((name, block, 2 * block * BLOCK, 2 * tokens, ends))
            block, ends = block + 1, []

        def given() -> pa.RecordBatch:
            nonlocal done
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(kind)]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done = []
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "start", "bytes", "ids"])

        try:
            for batch in batches:
                kind = batch.column(0).type
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = code.encode_to_numpy(text.as_py() or "", disallowed_special=())
                    if out is None:
                        store, path = fs.FileSystem.from_uri(name)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(path)
                    out.write(np.append(ids, separator).astype("<u2").tobytes())
                    written += len(ids) + 1
                    # the separator is the last token written: blocks before its own are full
                    while written > (block + 1) * BLOCK:
                        closed(BLOCK)
                    ends.append(doc)
                if done:
                    yield given()
            if written:
                closed(written - block * BLOCK)
                yield given()
        finally:
            if out is not None:
                out.close()

    return stored(base.mapInArrow(run, schema))[0]


def token_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK) -> DataFrame:
    """Blocks of existing flat files under ``path``: file, block, start, bytes. The files' contents are not read here."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), (F.floor(F.col("length") / 2) * 2).alias("length"))
    size = F.lit(2 * block_tokens).cast("bigint")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / size))).alias("block")
    blocks = files.filter(F.col("length") > 0).select("file", "length", cut).withColumn("start", F.col("block") * size)
    return blocks.select("file", "block", "start", F.least(size, F.col("length") - F.col("start")).alias("bytes"))


def separators(blocks: DataFrame, separator: int) -> DataFrame:
    """Blocks with ``n`` tokens and the places ``ends`` of separators in them, each block read from its file's byte range."""
    spark = shipped(blocks.sparkSession)
    names = [c for c in ("ids",) if c in blocks.columns]
    kinds = dict(blocks.dtypes)
    count, size = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-size // SEARCHED))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None

        def given(part: pa.RecordBatch, sizes: list[int], places: list[np.ndarray]) -> pa.RecordBatch:
            columns = [part.column("file"), part.column("block"), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *[part.column(c) for c in names]], ["file", "block", "n", "ends", *names])

        try:
            for batch in batches:
                at, held, sizes, places = 0, 0, [], []
                for i, (file, start, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "start", "bytes")), strict=True)):
                    if file != name:
                        if source is not None:
                            source.close()
                        store, path = fs.FileSystem.from_uri(file)
                        name, source = file, store.open_input_file(path)
                    raw = source.read_at(length, start)
                    if len(raw) != length:
                        raise OSError(f"{file} ends before byte {start + length}")
                    places.append(np.flatnonzero(np.frombuffer(raw, "<u2") == separator))
                    sizes.append(length // 2)
                    held += len(places[-1])
                    if held >= BLOCK:
                        yield given(batch.slice(at, i + 1 - at), sizes, places)
                        at, held, sizes, places = i + 1, 0, [], []
                if sizes:
                    yield given(batch.slice(at), sizes, places)
        finally:
            if source is not None:
                source.close()

    schema = ", ".join([f"file {kinds['file']}", "block bigint", "n bigint", "ends array<bigint>", *[f"{c} {kinds[c]}" for c in names]])
    # a number of tasks of its own: the rows are a few bytes each, the ranges that they name are not
    dealt = blocks.select("file", "block", "start", "bytes", *names).repartition(tasks, "file", "block").sortWithinPartitions("file", "block")
    return dealt.mapInArrow(search, schema)


def scan(blocks: DataFrame, separator: int) -> DataFrame:
    """Each document of flat files: file, ordinal, n_tokens, ended; with a column ``ids`` of documents that end in a block, also doc_id.

    The files are read before this returns, and what was found is kept in the shared folder: they may be removed afterwards.
    """
    names = [c for c in ("ids",) if c in blocks.columns]
    kind = dict(blocks.dtypes)["ids"][6:-1] if names else ""
    found, _ = stored(separators(blocks, separator))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.get("ends", F.size("ends") - 1)
    line = found.select("file", "block", "n", F.size("ends").cast("bigint").alias("k"), last.alias("last"))
    line = line.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    line = line.withColumns(
        {
            "seen": F.coalesce(F.sum("k").over(before), F.lit(0)),
            "final": F.col("base") + F.col("last"),
            "closes": F.lead("block").over(order).isNull(),
        }
    )
    line = line.withColumn("cut", F.coalesce(F.max("final").over(before), F.lit(-1)))
    base = found.drop("n").join(line.select("file", "block", "n", "base", "seen", "final", "closes", "cut"), ["file", "block"])
    marks = F.transform(
        "ends",
        lambda e, i: F.struct(
            (F.col("seen") + i).alias("ordinal"),
            (F.col("base") + e - 1 - F.when(i == 0, F.col("cut")).otherwise(F.col("base") + F.get("ends", i - 1))).alias("n_tokens"),
            F.lit(True).alias("ended"),
            *[F.get(c, i).alias("doc_id") for c in names],
        ),
    )
    left = F.col("base") + F.col("n") - 1 - F.coalesce("final", "cut")
    rest = F.struct(
        (F.col("seen") + F.size("ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("ended"),
        *[F.lit(None).cast(kind).alias("doc_id") for _ in names],
    )
    none = F.array().cast(f"array<struct<ordinal:bigint,n_tokens:bigint,ended:boolean{',doc_id:' + kind if names else ''}>>")
    tail = F.when(F.col("closes") & (left > 0), F.array(rest)).otherwise(none)
    return base.select("file", F.explode(F.concat(marks, tail)).alias("d")).select("file", "d.*")
