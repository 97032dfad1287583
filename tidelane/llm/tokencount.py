"""Token counts by separator scan over flat, unindexed token files."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelane.llm.common import scratch

#: Bytes of a block, two for each id.
BLOCK_BYTES = 1 << 20
#: Blocks whose summaries are scanned together before the sums of such spans are scanned.
SPAN = 1024


def encoder(vocabulary: str, pattern: str):
    """A byte-level BPE without special tokens, from a rank file; an id above every rank is free for the separator."""
    import tiktoken

    if not os.path.exists(vocabulary):
        raise FileNotFoundError(f"no vocabulary at {vocabulary}: give its path, one that every executor has")
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str, vocabulary: str, pattern: str, separator: int, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes docs' texts as token files at path, and apart from them which document came where.

    path/kind=block: (file, block, payload): little-endian 16-bit ids, every document followed by the separator, cut
    at block_bytes wherever that falls. path/kind=doc: (file, ordinal, doc_id); the scan does not read it. A file is
    what one task wrote. Null texts are empty documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, file = encoder(vocabulary, pattern), TaskContext.get().partitionId()
        held, block, ordinal = bytearray(), 0, 0

        def rows(kind: str, ids: list, payloads: list, docs_: list | pa.Array) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), pa.array([file] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(payloads, pa.binary()), docs_ if isinstance(docs_, pa.Array) else pa.array(docs_, pa.int64())],
                names=["kind", "file", "place", "payload", "doc_id"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for ids in enc.encode_ordinary_batch([x or "" for x in part.column(1).to_pylist()], num_threads=1):
                    held += np.array([*ids, separator], "<u2").tobytes()
                while len(held) >= block_bytes:
                    yield rows("block", [block], [bytes(held[:block_bytes])], [None])
                    del held[:block_bytes]
                    block += 1
                n = part.num_rows
                yield rows("doc", list(range(ordinal, ordinal + n)), [None] * n, part.column(0))
                ordinal += n
        if held:
            yield rows("block", [block], [bytes(held)], [None])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source.mapInArrow(
        run,
        "kind string, file int, place long, payload binary, doc_id long",
    ).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, payload) of plain token files at a path or glob that Spark reads; an empty file has no block."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    n = F.ceil(F.length("content") / block_bytes).cast("int")
    return files.where(F.length("content") > 0).select("file", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block")).select(
        "file",
        F.col("block").cast("long").alias("block"),
        F.expr(f"substring(content, block * {block_bytes} + 1, {block_bytes})").alias("payload"),
    )


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for x in batch.column(2):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator))
            step = pa.array(np.cumsum([0, *map(len, ends)]).astype(np.int32))
            flat = pa.array(np.concatenate(ends).astype(np.int64) if ends else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(step, flat)],
                names=["file", "block", "size", "ends"],
            )

    return run


def separator_scan(blocks: DataFrame, separator: int, span: int = SPAN) -> DataFrame:
    """(file, ordinal, n_tokens): the ids of each document of flat token files, without its separator.

    blocks: (file, block, payload), blocks counted from 0 in each file. A vectorised search finds each block's
    separators; a prefix scan over block sizes, separator counts and last separators (first inside spans of blocks,
    then over spans) gives each block its start, its first ordinal and where the document that it begins in began.
    Ids behind the last separator of a file are a document of their own, if there are any. Files without ids have
    none; ids are 16 bits wide and a block holds whole ids.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = blocks.select("file", F.col("block").cast("long").alias("block"), "payload").mapInArrow(
        _scan(separator),
        f"file {kind}, block long, size long, ends array<long>",
    )
    found = found.withColumn("span", F.expr(f"block div {span}"))
    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = found.withColumn("at", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn(
        "k",
        F.coalesce(F.sum(F.size("ends").cast("long")).over(inner), F.lit(0)),
    )
    near = near.withColumn("prev", F.max(F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))).over(inner))
    whole = near.groupBy("file", "span").agg(
        F.sum("size").alias("s"),
        F.sum(F.size("ends").cast("long")).alias("c"),
        F.max(F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1))).alias("e"),
    )
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = whole.withColumn("s0", F.coalesce(F.sum("s").over(outer), F.lit(0))).withColumn("c0", F.coalesce(F.sum("c").over(outer), F.lit(0)))
    far = far.withColumn("e0", F.max(F.col("s0") + F.col("e")).over(outer)).withColumn(
        "final",
        F.lead("span").over(Window.partitionBy("file").orderBy("span")).isNull(),
    )
    rows = near.join(far.select("file", "span", "s0", "c0", "e0", "s", "final"), ["file", "span"])
    rows = rows.withColumn(
        "prev",
        F.coalesce(F.col("prev") + F.col("s0"), F.col("e0"), F.lit(-1)),
    ).withColumn("at", F.col("at") + F.col("s0")).withColumn("k", F.col("k") + F.col("c0"))
    closed = F.transform(
        "ends",
        lambda e,
        i: F.struct(
            (F.col("k") + i).alias("ordinal"),
            (e + F.col("at") - F.when(i > 0, F.col("at") + F.try_element_at("ends", i)).otherwise(F.col("prev")) - 1).alias("n_tokens"),
        ),
    )
    done = F.col("at") + F.col("size")
    tail = done - 1 - F.when(F.size("ends") > 0, F.col("at") + F.try_element_at("ends", F.lit(-1))).otherwise(F.col("prev"))
    open_ = F.when(
        F.col("final") & (done == F.col("s0") + F.col("s")) & (F.col("size") > 0) & (tail > 0),
        F.array(F.struct((F.col("k") + F.size("ends")).alias("ordinal"), tail.alias("n_tokens"))),
    )
    out = rows.select("file", F.explode(F.concat(closed, F.coalesce(open_, F.expr("array()")))).alias("x"))
    return out.select("file", F.col("x.ordinal").cast("long").alias("ordinal"), F.col("x.n_tokens").cast("long").alias("n_tokens"))


def document_counts(docs: DataFrame, vocabulary: str, pattern: str, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) for each row of docs, counted in flat files written to the shared folder."""
    spark = docs.sparkSession
    path = scratch(spark, "flat")
    write_flat(docs, path, vocabulary, pattern, separator, block_bytes)
    read = spark.read.schema("file int, place long, payload binary, doc_id long, kind string").parquet(path)
    blocks = read.where("kind = 'block'").select("file", F.col("place").alias("block"), "payload")
    names = read.where("kind = 'doc'").select("file", F.col("place").alias("ordinal"), "doc_id")
    return names.join(separator_scan(blocks, separator), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
