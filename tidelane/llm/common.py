"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Where that is unset it is a folder in the warehouse, or in local mode, where driver and tasks are one process, a
    temporary one.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if path := spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None):
        return path
    local = spark.sparkContext.master.startswith("local")
    path = tempfile.mkdtemp(prefix="tidelane-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidelane-shared"
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder, below one folder for each application (see clean)."""
    return f"{shared_dir(spark)}/tidelane-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Removes all that this application wrote to the shared folder. DataFrames that read from it can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidelane-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder as Parquet and read from there.

    Lost executors do not bring its lineage back, and readers get columns and sizes of a table.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_with(df: DataFrame, *figures: Column) -> tuple[DataFrame, dict]:
    """cut, and figures (named aggregates) of its rows, which the writing tasks gather: no further query and job."""
    seen = Observation()
    return cut(df.observe(seen, *figures)), seen.get


#: The setting that bounds an Arrow batch to a Python worker, and the bytes at which texts are cut into batches here.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """What runs meanwhile hands rows to Python in batches of about `most` bytes, as both the executor and the worker hold one.

    10,000 rows, Spark's own batch, are tens of MB of text. A lower setting of the session stays.
    """
    before = spark.conf.get(BATCH_SETTING, None)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if before else 0
    if 0 < size <= most:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(most))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, checkpointed once in the shared folder: as cut, without a table's columns and sizes, and with less memory to write."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def learnable(doc_id: Column) -> Column:
    """True for rows that labels may be learned from: crc32 of the id as text is no multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y): at most `bound` labelled rows, those whose ids hash lowest, one row an id.

    Of several texts of one id that with the lowest hash counts; of several labels the highest. The sample is the only
    bounded part of a fit; bound is its documented limit. Rows without label, id or text are no examples.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learnable(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")


#: Most rows of a table that is broadcast.
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast once a count shows that it has no more than `rows` rows; larger ones join by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Inner join of a left side with hot keys and a right side that has each key once.

    The right side is broadcast if it has no more than `rows` rows. Otherwise every key is dealt over `salts` places
    by `by`, a hash of the left row, and the right side is repeated for each.
    """
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), keys)
    dealt = left.withColumn("salt_", F.pmod(by, F.lit(salts)).cast("int"))
    copies = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "salt_"]).drop("salt_")


def join_frequent(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int, most: int | None = None) -> DataFrame:
    """Left join with a right side that has each key once and, in `count`, how many of the `rows` left rows have it.

    Keys of so many left rows that no more than BROADCAST_ROWS have as many are joined by broadcast, others by a
    shuffle; count itself is not returned. most: the greatest count, if it is known; where it makes no key frequent, the
    join is a plain one.
    """
    often = max(1000, 1 + rows // BROADCAST_ROWS)
    if most is not None and most < often:
        return left.join(right.drop(count), keys, "left")
    added = [c for c in right.columns if c not in (*keys, count)]
    hot = right.where(F.col(count) >= often).drop(count).withColumn("hot_", F.lit(True))
    near = left.join(F.broadcast(hot), keys, "left")
    rest = near.where("hot_ is null").drop("hot_", *added).join(right.where(F.col(count) < often).drop(count), keys, "left")
    return near.where("hot_").drop("hot_").unionByName(rest)


def parts_of(rows: int, least: int = 64, most: int = 1_000_000) -> int:
    """Into how many parts that many rows are dealt where an order runs over all of them; a part has 10,000 or so."""
    return max(least, min(rows // 10_000, most))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body (or a lambda in it) refers to it."""
    return F.transform(F.array(value), body)[0]
