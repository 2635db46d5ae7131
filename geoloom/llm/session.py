"""Where jobs cut their lineage, and when a side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, that may be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 16 << 20
#: Rows of one key that a task of a join takes at most before the key is dealt over several.
HOT_ROWS = 1000

#: Rows of text that travel to a Python worker at once; ten thousand, Spark's default, would be tens of megabytes.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` at most in this session, so a worker's memory follows its texts and not their number."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def checkpoint_ready(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; where it is unset, a folder of our own on one machine, and an error on several."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder; lost executors cost no recomputation."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of their own in the shared checkpoint folder."""
    checkpoint_ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(df: DataFrame) -> tuple[int, int]:
    """Rows, and the bytes of their values."""
    varying = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BinaryType)]
    width = sum(8 for f in df.schema if f.name not in varying)
    sums = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)).alias(f"_{i}") for i, c in enumerate(varying)]
    got = df.agg(F.count("*").alias("_rows"), *sums).first()
    return got[0], got[0] * width + sum(got[1:])


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    n, size = _bytes(df)
    return n <= rows and size <= BROADCAST_BYTES


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is measured to be within the bounds, else left to a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


def join_one(
    rows: DataFrame, one: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS, rows_bound: int = BROADCAST_ROWS, fits: bool | None = None
) -> DataFrame:
    """``rows`` with what ``one`` says of their key (a row a key at most).

    A small ``one`` is broadcast (``fits``, where it was measured before).  Else keys with more than ``hot_rows`` rows
    are dealt over several tasks, to each of which their row of ``one`` goes.
    """
    if is_small(one, rows_bound) if fits is None else fits:
        return rows.join(F.broadcast(one), on, how)
    hot = cut(rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")))
    if not hot.limit(1).count():
        return rows.join(one, on, how)
    # A hot key stands for hot_rows rows, so these are few against the rows; beyond the bound Spark deals with them.
    hot, parts = small(hot, rows_bound), F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    copied = one.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")
