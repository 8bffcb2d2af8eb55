"""What the training-data operators share: table reading, bounded Arrow batches, shared working storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python. Texts reach megabytes, so a batch holds few rows.
BATCH_ROWS = 256
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the Arrow batch limits of the session to what bounded Python workers can hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only where that is unset, one of our own, which on a cluster would not be shared and is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"


#: Paths of the tables that the steps under way have written, the innermost step last.
STEPS: ContextVar[tuple[list[str], ...]] = ContextVar("STEPS", default=())


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage and survives the loss of executors. Inside of ``step`` it is deleted at the step's end."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    if steps := STEPS.get():
        steps[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def step(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function whose result is stored, after which the tables that it wrote on the way are deleted: what is stored needs none of them again."""

    @wraps(f)
    def run(*args, **how) -> DataFrame:
        own: list[str] = []
        token = STEPS.set((*STEPS.get(), own))
        try:
            out = f(*args, **how)
        finally:
            STEPS.reset(token)
        out = stored(out, f.__name__)
        context = out.sparkSession.sparkContext
        for path in own:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        return out

    return run


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Words of the text operators: digits, a-z after lower-casing A-Z, and everything outside ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; on UTF-8 bytes, as all of its other bytes are word bytes."""
    return data.translate(WORD_BYTES).split() if data else []
