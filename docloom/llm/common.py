"""What the training-data operators share: bounded Arrow batches and tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows and bytes that an Arrow batch brings to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 250, 4 << 20

#: This driver's folder of written tables, and Spark's setting to delete shuffle files when a statement ends.
_RUN, _CLEAN = uuid.uuid4().hex[:12], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small: long texts make the default of 10,000 rows a batch of gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Larger Arrow batches for what runs inside: rows of a few numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(col: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text column; null is the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("string"), F.lit("")).cast("binary")


def give_back() -> None:
    """Hand memory that is free to the system: the C library keeps what many small and middling arrays took, as long as a worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than GNU's
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, after whose last batch free memory is handed back."""

    @functools.wraps(batches)
    def tidied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(it)
        give_back()

    return tidied


def per_row(df: DataFrame, f: Callable[[bytes], tuple], schema: str, keep: str, data: str = "data", after: Callable[[], None] | None = None) -> DataFrame:
    """Columns of ``schema`` from f(bytes of column ``data``), after column ``keep``; one row for each row. A task calls ``after`` at its end."""
    kept = df.schema[keep]
    out = T.StructType([kept, *T._parse_datatype_string(schema).fields]) if isinstance(schema, str) else schema
    names = [x.name for x in out.fields]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [f(x) for x in b.column(data).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column(keep), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names=names)
        if after:
            after()
        give_back()

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(x.dataType) for x in out.fields[1:]]
    bounded(df.sparkSession)
    return df.select(keep, data).mapInArrow(batches, out)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only a local session may do without it."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # what was shuffled isn't needed once the table stands
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote; only for tables that no later plan reads."""
    path = df._docloom_path
    jvm = df.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: 64-bit words of a filter of ids, however many ids there are: what is broadcast has as many rows of 16 bytes at most.
FILTER_WORDS = 1 << 17


def free_name(taken: list[str], base: str) -> str:
    """``base``, with underscores before it as long as a column has that name."""
    known = {c.lower() for c in taken}
    while base.lower() in known:
        base = f"_{base}"
    return base


class IdFilter:
    """Which ids a table may hold: one bit of each id's hash. It never denies an id that is there.

    The bits are merged by Spark and their number is fixed, so the broadcast is bounded; with very many ids it
    lets more rows through, which costs time only. Rows are judged by a broadcast join and never leave the JVM.
    """

    def __init__(self, ids: DataFrame, col: str):
        h = F.xxhash64(F.col(col).cast("string"))
        bits = ids.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("__w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(cast({col} as string)), 58) as int))").alias("b"))
        self.words = stored(bits.groupBy("__w").agg(F.bit_or("b").alias("__b")), "filter")

    def split(self, df: DataFrame, col: str, there: bool) -> DataFrame:
        """The rows of df whose id may be there, or those whose id isn't."""
        h, w, b = (free_name(df.columns, x) for x in ("__h", "__w", "__b"))
        hashed = df.withColumn(h, F.xxhash64(F.col(col).cast("string")))
        words = self.words.select(F.col("__w").alias(w), F.col("__b").alias(b))
        judged = hashed.join(F.broadcast(words), F.pmod(h, F.lit(FILTER_WORDS)) == F.col(w), "left")
        may = F.expr(f"coalesce(shiftrightunsigned({b}, cast(shiftrightunsigned({h}, 58) as int)) & 1L = 1L, false)")
        return judged.where(may if there else ~may).select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
