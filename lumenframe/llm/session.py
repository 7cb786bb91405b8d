"""Where the operators of this subpackage cut lineage, and what they share about sessions and columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the checkpoints and tables made in the innermost released() block, if there is one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is named, a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="checkpoints")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    path = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        keep(df.sparkSession, path.get())
    return out


def keep(spark: SparkSession, path: str) -> str:
    """path, which the released() block that this call is in deletes at its end."""
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes the checkpoints and tables made inside the block when it ends, and no others. For callers that write down inside the
    block all results that read them."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of the map that likely() broadcasts: MAP_BITS / 64 rows of two numbers, whatever the input.
MAP_BITS = 1 << 22


def likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Adds to rows a boolean column `likely`: false only if `column` isn't in wanted (one column of that name).

    The wanted values become a bit map of fixed size, broadcast as a table, so rows are judged where they lie. As the map
    fills up, more rows are likely; what follows must hold for them too. Null is never likely.
    """
    place = F.pmod(F.xxhash64(column), F.lit(MAP_BITS))
    cells = wanted.where(F.col(column).isNotNull()).select(F.floor(place / 64).cast("long").alias("_cell"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))").alias("_bit"))
    cells = cells.groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_cell", F.floor(place / 64).cast("long")).join(F.broadcast(cells), "_cell", "left")
    hit = F.expr(f"coalesce(shiftright(_bits, cast(pmod(xxhash64({column}), 64) as int)) & 1L, 0L) = 1L") & F.col(column).isNotNull()
    return found.withColumn("likely", hit).drop("_cell", "_bits")


#: Rows and bytes of an Arrow batch: texts and shingle sets can be long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df itself, after bounding the session's Arrow batches (read when a plan runs, so they stay bounded); a bound on
    bytes that the session has set stays."""
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if size not in conf.getAll:
        conf.set(size, str(BATCH_BYTES))
    return df


def release() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, it keeps the memory
        ctypes.CDLL(None).malloc_trim(0)


#: Batches after which a task gives memory back.
RELEASED_EACH = 16


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with memory given back every few batches and at the task's end: workers stay beside the executor's heap for
    tasks to come, and would keep what their largest batch took."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, made in enumerate(run(batches), 1):
                yield made
                if k % RELEASED_EACH == 0:
                    del made
                    release()
        finally:
            release()

    return wrapped
