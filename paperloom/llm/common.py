"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: narrow rows go many at a time, long texts few.
BATCH_ROWS, BATCH_BYTES = 10_000, 2_000_000

_local_dir: list[str] = []
#: Folders and tables that operators made for themselves, in order, and that nothing has removed yet.
_made: list[tuple[str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir; if unset, one in the warehouse, or a temporary one where all run on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="paperloom-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return "file://" + _local_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def own_path(spark: SparkSession, name: str) -> str:
    """A new path that drop_intermediates removes."""
    _made.append((new_path(spark, name), None))
    return _made[-1][0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Remove what operators wrote for themselves after the first ``since``, but for the last ``keep``.

    Results that still read them are lost, so this is for when those are written or used up.
    """
    stop = len(_made) - keep
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path, table in _made[since:stop]:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _made[since:stop]


def made_so_far() -> int:
    """How many intermediates there are: what comes after them is of the caller."""
    return len(_made)


def drop_named(spark: SparkSession, names: Sequence[str], since: int) -> None:
    """Remove those of the intermediates after the first ``since`` that materialise wrote by these names, as nothing reads them again."""
    for at in reversed(range(since, len(_made))):
        if _made[at][0].rsplit("/", 1)[1].rsplit("-", 1)[0] in names:
            drop_intermediates(spark, at, keep=len(_made) - at - 1)


def settled(build: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What build returns, as a table in the shared folder; what it wrote on its way is removed."""
    since = len(_made)
    out = materialise(build(), name)
    drop_intermediates(spark, since, keep=1)
    return out


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As materialise, dealt into buckets by key: joins on the key don't shuffle it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    _made.append((path, table))
    return spark.table(table)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fields_of(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_columns(
    df: DataFrame, ddl: str, fn: Callable[[pa.RecordBatch], Sequence[pa.Array]]
) -> DataFrame:
    """df with the columns of ddl, computed batch by batch; columns of these names are replaced."""
    small_batches(df.sparkSession)
    new = fields_of(ddl)
    df = df.drop(*[f.name for f in new])
    names = [*df.columns, *[f.name for f in new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names=names)
        release()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new]))


def shuffle_partitions(df: DataFrame) -> int:
    """Partitions for an explicit exchange of df: as configured, and no fewer than the scan has."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(col: str = "text"):
    """Never-null 64-bit hash of a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(col), F.lit("")))
