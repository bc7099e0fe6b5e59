"""What the operators share: the shared work folder, worker setup and row helpers."""

from __future__ import annotations

import atexit
import ctypes
import io
import shutil
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_folders: set[str] = set()
_own: dict[str, str] = {}
_kept: dict = {}


def kept(key, make):
    """What a worker process keeps from task to task: the tables of one operator at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


@cache
def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Called by tasks that need their worker's memory for themselves, and after work that took much of it.

    Workers live on between tasks, and memory that they have freed stays theirs unless it is given back.
    """
    _kept.clear()
    pa.default_memory_pool().release_unused()
    _trim()(0)


#: Rows and bytes that Spark and a Python worker exchange at once at most, about: texts may be long, and either side holds two such batches.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
BATCH_SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
_before: dict[tuple[str, str], str] = {}


def prepare_workers(spark: SparkSession) -> None:
    """Make this package importable on every executor (once for an application), and bound the batches that workers get.

    The bounds stay with the session, as its plans run later; restore_settings puts back what they were.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        for name in BATCH_SETTINGS:
            _before.setdefault((spark.sparkContext.applicationId, name), spark.conf.get(name))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = _temporary("larkspur-") / "larkspur_workers.zip"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    target.write_bytes(held.getvalue())
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def restore_settings(spark: SparkSession) -> None:
    """Put back the session's settings that prepare_workers changed; results that were not yet read run with them."""
    for name in BATCH_SETTINGS:
        value = _before.pop((spark.sparkContext.applicationId, name), None)
        if value is not None:
            spark.conf.set(name, value)


def _temporary(prefix: str) -> Path:
    """A folder of the driver's own that goes when the driver ends."""
    path = Path(tempfile.mkdtemp(prefix=prefix))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = _temporary("larkspur-checkpoints-").as_uri()
        return _own[application]
    return folder


def table_folder(spark: SparkSession) -> str:
    """Where this application's written tables lie; they go when the driver ends."""
    folder = f"{work_folder(spark)}/larkspur-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove_last, spark, folder)
    return folder


def _remove_last(spark: SparkSession, folder: str) -> None:
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        shutil.rmtree(at.path, ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        _delete(spark, folder)


def clear_tables(spark: SparkSession) -> None:
    """Remove all tables that this application's operators have written; results that were not yet read are lost."""
    _delete(spark, table_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    A lost executor then costs only the tasks that ran on it.
    """
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by materialise that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/larkspur-" in folder:
            _delete(df.sparkSession, folder)


#: Rows with one key that a shuffle may bring to one task, and keys that are broadcast at most because they have more.
HOT_ROWS = 1000
HOT_KEYS = 200_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows joined with table, which has a row for each key and in `size` the number of rows that share it.

    Keys of more than HOT_ROWS rows are few and are broadcast, so that no task gets all rows of one; beyond
    HOT_KEYS of them, where no single one weighs much, all go through the shuffle.
    """
    hot = table.where(F.col(size) > HOT_ROWS)
    if not 0 < hot.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(table, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(table.where(F.col(size) <= HOT_ROWS), keys))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, whatever other columns the table has (names that differ in case only included)."""
    held = df.columns
    picked = []
    renamed = df.toDF(*[f"c{i}" for i in range(len(held))])
    for name in names:
        place = held.index(name) if name in held else next((i for i, c in enumerate(held) if c.lower() == name.lower()), None)
        if place is None:
            raise KeyError(f"the table has no column {name}")
        picked.append(F.col(f"c{place}").alias(name))
    return renamed.select(*picked)
