"""Session helpers and the shared folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vernissage")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.maxResultSize", "1g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, taken from spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vernissage-"))
    return sc.getCheckpointDir()


_WRITTEN: list[str] = []
_STEPS = threading.local()  # of_builds: what each `land_once` under way in this thread has landed


def fresh_path(spark: SparkSession, label: str) -> str:
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


def all_partitions(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning into the session's shuffle partitions, kept even when the rows are few.

    For rows that are small to move but heavy to work on (n-grams, model fits).
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def land(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    landed = df.sparkSession.read.schema(df.schema).parquet(path)
    landed._landed_path = path
    if steps := getattr(_STEPS, "of_builds", None):
        steps[-1].append(landed)
    return landed


def unland(df: DataFrame) -> None:
    """Removes the files of a table that `land` gave and that nothing reads any more."""
    path = df._landed_path
    _delete(df.sparkSession, path)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_LANDED: dict[tuple, str] = {}


def inputs_of(*tables: DataFrame) -> str:
    """Digest of the files behind tables that were read from files, with their sizes and times of change."""
    digest = hashlib.sha256()
    files = [
        df.select(F.lit(i).alias("at"), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        for i, df in enumerate(tables)
    ]
    if files:
        for row in reduce(DataFrame.unionAll, files).orderBy("at", "file_path").toLocalIterator():
            digest.update(repr(tuple(row)).encode())
    return digest.hexdigest()


def land_once(spark: SparkSession, name: tuple, build: Callable[[], DataFrame], *inputs: DataFrame) -> DataFrame:
    """Table written once per application and read by every later step that names it.

    `inputs` are the tables it is built from; when their files change, it is built anew.
    What `build` lands on the way is removed when the table is written.
    """
    name = (spark.sparkContext.applicationId, *name, inputs_of(*inputs))
    if name in _LANDED:
        try:
            return spark.read.parquet(_LANDED[name])
        except AnalysisException:  # the folder was cleaned up
            del _LANDED[name]
    path = fresh_path(spark, str(name[1]))
    _STEPS.of_builds = [*getattr(_STEPS, "of_builds", []), []]
    try:
        build().write.parquet(path)
    finally:
        for step in _STEPS.of_builds.pop():
            unland(step)
    _LANDED[name] = path
    return spark.read.parquet(path)


@contextmanager
def landing_scope(spark: SparkSession) -> Iterator[None]:
    """What is landed inside the block is removed at its end, so read results before that."""
    held = list(_WRITTEN)
    _WRITTEN.clear()
    try:
        yield
    finally:
        for path in _WRITTEN:
            _delete(spark, path)
        gone = set(_WRITTEN)
        for name in [n for n, path in _LANDED.items() if path in gone]:
            del _LANDED[name]
        _WRITTEN[:] = held
