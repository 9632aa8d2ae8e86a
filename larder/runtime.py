"""Reading tables, cutting lineage into the shared folder, and joins whose broadcast side is measured first."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and has at most this many rows and estimated bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of ``folder``; with ``columns`` only those, so that the scan is pruned even before Catalyst."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, or a local one where it is unset in local mode.

    On a cluster a folder of one machine would lose tables with it, so an unset one is an error there."""
    context = spark.sparkContext
    found = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        if found is None:
            context.setCheckpointDir(named)
        return named
    if found is None and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    if found is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="larder-shared-"))
        found = context.getCheckpointDir()
    return found


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file to the shared folder; returns its full address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    for i in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[i : i + (1 << 20)]))
    stream.close()
    return fs.makeQualified(path).toString()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers: once a context, unless their path has it already."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    if context.applicationId in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (context.master.startswith("local[") and os.getcwd() == root):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for folder, _, files in sorted(os.walk(package)):
            for file in sorted(files):
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(write_shared(spark, f"larder-code-{uuid.uuid4().hex[:12]}.zip", buffer.getvalue()))
    _SHIPPED.add(context.applicationId)


class Scratch:
    """Tables written to the shared folder, each read back with its lineage cut.

    ``save`` writes parquet, so a lost executor loses nothing; ``drop`` removes what a later round no longer needs."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/larder-{label}-{uuid.uuid4().hex[:12]}"
        self._made: list[str] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._made.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def small_broadcast(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows keep within the bounds, else unchanged for a shuffle join with adaptive skew splitting."""
    limit = min(BROADCAST_ROWS, BROADCAST_BYTES // max(1, row_bytes))
    return F.broadcast(df) if bounded(df, limit) else df


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join for a skewed ``left`` against a ``right`` with one row per key.

    Rows of ``left`` get a salt from a hash of the whole row and ``right`` is repeated once per salt, so a key with a third of
    the rows is read by ``salts`` tasks. ``how`` is ``inner`` or ``left``."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if "map" not in dict(left.dtypes)[c]]), F.lit(salts)).cast("int")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt).join(many, [*keys, "_salt"], how).drop("_salt")


def blank_trim(col: Column) -> Column:
    """Without white space, no-break and zero-width blanks at both ends."""
    blank = r"[\s\u00a0\u1680\u2000-\u200f\u202f\u2060\u3000\ufeff]"
    return F.regexp_replace(col, f"^{blank}+|{blank}+$", "")
