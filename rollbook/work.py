"""Session-level helpers: table loading, the shared work folder, written cuts of the lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the one named in ``spark.checkpoint.dir``. Only where that is unset and the session runs
    in one process (tests, bench) is a temporary folder made; on a cluster the setting is required.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="rollbook-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = f"file://{folder}"
    return _LOCAL[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of an older cut that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Give executors that lack this package on their path a copy of it, once per session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="rollbook-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/rollbook_package", "zip", here.parent, here.name))


#: A key with more than this share of all rows is hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """Join ``left`` with ``right``, unique on ``key``, where a few keys may hold much of ``left``.

    ``counts`` has (key, n): the rows of ``left`` by key. Rows of hot keys join a broadcast part of
    ``right``, which has at most 1 / HOT_SHARE = 1,000 rows whatever the data; all others are shuffled.
    """
    hot = counts.where(F.col("n") > max(1.0, total * HOT_SHARE)).select(key)
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    many = flagged.where("_hot").drop("_hot").join(F.broadcast(hot_right), key, how)
    rest = flagged.where("_hot is null").drop("_hot").join(right, key, how)
    return many.unionByName(rest)


#: Rows up to which a written table is sent to all executors.
SMALL = 100_000


def look_up(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a written table whose rows are counted: broadcast up to ``SMALL`` rows, else shuffled."""
    return left.join(F.broadcast(right) if right.count() <= SMALL else right, key, how)


def hashed(right: DataFrame) -> DataFrame:
    """``right``, unique on the keys it is joined by, to be hashed in each partition: neither side needs sorting, and no
    partition of unique keys is large."""
    return right.hint("shuffle_hash")


def blank(c: Column) -> Column:
    """Null, or nothing but white space of any kind."""
    return c.isNull() | (F.regexp_replace(c, r"(?U)[\s\u200b\ufeff]+", "") == "")
