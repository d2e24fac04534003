"""What the operators share on the DataFrame side."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_written: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns that an operator is about to add itself."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write df as Parquet; its shuffle files go as soon as it is written, as
    nothing else reads them."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.option("compression", compression) if compression else df.write).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there."""
    path = shared_dir(df.sparkSession)
    write(df, path, compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def removed(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for frame in frames:
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete every table that the operators wrote in this application.

    A result is lazy and reads some of them: save it first.
    """
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)
