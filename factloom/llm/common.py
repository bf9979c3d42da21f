"""Reading tables and writing intermediate ones to the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs in one process, a new local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and reread: cuts lineage, and several readers share one computation."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


#: Tables of the blocks of `scratch` that are open.
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[..., None]]:
    """Deletes the tables that are written in its block when that ends, but for those the yielded function is given."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(mine)
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        _scopes.pop()
        stay = {df.written_at for df in kept}
        deleted(*(df for df in mine if df.written_at not in stay))
        if _scopes:  # a block around this one may still let them go
            _scopes[-1].extend(df for df in mine if df.written_at in stay)


def deleted(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
