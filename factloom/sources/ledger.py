"""Batches that are written exactly once: several tables of one micro-batch, and scans that go on where they ended.

A batch's rows go to a folder of its number in each table, which a replay writes anew; when all tables are written, the
batch's mark is set, in one step, and readers only see marked batches. So whatever dies in between, all tables have
a batch or none has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.store import absent


class Ledger:
    """The numbers of complete batches under a folder; a mark may hold a line of text."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def marks(self) -> list[str]:
        where = self._path(f"{self.folder}/_ledger")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def done(self) -> dict[int, str]:
        """Numbers of complete batches, with their marks' texts."""
        parts = (m.split("~", 1) for m in self.marks() if not m.startswith("."))
        return {int(n): self.spark._jvm.java.net.URLDecoder.decode(text, "UTF-8") for n, text in sorted(parts)}

    def mark(self, batch: int, text: str = "") -> None:
        # the mark is its name alone, so there is no half of one
        name = self.spark._jvm.java.net.URLEncoder.encode(text, "UTF-8")
        self._fs.create(self._path(f"{self.folder}/_ledger/{batch:012}~{name}"), False).close()


def committed(spark: SparkSession, folder: str, table: str, schema: str | None = None) -> DataFrame | None:
    """All rows of a table's complete batches, with batch; None before the first (an empty table, if a schema is given)."""
    paths = [f"{folder}/{table}/batch={n}" for n in Ledger(spark, folder).done()]
    if paths:
        return spark.read.option("basePath", f"{folder}/{table}").parquet(*paths)
    return spark.createDataFrame([], f"{schema}, batch int") if schema else None


def write_batch(batch: DataFrame, number: int, folder: str, sinks: dict[str, Callable[[DataFrame], DataFrame]], keys: dict[str, list[str]] | None = None) -> bool:
    """Write what each sink makes of a micro-batch (for foreachBatch); False if it has been done before.

    Of tables with keys only rows whose key no complete batch has are written. The batch is computed once for all sinks.
    """
    spark, ledger = batch.sparkSession, Ledger(batch.sparkSession, folder)
    if number in ledger.done():
        return False
    batch.persist()
    try:
        for name, make in sinks.items():
            rows, key = make(batch), (keys or {}).get(name)
            if key:
                stored = committed(spark, folder, name)
                rows = absent(rows, (rows.limit(0) if stored is None else stored).select(*key), key)
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    finally:
        batch.unpersist()
    ledger.mark(number)
    return True


def keyset_scan(rows: DataFrame, key: str, folder: str, make: Callable[[DataFrame], DataFrame], chunk: int, most: int | None = None) -> int:
    """Write make(rows) to the table `rows` under folder, `chunk` rows of rising key at a time; the number of chunks written.

    rows is a file table with a unique key that isn't null; a chunk is a range of keys, and the files' statistics leave out
    what lies beside it where files are in order of the key. The last key is each chunk's mark, so a scan that was stopped
    (or had `most` chunks) goes on behind it, and one whose chunk died writes that again. Finding a range reads the keys alone.
    """
    spark, ledger, n = rows.sparkSession, Ledger(rows.sparkSession, folder), 0
    kind = rows.schema[key].dataType.simpleString()
    while most is None or n < most:
        done = ledger.done()
        number = len(done)
        rest = rows if not done else rows.filter(F.col(key) > F.lit(done[number - 1]).cast(kind))
        last = rest.select(key).orderBy(key).limit(chunk).agg(F.max(key).cast("string")).head()[0]
        if last is None:
            return n
        make(rest.filter(F.col(key) <= F.lit(last).cast(kind))).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        ledger.mark(number, last)
        n += 1
    return n
