"""Stored intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that a checked broadcast may have; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
            own = spark.sparkContext.getCheckpointDir()
        return own
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: The folders that the calls inside of ``Scratch.passing`` have made, in this thread.
_PASSING: ContextVar[list[Scratch] | None] = ContextVar("passing", default=None)


class Scratch:
    """Tables of intermediate results as Parquet in the shared folder.

    A written table cuts the lineage and survives lost executors.  ``drop``
    deletes one that no later step reads; the rest goes at the end of
    ``passing``, or when the driver ends.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.tables = spark, []
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        Scratch.made.append(self)
        if (mine := _PASSING.get()) is not None:
            mine.append(self)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int, *parts: str) -> DataFrame:
        """df stored in buckets by key (and in folders by parts): joins and groups on key leave its rows where they are."""
        table = f"tessella_{uuid.uuid4().hex}"
        to = df.write.option("compression", "zstd").option("path", f"{self.root}/{name}").bucketBy(buckets, key)
        (to.partitionBy(*parts) if parts else to).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def drop_all(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                for table in self.tables:
                    self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self._delete(self.root)
        except Exception:  # the JVM may be gone when the driver ends
            pass

    @staticmethod
    @contextmanager
    def passing() -> Iterator[None]:
        """What is made inside, by this thread, is dropped at the end: no one reads it any more.  Other threads' tables stay."""
        mine: list[Scratch] = []
        before = _PASSING.set(mine)
        try:
            yield
        finally:
            _PASSING.reset(before)
            for scratch in mine:
                scratch.drop_all()
                Scratch.made.remove(scratch)

    @staticmethod
    def drop_rest() -> None:
        while Scratch.made:
            Scratch.made.pop().drop_all()


atexit.register(Scratch.drop_rest)


def local(df: DataFrame) -> DataFrame:
    """df as a local table, run once.  Only for what a limit has made small."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most limit bytes, else as it is (the join then shuffles).

    Give it a stored table or a cheap plan: it runs once for the measure.
    """
    kinds = [f.dataType.typeName() for f in df.schema.fields]
    varying = [F.octet_length(c) for c, k in zip(df.columns, kinds, strict=True) if k in ("string", "binary")]
    size = F.lit(8 * (len(kinds) + 1))
    for v in varying:
        size = size + F.coalesce(v, F.lit(0))
    rows = limit // (8 * (len(kinds) + 1)) + 1  # more than these are too many in any case
    return F.broadcast(df) if (df.limit(rows).agg(F.sum(size)).first()[0] or 0) <= limit else df
