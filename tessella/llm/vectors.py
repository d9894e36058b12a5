"""Distinct vectors with their smallest ids: equal vectors are searched once.

A group of equal vectors ties everywhere, and only its k + 1 smallest ids can
reach a list of k (one of them may be the query's own).  So both searches run
over distinct vectors; a hot vector costs no more than any other, and nothing
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch


def usable(v: Column) -> Column:
    """Not null, without null, NaN or infinite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def distinct_vectors(scratch: Scratch, rows: DataFrame, k: int) -> DataFrame:
    """rid, width, vec, ids (the k + 1 smallest, ascending), asked (some row of it is a query), as a stored table.

    rows: vec_id, vec, query (boolean).  Repeated rows of one id count once.
    """
    by = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.select("vec", "vec_id").distinct().withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k + 1)
    asked = rows.where("query").select(F.col("vec").alias("_v")).distinct().withColumn("_asked", F.lit(True))
    grouped = (
        few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .join(asked, F.col("vec") == F.col("_v"), "left")
        .select(F.size("vec").alias("width"), "vec", "ids", F.coalesce("_asked", F.lit(False)).alias("asked"))
    )
    return scratch.write(grouped.select(F.monotonically_increasing_id().alias("rid"), "*"), "distinct")


def blocks(rows: DataFrame, by: list[str], payload: list[str], most: int) -> DataFrame:
    """Groups of rows of equal by, at most so many to a row: the payload columns become lists.

    Groups must be of bounded size (callers salt them); a group over most gives several rows.
    """
    fields = [rows.schema[c] for c in by] + [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in payload]
    out = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n = [], None, 0

        def one() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cells = [t.column(c).slice(0, 1).combine_chunks() for c in by]
            lists = []
            for c in payload:
                flat = t.column(c).combine_chunks()
                flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
            cells = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cells]
            return pa.RecordBatch.from_arrays([*cells, *lists], names=out.names)

        for b in batches:
            keys = list(zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in by], strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and end - at + (n if keys[at] == key else 0) < most:
                    end += 1
                if key is not None and (keys[at] != key or n >= most):
                    yield one()
                    held, n = [], 0
                    key = None
                    continue
                key = keys[at]
                held.append(b.slice(at, end - at))
                n += end - at
                at = end
        if held:
            yield one()

    return rows.select(*by, *payload).sortWithinPartitions(*by).mapInArrow(run, out)
