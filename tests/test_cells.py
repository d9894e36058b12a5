import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import cells
from tessella.operators import retrieval as rt
from tessella.operators.cells import VectorIndex


def clustered(n=2000, width=16, seed=1):
    rng = np.random.default_rng(seed)
    tops = rng.normal(size=(25, width))
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in tops[rng.integers(25)] + 0.15 * rng.normal(size=width)]) for i in range(n)]
    odd = [(n, 0, None), (n + 1, 0, [0.0] * width), (n + 2, 1, [1.0] * 3), (n + 3, 1, []), (n + 4, 2, rows[0][2]), (n + 5, 2, [float("nan")] * width)]
    return rows + odd


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = spark.createDataFrame(clustered(), "chunk_id long, label int, embedding array<float>").repartition(3)
    return rows, VectorIndex.build(rows, str(tmp_path_factory.mktemp("cells")))


@pytest.mark.parametrize(("limit", "floor"), [(1, 0.2), (10, 0.2), (300, 0.2), (50, 0.9)])
def test_the_index_gives_what_a_scan_gives(spark, built, limit, floor):
    rows, index = built
    rng = random.Random(limit)
    for _ in range(3):
        asked = clustered()[rng.randrange(2000)][2]
        for narrow in (None, lambda df: df.where("label = 1")):
            got = index.near(asked, limit, floor, narrow=narrow, at_once=0)
            want = rt.vector_leg((narrow or (lambda df: df))(rows), asked, limit, floor, key="chunk_id")
            assert [(r.chunk_id, r.score) for r in got.orderBy(F.desc("score"), "chunk_id").collect()] == [(r.chunk_id, r.score) for r in want.collect()]
    assert rt.vector_leg(index, asked, limit, floor, key="chunk_id").count() == index.near(asked, limit, floor).count()


def test_bounds_hold_and_prune(built):
    rows, index = built
    told = rows.where("size(embedding) = 16").select("chunk_id", "embedding").collect()
    cell = {r.chunk_id: r.cell for r in index.vectors.select("chunk_id", "cell").collect()}
    assert len(cell) == len(clustered()) and {cell[i] for i in (2000, 2001, 2002, 2003, 2005)} == {-1}
    q = np.array(told[5].embedding)
    bound = dict(zip(index.cells.tolist(), index.bounds(q.tolist()), strict=True))
    for r in told:
        v = np.array(r.embedding)
        if cell[r.chunk_id] >= 0:
            assert v @ q / np.linalg.norm(v) / np.linalg.norm(q) <= bound[cell[r.chunk_id]] + 1e-9
    best = index.near(q.tolist(), 10, at_once=0).collect()
    needed = sum(n for c, n in zip(index.cells.tolist(), index.counts.tolist(), strict=True) if bound[c] >= best[-1].score)
    assert needed < 0.2 * len(told)  # one cluster of 25, not all


def test_the_store_is_sorted_so_that_cells_are_row_groups(built):
    _, index = built
    plan = index._best(np.arange(2), [1.0] * 16, 5, 0.2, "chunk_id", None)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [Or(EqualTo(cell" in plan


def test_few_odd_and_no_vectors(spark, tmp_path):
    some = spark.createDataFrame([(1, [1.0, 0.0], 9), (2, [0.0, 1.0], 9), (3, [1.0, 1.0], 9)], "chunk_id long, embedding array<double>, cos int")
    index = VectorIndex.build(some, f"{tmp_path}/a")
    assert [r.chunk_id for r in index.near([1.0, 0.1], 3).orderBy(F.desc("score")).collect()] == [1, 3]
    assert index.near([1.0], 3).count() == 0 and index.near([0.0, 0.0], 3).count() == 0
    assert index.near([1.0, 0.1], 3, probes=1).count() >= 1
    none = VectorIndex.build(some.limit(0), f"{tmp_path}/b")
    assert none.near([1.0, 0.1], 3).count() == 0


def test_the_sample_is_cut_before_one_task_orders_it(spark):
    vectors = spark.range(20_000).selectExpr("array(id, id * 7 % 13) AS embedding")
    low, hashed = cells._lowest(vectors, 20_000, 100, 7)
    assert 100 <= low.count() < 400
    whole = vectors.orderBy(hashed).limit(100).collect()
    assert low.orderBy(hashed).limit(100).collect() == whole
    assert cells._lowest(vectors, 150, 100, 7)[0] is vectors
