import numpy as np
import pytest

from tessella.llm import exact_topk, forest, placement


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=12) * 0.2]) for i in range(600)]
    hot = rows[50][1]
    rows += [(1000 + i, hot) for i in range(150)]  # a vector with many copies
    rows += [(2000, None), (2001, [float("nan")] * 12), (2002, [None] * 12), (2003, [0.0] * 12), (2050, [1.0, 2.0]), (2051, [2.0, 1.0]), (None, hot), (3, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows


def valid(rows):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            out[i] = v
    return out


def test_exact_topk_equals_brute_force(spark, table):
    df, rows = table
    ints = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in valid(rows).items()}
    want = set()
    for q in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:5], 1)}
    for block, cells in ((64, 16), (4096, 2)):
        got = exact_topk.search(spark, exact_topk.from_embeddings(df), block=block, cells=cells)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want
    assert exact_topk.search(spark, exact_topk.from_embeddings(df.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_forest_recall_and_order(spark, table, monkeypatch, limit):
    monkeypatch.setattr(forest, "BROADCAST_BYTES", limit)  # the queries' vectors are broadcast, or travel
    monkeypatch.setattr(forest, "HELD", 100)
    df, rows = table
    vecs = {i: np.array(v, np.float64) for i, v in valid(rows).items() if any(v)}
    got = forest.search(spark, forest.from_embeddings(df), s=forest.Settings(sample=200, leaf=16, block=64)).collect()
    hits = total = 0
    for q in vecs:
        if q % 50:
            continue
        near = sorted((-float(v @ vecs[q] / np.linalg.norm(v) / np.linalg.norm(vecs[q])), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, min(5, len(near)) + 1))
        keys = [(-s, i) for _, i, s in mine]
        assert keys == sorted(keys)
        for _, i, s in mine:
            assert abs(s - vecs[i] @ vecs[q] / np.linalg.norm(vecs[i]) / np.linalg.norm(vecs[q])) < 1e-12
        kth = -near[min(5, len(near)) - 1][0] - 1e-12
        hits += sum(s >= kth for _, _, s in mine)
        total += min(5, len(near))
    assert hits >= 0.9 * total
    top = sorted((r.rank, r.vec_id) for r in got if r.query_id == 1100)
    assert [i for _, i in top] == [50, 1000, 1001, 1002, 1003]
    assert forest.search(spark, forest.from_embeddings(df.limit(0))).count() == 0


def test_lookup_table_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(10))
    table = placement.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1 and len(table) == 1009
    fewer = placement.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.3 * 1009
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            placement.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        placement.lookup_table(("a",), 8)


def test_place(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z"), (77, "x")], "doc_id long, shard string")
    got = placement.place(spark, df, "doc_id").collect()
    assert len(got) == 4 and {r.shard for r in got} <= set(placement.SHARDS)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert placement.place(spark, df.limit(0), "doc_id").count() == 0
