import hashlib
import math
import random

import numpy as np
import pytest

from tessella.llm import codes

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted({(i, tuple(v)) for i, v, _ in kept})[:entries]
    cut = lambda v, p: list(v[p * width : (p + 1) * width])
    book = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        seats = [[[] for _ in b] for b in book]
        for _, v, _ in kept:
            for p in range(parts):
                seats[p][nearest(v, p)[1]].append(cut(v, p))
        book = [[[sum(x) // len(own) for x in zip(*own, strict=True)] if own else book[p][k] for k, own in enumerate(seats[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        near = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in near)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in near), error, label))
    return sorted((i, code, error, by_label[label], digest) for i, code, error, label in out)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    made = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.5, dims)], int(rng.integers(3)) or None) for i in rng.permutation(n)]
    return [*made, (n, None, 1), (n + 1, [1.0] * (dims - 1) + [None], 1), (n + 2, [float("nan")] + [0.0] * (dims - 1), 1), (n + 3, [float("inf")] * dims, 1), (n + 4, [0.0] * dims, None), made[0]]


@pytest.mark.parametrize(("seed", "n", "dims"), [(1, 200, 64), (2, 40, 16), (3, 5, 8)])
def test_equals_the_plain_version(spark, seed, n, dims):
    rows = vectors(seed, n, dims)
    got = codes.compress(spark, codes.from_embeddings(spark.createDataFrame(rows, COLUMNS).repartition(3)))
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_empty_odd_and_extra_columns(spark):
    assert codes.compress(spark, codes.from_embeddings(spark.createDataFrame([], COLUMNS))).count() == 0
    rows = spark.createDataFrame([(1, [], 1, 2), (None, [0.5], None, 3), (3, [0.25, -0.5], 1, 4)], COLUMNS + ", code int")
    got = {r.vec_id: r for r in codes.compress(spark, codes.from_embeddings(rows)).collect()}
    assert {k: (r.code, r.error) for k, r in got.items()} == {1: ("00" * 8, 0), 3: ("01" + "01" + "00" * 6, 0), None: ("02" + "00" * 7, 0)}
    with pytest.raises(Exception, match="beyond 65536"):
        codes.compress(spark, codes.from_embeddings(spark.createDataFrame([(1, [1e9], 1)], COLUMNS))).count()


def test_block_sums_are_those_of_any_order():
    rng = np.random.default_rng(0)
    block, book = rng.integers(-9, 9, (16, 50)).astype(np.int32), rng.integers(-9, 9, (8, 4, 2))
    found, error = codes.assigned(block, book)
    shuffled = rng.permutation(50)
    again, error2 = codes.assigned(np.ascontiguousarray(block[:, shuffled]), book)
    assert (found[:, shuffled] == again).all() and (error[:, shuffled] == error2).all()
    random.seed(0)
    for _ in range(50):
        p, n = random.randrange(8), random.randrange(50)
        own = [((block[2 * p : 2 * p + 2, n] - e) ** 2).sum() for e in book[p]]
        assert found[p, n] == int(np.argmin(own)) and error[p, n] == min(own)
