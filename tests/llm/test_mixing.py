import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing


def targets(sizes):
    """Shares by weight, capped at three sizes, the excess dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: 3 * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= set(over)


def sainte_lague(shares, n):
    won = [0] * len(shares)
    for _ in range(n):
        k = max(range(len(shares)), key=lambda i: (shares[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_seats_are_the_highest_quotients(spark):
    shares = [0.2, 13.7, 55.5, 4.4, 0.0, 26.2]
    rows = [(i, s, 100) for i, s in enumerate(shares)]
    got = mixing.seats(spark.createDataFrame(rows, "_id long, share double, total long"), [], "share", "total", "won").orderBy("_id").collect()
    assert [r.won for r in got] == sainte_lague(shares, 100)


@pytest.mark.parametrize("blocks", [1 << 27, 50])
def test_mix(spark, blocks):
    rows = [(i, ("s%d" % (i % 7)) if i % 11 else None, "w " * (i * 7 % 40), "x") for i in range(600)]
    rows += [(7, "s0", "w w w", "x"), (7, "s0", "w w w", "x"), (None, "s1", "w", "x"), (8, "s1", None, "x"), (9, "empty", "", "x"), (900, "s0", "w " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, taken string")
    got = mixing.mix(docs, mixing.word_count(F.col("text")), blocks=blocks)
    assert got.columns.count("taken") == 1
    again = mixing.mix(docs.repartition(3), mixing.word_count(F.col("text")), blocks=blocks)
    key = lambda df: sorted(map(tuple, df.select(F.coalesce("doc_id", F.lit(-1)), "size", "taken").collect()))
    assert key(got) == key(again)
    sizes, taken, wanted = defaultdict(int), defaultdict(int), {}
    for r in got.collect():
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        wanted[r.source] = r.target
    truth = targets(sizes)
    block = max(1, -(-sum(sizes.values()) // blocks))
    for s in sizes:
        assert abs(truth[s] - wanted[s]) < 1e-6
        assert abs(taken[s] - truth[s]) <= 2 + (0 if blocks > 50 else 64 * block)
    assert mixing.mix(docs.limit(0), mixing.word_count(F.col("text"))).count() == 0


def test_names_of_other_columns_are_free(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 5), 1, "t", "s", "d", 9) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, target int, source_size string, _key string, doc string, _share int")
    got = mixing.mix(docs, mixing.word_count(F.col("text")))
    assert got.columns == ["doc_id", "source", "text", "_key", "doc", "_share", "size", "source_size", "target", "taken"]
    plain = mixing.mix(docs.select("doc_id", "source", "text"), mixing.word_count(F.col("text")))
    assert sorted((r.doc_id, r.taken) for r in got.collect()) == sorted((r.doc_id, r.taken) for r in plain.collect())
    assert {r._share for r in got.select("_share").distinct().collect()} == {9}


@pytest.mark.parametrize("shares,total", [([0.3] * 40, 12), ([1000.4, 0.1, 0.5, 0.5, 2.5], 1004), ([0.0, 0.0], 0), ([0.5] * 9 + [700.5], 705)])
def test_few_quotients_are_enough(spark, shares, total):
    rows = [(i, s, total) for i, s in enumerate(shares)]
    got = mixing.seats(spark.createDataFrame(rows, "_id long, share double, total long"), [], "share", "total", "won").orderBy("_id").collect()
    assert [r.won for r in got] == sainte_lague(shares, total)


def test_very_many_sources(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('s', id % 20000) AS source", "1 + id % 7 AS n")
    got = mixing.mix(docs, F.col("n"), shards=4)
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).agg(F.max(F.abs(F.col("taken") - F.col("target"))), F.count("*")).first()
    assert sums[0] <= 5 and sums[1] == 20_000


STOPPED = [2136, 1677, 2292, 212, 820, 5033, 1, 9166, 6356, 2414, 4228, 1065]


@pytest.mark.parametrize("seed", range(10))
def test_sources_at_their_stop_and_fractions_of_others(spark, seed):
    rng = random.Random(seed)
    sizes = STOPPED if seed == 0 else [rng.choice([0, 1, 7, rng.randint(1, 10_000)]) for _ in range(rng.randint(1, 14))]
    rows = []
    for k, total in enumerate(sizes):
        while total > 0:
            n = min(total, rng.choice([1, 50, 400]))
            rows.append((len(rows), f"s{k:02d}", n))
            total -= n
    docs = spark.createDataFrame([*rows, (-1, "s00", 0)], "doc_id long, source string, n int")
    got = mixing.mix(docs, F.col("n")).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken, sized, wanted = defaultdict(int), defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        sized[r.source] += r.size
        wanted[r.source] = r.target
    for source in sized:
        assert abs(taken[source] - wanted[source]) <= (0 if wanted[source] == 3 * sized[source] else 2)
    assert abs(sum(taken.values()) - sum(sized.values())) <= 1


def test_seats_of_a_thousand_random_tables(spark):
    """All tables at once, a group each: the seats of the free sources stay within a seat of a share that does not round."""
    rng = random.Random(3)
    rows, want = [], {}
    for table in range(1000):
        shares = [rng.choice([0.0, rng.random(), rng.random() * 40]) for _ in range(rng.randint(1, 9))]
        total = round(sum(shares))
        want[table] = sainte_lague(shares, total) if sum(shares) else [0] * len(shares)
        rows += [(table, i, s, total) for i, s in enumerate(shares)]
    got = mixing.seats(spark.createDataFrame(rows, "g int, _id long, share double, total long"), ["g"], "share", "total", "won").orderBy("g", "_id").collect()
    found = defaultdict(list)
    for r in got:
        found[r.g].append(r.won)
    assert dict(found) == want
