"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

The mix is cut into blocks of equally many words.  A source that its repeats
stop takes all its documents that often; the other sources take the blocks that
are left one after another by the highest quotients ``weight / (2 k + 1)``, and
each source's blocks go to its shards by the same rule, so every shard has an integer quota.
Inside a shard the documents stand in a seeded order and the quota takes the
first blocks of that stream.

Only quotients that can decide anything are made: with S claimants, rounding
every share misses the total by at most S / 2 seats, so shares moved by a factor
of 1 +- (S / 2 + 1) / total enclose the outcome.  A claimant's quotients between
the two number its share of S and a few more, so all of them number about 6 S.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: The mix has at most about so many blocks; below that a block is one word.
BLOCKS = 1 << 27
#: A source takes each of its documents at most so often.
REPEATS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Each source is cut into so many shards, which are taken from side by side.
SHARDS = 64
#: Documents of a shard, about, in sources of more than SHARDS times as many; these have more shards.
SHARD_ROWS = 1_000_000
SEED = "mix-1"
#: The columns that mixing makes.
NEW = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seats(claims: DataFrame, group: list[str], share: str, seats_of: str, out: str) -> DataFrame:
    """claims with the seats that Sainte-Laguë's highest quotients give.

    claims has, per claimant, its integer _id (unique in its group), its share
    (double, in seats) and, the same over its group, the integer seats_of to
    deal out; the shares of a group add up to about seats_of.  Ties go to the
    smaller _id.  Groups of zero seats give 0.
    """
    g = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    near = (F.count(F.lit(1)).over(g) / 2 + 1) / F.greatest(F.sum(share).over(g), F.lit(1e-300))
    reach = F.least(F.ceil(F.col(share) * near), F.ceil(F.count(F.lit(1)).over(g) / 2)) + 2
    base = (
        claims.withColumn("_low", F.greatest(F.lit(0), F.floor(share) - reach).cast("long"))
        .withColumn("_high", (F.floor(share) + reach).cast("long"))
        .withColumn("_sure", F.sum("_low").over(g))
    )
    ranked = (
        base.withColumn("_k", F.explode(F.sequence("_low", "_high")))
        .withColumn("_quotient", F.col(share) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(g.orderBy(F.desc("_quotient"), "_id")))
        .withColumn("_won", (F.col("_rank") <= F.col(seats_of) - F.col("_sure")) & (F.col("_quotient") > 0))
    )
    keep = [F.first(c).alias(c) for c in claims.columns if c not in {*group, "_id"}]
    return (
        ranked.groupBy(*group, "_id").agg(*keep, (F.first("_low") + F.sum(F.col("_won").cast("long"))).alias(out))
    )


def targets(sources: DataFrame, weights: tuple[float, ...], repeats: float) -> DataFrame:
    """Per source its target words: shares by weight, stopped at repeats times the source's size.

    sources: _none (the null source), _source, source_size.  The excess goes to the others by weight until
    none is above; with claims sorted by cap / weight that is the first prefix
    after which the common level lies under every later cap.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy("_none", "_source")
    ws = F.array(*[F.lit(float(w)) for w in weights])
    base = (
        sources.withColumn("weight", F.element_at(ws, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * float(repeats))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    by = one.orderBy("_ratio", "_none", "_source")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(one).cast("double")
    level = (whole - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    # the first source that its level does not fill sets the level; later ones would be lower
    found = base.withColumn("_level", level).withColumn("_at", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
    return found.withColumn(
        "target", F.least(F.col("_cap"), F.coalesce(F.max("_at").over(one), F.lit(float("inf"))) * F.col("weight"))
    ).drop("_cap", "_ratio", "_level", "_at")


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = REPEATS,
    shards: int | None = None,
    blocks: int = BLOCKS,
    seed: str = SEED,
) -> DataFrame:
    """docs with size, source_size, target and taken (words of it that the mix takes, repeats counted).

    docs needs doc_id and source (and what size is made of, so no text if that
    is a column); its other columns stay, those named like the four new ones are
    replaced, and all names are free.  No document is taken more than repeats
    times its size.  A null source is a
    source of its own, the last.  A target of r sizes takes every document
    floor(r) times, and the rest by quota: per (source, shard) whole blocks in
    the order of md5(seed, doc_id); equal ids stand in the order of their sizes.
    At most the last document of a shard's quota is taken in part.  Null texts
    and empty ones have size 0 and are not taken, however long others are;
    repeated rows count each; empty tables give no rows; if all sizes are 0,
    every target and every taken is 0.  The largest group a task sorts is a
    shard: 64 a source, or as many as the largest source has millions of
    documents (or shards); the sources and shards themselves are tables of at
    most sources x shards rows.
    """
    if shards is None:
        largest = docs.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        shards = max(SHARDS, -(-largest // SHARD_ROWS))
    order_key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    base = docs.select(
        F.struct("*").alias("doc"), size.alias("size"), order_key.alias("_key"), F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none")
    ).withColumn("_shard", F.conv(F.substring("_key", 1, 4 if shards <= 1024 else 8), 16, 10).cast("long") % shards)
    names = ["_source", "_none"]
    by_shard = base.groupBy(*names, "_shard").agg(F.sum("size").alias("_words"))
    by_source = by_shard.groupBy(*names).agg(F.sum("_words").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    plan = (
        targets(by_source, weights, repeats)
        .withColumn("_block", F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(one) / F.lit(blocks))).cast("long"))
        .withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        # sources at their stop get exactly that; the others compete for the blocks that are left
        .withColumn("_share", F.when(F.col("_full") >= repeats, 0.0).otherwise(F.col("target") / F.col("_block")))
        .withColumn("_seats", F.round(F.sum("_share").over(one)).cast("long"))
        .withColumn("_id", F.row_number().over(one.orderBy("_none", "_source")))
    )
    won = seats(plan, [], "_share", "_seats", "_blocks")
    # what full repeats leave of a source's blocks, in blocks
    left = F.greatest(F.lit(0), F.round(F.col("_blocks") - F.col("_full") * F.col("source_size") / F.col("_block"))).cast("long")
    quota = (
        won.withColumn("_rest", left)
        .join(by_shard, names)
        .withColumn("_part", F.when(F.col("source_size") > 0, F.col("_rest") * F.col("_words") / F.col("source_size")).otherwise(0.0))
        .withColumn("_id", F.col("_shard"))
    )
    dealt = seats(quota, names, "_part", "_rest", "_quota").select(
        *names, F.col("_id").alias("_shard"), "source_size", "target", "_full", (F.col("_quota") * F.col("_block")).alias("_take")
    )
    stream = Window.partitionBy(*names, "_shard").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_take") - F.col("_before")))
    found = base.withColumn("_before", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(dealt, [*names, "_shard"])
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in NEW]
    return found.select(*kept, "size", "source_size", "target", taken.alias("taken"))
