import os

import pytest

import __spark_entry__ as entry
from tessella.engine import Engine

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@here
def test_flagship(spark):
    assert entry.entry(spark).columns == ["chunk_id", "item_id", "score", "terms"]


@here
def test_engine(spark):
    e = Engine.over_tables(spark, SF)
    hits = e.search("der nicht und", "2024-02-01").collect()
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1)) and hits
    assert e.search("theand", "2024-02-01", mode="exact").count() <= 10
    with pytest.raises(ValueError):
        e.search("x", "2024-02-01", mode="guess")
    assert e.decisions(limit=5).count() <= 5 and e.actions(overdue_on="2024-02-01").count() > 0
    assert e.list_items("src3/", public_only=True).count() > 0 and e.outline(1).count() == 6
    assert e.event_groups().count() > 0 and e.export().count() > 0


@here
@pytest.mark.parametrize("name", ["a1_event_folding", "j14_subtree", "i2_i3_hash_upsert", "t1_event_stream_folding", "c9_c17_chunk_dispatch"])
def test_some_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
