import os

import duckdb
import pytest

import __spark_entry__ as contract
from duolist.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Slow ones, or without SQL, have tests of their own.
CHOSEN = ["split_summary", "missing_report", "user_split_statistics", "warm_catalog", "pair_features", "similarity_bands", "pair_metrics", "method_summary", "item_neighbours", "group_linear", "group_nash", "propagate_mean", "cold_start_scores", "embedding_scores", "embedding_topk", "event_scores", "ranking_loss", "graph_size", "isolated_movies", "first_unliked", "focus_ratings", "conflict_bands", "conflict_summary", "dissimilar_pairs", "cold_start_list"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    a, b = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(object) for x in (a, b))
    assert a.where(a.notna(), None).equals(b.where(b.notna(), None)) or (a.fillna("-") == b.fillna("-")).all().all()


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
