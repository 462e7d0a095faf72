import pytest

from duolist.operators import cohorts
from duolist.sources import buckets


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_joins_and_groupings_by_the_bucket_key_are_not_shuffled(spark, no_broadcast):
    ratings = spark.range(3000).selectExpr("cast(id % 97 as int) as userId", "cast(id % 31 as int) as movieId", "cast(id % 5 as double) as rating", "if(id % 2 = 0, 'train', 'test') as split", "id % 3 = 0 as is_positive")
    users = spark.range(50).selectExpr("cast(id as int) as userId")
    a, b = buckets.bucketed_table(ratings, "userId", "split", 4), buckets.bucketed_table(users, "userId", "users", 4)
    plain, bare = cohorts.seen_items(ratings, users), cohorts.seen_items(a, b)
    assert exchanges(bare) == 0 < exchanges(plain)
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, plain.collect()))
    stats, bare = cohorts.user_split_statistics(ratings), cohorts.user_split_statistics(a)
    assert exchanges(bare) == 0 and sorted(map(tuple, bare.collect())) == sorted(map(tuple, stats.collect()))
    edges, bare = cohorts.training_edges(ratings, users), cohorts.training_edges(a, b)
    assert exchanges(bare) == 0 and sorted(map(tuple, bare.collect())) == sorted(map(tuple, edges.collect()))
    buckets.drop_bucketed(spark, a)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("split_")]


def test_bucket_counts():
    assert [buckets.bucket_count(n, 10) for n in (0, 1, 10, 11, 40, 41, 1000)] == [1, 1, 1, 2, 4, 8, 128]
