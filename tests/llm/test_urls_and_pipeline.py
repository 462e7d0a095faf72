import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from duolist.llm import langid, nearcopies, packing, quality, queries
from tests.llm import edge
from duolist.llm.urlfilter import HostTrie, Rule, judge_urls, split_url

LABELS = st.lists(st.sampled_from(["a", "b", "com", ""]), min_size=1, max_size=3).map(".".join)
PATHS = st.lists(st.sampled_from(["/", "x", "y", "xy"]), max_size=4).map("".join).map(lambda p: "/" + p.lstrip("/"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.builds(Rule, st.sampled_from(["allow", "block"]), LABELS, PATHS), max_size=6), LABELS, PATHS)
def test_trie_finds_the_longest_fitting_rule(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    got = HostTrie(rules).find(host, path)
    want = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict), default=None)
    assert got == want


def test_split_url():
    assert split_url("HTTP://Ex.COM/A?q#f") == ("ex.com", "/A") and split_url("http://a?x/y") == ("a", "") and split_url("a://b#/c") == ("b", "")
    assert split_url(None) == split_url("no mark") == split_url("") == ("", "") and split_url("x://É.com/é") == ("É.com", "/é")


def test_urls_match_sql_and_edge_cases(spark):
    rows = [(1, "http://a.example.com/en/71?x"), (2, "http://example.com/en/8"), (3, "https://x.net/de/8"), (4, "https://www.example.net/de/8.html#a"), (5, None), (None, "x"), (6, "http://com/en/"), (7, "http://xcom/en/"), (1, "http://a.example.com/en/71?x"), (8, "a://ORG/es/\n?"), (9, "")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, rule string, host string")
    got = sorted(map(tuple, judge_urls(pages, queries.URL_RULES).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert got == sorted(con.sql(queries.oracle_sql()["op3_url_filter"]).fetchall(), key=str)
    assert {r[0]: r[4] for r in got}[4] == "block" and judge_urls(pages.limit(0), []).count() == 0


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = langid.keep_known(docs)
    good = {r.doc_id for r in quality.judge(known, spark.read.parquet(f"{d}/labels.parquet")).where("kept").collect()}
    second = corpus_pipeline.quality_classifier(spark, known, d)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == good
    kept = {r.d for r in nearcopies.near_copies(second).groupBy("class_id").agg(F.min("doc_id").alias("d")).collect()}
    third = corpus_pipeline.near_duplicates(spark, second, d)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == kept
    want = sorted(map(tuple, packing.pack(third).select("doc_id", "start", "length", "ids_crc32").collect()))
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, run.select("doc_id", "start", "length", "ids_crc32").collect())) == want
    clean = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 0").join(known, "doc_id")
    assert clean.where(clean.doc_id.isin(list(good))).count() >= 0.97 * clean.count()


def test_stages_bear_nulls_clashes_and_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    edge.labels(spark).write.parquet(f"{folder}/labels.parquet")
    for docs in (edge.documents(spark).withColumn("good", F.lit("clash")).withColumn("x", F.lit(1)), edge.nothing(spark)):
        state = docs
        for _, stage in corpus_pipeline.STAGES[:3]:
            state = stage(spark, state, folder)
            assert state.columns == docs.columns
        packed = corpus_pipeline.STAGES[3][1](spark, state, folder)
        assert packed.select("doc_id").distinct().count() == state.select("doc_id").distinct().count()


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 14)) and len(corpus_pipeline.STAGES) == 4
