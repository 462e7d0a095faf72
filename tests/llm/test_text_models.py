import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolist.llm import langid, lm, quality
from tests.llm import edge


def fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n


# language ID


def all_segmentations(word, prob, pieces):
    if not word:
        return 1.0
    return sum(prob[pieces[word[:i]]] * all_segmentations(word[i:], prob, pieces) for i in range(1, len(word) + 1) if word[:i] in pieces)


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces()


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    prob = rng.random((pieces.size + 1, 2)) * 1e-3
    prob[-1] = 0
    words = [b" there", b" caf\xc3\xa9", b" zqxjk", b" other"]
    got = langid.log_probabilities(words, prob, pieces)
    for w in words:
        assert np.exp(got[w]) == pytest.approx([all_segmentations(w, prob[:, k], pieces.ids) for k in range(2)])


def plain_forward(word, prob, ids):
    """Sums over all segmentations of a word of any length, in whole numbers of logarithms."""
    logs = [0.0]
    for j in range(1, len(word) + 1):
        terms = [logs[i] + math.log(prob[ids[word[i:j]]]) for i in range(max(0, j - 200), j) if word[i:j] in ids]
        top = max(terms)
        logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return logs[-1]


def test_long_words_are_segmented_as_a_whole(pieces, monkeypatch):
    rng = np.random.default_rng(2)
    prob = rng.random((pieces.size + 1, 2)) * 1e-6
    prob[-1] = 0
    words = [b" " + b"internationalization" * 40, (" " + "北京是中国的首都" * 60).encode(), b" " + b"qzx" * 300]
    want = {w: [plain_forward(w, prob[:, k], pieces.ids) for k in range(2)] for w in words}
    for segment in (1 << 16, 37):
        monkeypatch.setattr(langid, "_SEGMENT", segment)
        got = langid.log_probabilities(words, prob, pieces)
        for w in words:
            assert got[w] == pytest.approx(want[w], rel=1e-9)


def brute_learn(counts, ids, size, rounds):
    def segmentations(w):
        return [[]] if not w else [[w[:i], *rest] for i in range(1, len(w) + 1) if w[:i] in ids for rest in segmentations(w[i:])]

    expected = Counter()
    for w, n in counts.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in ids:
                    expected[ids[w[i:j]]] += n
    for k in range(rounds + 1):
        total = sum(expected[i] + langid.FLOOR for i in ids.values())
        prob = {i: (expected[i] + langid.FLOOR) / total for i in ids.values()}
        if k == rounds:
            return prob
        expected = Counter()
        for w, n in counts.items():
            ways = [(math.prod(prob[ids[p]] for p in s), s) for s in segmentations(w)]
            for q, s in ways:
                for p in s:
                    expected[ids[p]] += n * q / sum(x for x, _ in ways)


def test_learning_is_expectation_maximisation(pieces, monkeypatch):
    counts = {b" the": 50.0, b" there": 20.0, b" then": 10.0, b" zorg": 3.0, b" caf\xc3\xa9": 2.0}
    for segment in (1 << 16, 3):
        monkeypatch.setattr(langid, "_SEGMENT", segment)
        for rounds in (0, 1, 3):
            got, want = langid.learn(counts, pieces, rounds), brute_learn(counts, pieces.ids, pieces.size, rounds)
            assert got.sum() == pytest.approx(1) and all(got[i] == pytest.approx(p, rel=1e-9) for i, p in want.items())


def test_predictions_are_products_over_words(pieces, monkeypatch):
    languages = ["de", "en"]
    prob = np.stack([langid.learn({b" der": 9.0, b" und": 5.0, b" strasse": 1.0}, pieces), langid.learn({b" the": 9.0, b" and": 5.0, b" street": 1.0}, pieces)], axis=1)
    monkeypatch.setattr(langid, "REMEMBER_SIZE", 6)
    predictor = langid.Predictor(languages, prob)
    predictor.most = 3  # generations turn all the time
    rows = ["the street", "Und der Strasse", "½ ② ³", "x²y the", "", "12 _ ;", "the " * 50, "der" * 40, "and der"] * 2
    names, scores = predictor.predict(rows)
    for text, name, score in zip(rows, names, scores, strict=True):
        words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        if not words:
            assert (name, score) == ("und", 0.0)
            continue
        logs = [sum(plain_forward(b" " + w.encode(), prob[:, k], pieces.ids) for w in words) for k in range(2)]
        assert name == languages[int(logs[1] > logs[0])] and score == pytest.approx(1 / (1 + math.exp(-abs(logs[1] - logs[0]))))


def test_choice_of_documents_is_that_of_least_hashes(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id % 10 = 0, 'rare', 'common') as lang")
    got = {(r.lang, r.doc_id) for r in langid.choose(rows.unionAll(rows.limit(50)), 40).collect()}
    ranked = sorted(rows.withColumn("h", F.xxhash64("doc_id")).collect(), key=lambda r: r.h & (2**64 - 1))
    assert got == {(lang, r.doc_id) for lang in ("rare", "common") for r in [r for r in ranked if r.lang == lang][:40]}


def test_language_of_edge_cases(spark):
    got = {(r.doc_id, r.lang_pred): r for r in langid.language_of(edge.documents(spark)).collect()}
    rows = edge.rows()
    by_doc = {}
    for r in got.values():
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in (100, 101, 102, 202):
        assert by_doc[doc][0].lang_pred == "und" and by_doc[doc][0].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1) for r in got.values())
    assert {r.lang_pred for r in got.values()} <= {"en", "de", "und"} and by_doc[5][0].lang_pred == "en"
    assert langid.language_of(edge.documents(spark)).count() == len(rows)
    assert langid.language_of(edge.nothing(spark)).count() == 0
    unlabelled = langid.language_of(edge.documents(spark, [(1, "some words", None)])).collect()
    assert [r.lang_pred for r in unlabelled] == ["und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_und_goes(spark):
    docs = edge.documents(spark)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {100, 101, 102}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.where("doc_id < 20").count() == 21


# quality


def test_log_ratio():
    r = quality.log_ratio(np.array([9.0, 0.0, 0.0]), np.array([10.0, 8.0, 0.0]), 1.0)
    assert r[0] > 0 > r[1] and r[2] == 0 and not quality.log_ratio(np.zeros(2), np.zeros(2)).any()


def test_features_are_words_and_pairs():
    assert len(quality.features("a b, a b")) == 5 + 4 and len(quality.features("")) == 0
    f = quality.features("x y x y")
    assert f[0] == f[2] and f[4] == f[6]


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(0, 100, 800), 1).tolist() + [7.0] * 100 + [1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "s double").repartition(3)
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 50, 450, len(values)):
        assert quality.kth_largest(df, "s", k) == ordered[k - 1]


def test_judgement(spark):
    got = quality.judge(edge.documents(spark), edge.labels(spark)).collect()
    assert len(got) == len(edge.rows()) and {"doc_id", "log_weight", "score", "kept"} == set(got[0].asDict())
    by = {r.doc_id: r for r in got}
    assert by[100].log_weight == by[101].log_weight == 0 and by[5].kept and by[5].log_weight > by[203].log_weight
    assert len({(r.score, r.kept) for r in got if r.doc_id == 3}) == 1
    again = {r.doc_id: r.score for r in quality.judge(edge.documents(spark).repartition(3), edge.labels(spark)).collect() if r.doc_id is not None}
    assert all(again[d] == pytest.approx(by[d].score) for d in again)
    assert quality.judge(edge.nothing(spark), edge.labels(spark)).count() == 0
    assert all(r.kept for r in quality.judge(edge.documents(spark), edge.labels(spark, [])).collect())


def test_labelled_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")
    rest = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 2 = 1")
    got = quality.judge(docs, half).join(rest, "doc_id").collect()
    share = lambda q, t: np.mean([r.kept for r in got if (r.quality, r.toxic) == (q, t)])
    assert share(1, 0) > 0.95 and share(0, 0) < 0.2


# language model


def test_scores(spark):
    data = edge.rows()
    got = lm.score_documents(edge.documents(spark)).collect()
    counts = Counter()
    words = lambda t: [w for w in (t or "").encode().lower().split()] + ["END"]
    for doc, text, _ in data:
        if doc is not None and fold(doc, 10):
            counts.update(words(text))
    total, space = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = sorted(((doc, len(words(t)), sum(counts[w] > 0 for w in words(t)), round(sum(math.log10((counts[w] + 0.1) / space) for w in words(t)), 3)) for doc, t, _ in data), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got), key=str) == want
    assert {r.train_tokens for r in got} == {total} and all(r.held_out == (r.doc_id is not None and fold(r.doc_id, 10) == 0) for r in got)


def test_next_symbols_sum_to_one(spark):
    texts = spark.createDataFrame([(edge.text(i, 60),) for i in range(80)], "text string")
    tree, _ = lm.fit(texts)
    assert tree.kept.sum() > 1
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4):
        context = [lm.STOP, *rng.integers(2, tree.size, n)]
        total = sum(tree.root[x] * 10 ** tree.gains(np.array([*context, x]))[-1] for x in range(tree.size))
        assert total == pytest.approx(1, abs=1e-9)


def test_contexts_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm.score_documents(docs).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_scores_of_nothing(spark):
    assert lm.score_documents(edge.nothing(spark)).count() == 0
    alone = lm.score_documents(edge.documents(spark, [(None, "a b", None)])).first()
    assert alone.train_tokens == 0 and alone.n_known == 0 and alone.score == pytest.approx(alone.base_score)


def test_repeated_rows_lose_no_language(spark):
    """Each row of one language two thousand times: the same documents are chosen, and nothing else is predicted."""
    data = [(i, edge.text(i, 40), "en") for i in range(12)] + [(100 + i, "der die das und ist nicht ein " * (3 + i), "de") for i in range(12)]
    docs = edge.documents(spark, data).select("doc_id", "text", "lang")
    many = docs.where("lang = 'de'").withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("t").unionAll(docs.where("lang = 'en'"))
    assert sorted(map(tuple, langid.choose(many, 400).collect())) == sorted(map(tuple, langid.choose(docs, 400).collect())) == sorted((d, lang) for d, _, lang in data)
    once, often = ({(r.doc_id, r.lang_pred) for r in langid.language_of(x).collect()} for x in (docs, many))
    assert once == often and {lang for _, lang in once} == {"de", "en"}


def test_too_many_languages_are_refused(spark):
    rows = spark.range(langid.MOST_LANGUAGES + 1).selectExpr("id as doc_id", "'some words' as text", "cast(id as string) as lang")
    with pytest.raises(ValueError, match="values of lang"):
        langid.choose(rows, 10)
