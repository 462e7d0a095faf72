"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k sampling of their ratio.

Both models are bags of hashed words and word pairs. The target model is counted over a bounded sample of labelled documents, those
of good quality that aren't toxic; the raw model over all documents there are. A document's weight is the ratio of its
probabilities under the two; documents are drawn without replacement in proportion to their weights, by the top k of log weight
plus Gumbel noise.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from duolist.llm.common import Batches, fresh, materialise, record, texts
from duolist.llm.tokens import forget

BUCKETS = 1 << 16
#: Labelled documents that the target model is counted over, those with the least hash of doc_id.
FIT_DOCS = 20_000
#: Strength with which a bucket's ratio is drawn to 1, in n-grams of the target: the raw model also counts what no label knows.
SHRINK = 2000.0
#: Odds of a document being of the target from which on it counts towards the number drawn.
LEAST_ODDS = 0.25
SEED = 7
#: Words whose hashes a worker remembers, and their characters at most.
REMEMBER, REMEMBER_SIZE = 200_000, 64
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_known: dict[str, int] = {}


def features(text: str) -> np.ndarray:
    """Buckets of all words and pairs of neighbouring words of a text, repeats included."""
    tokens = _TOKENS.findall(text.lower())
    if len(_known) > REMEMBER:
        _known.clear()
    long = {}
    for t in set(tokens).difference(_known):
        (_known if len(t) <= REMEMBER_SIZE else long)[t] = zlib.crc32(t.encode())
    one = np.fromiter(map(_known.__getitem__, tokens) if not long else (long[t] if t in long else _known[t] for t in tokens), np.uint64, len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.concatenate([one, two]).astype(np.int64) & (BUCKETS - 1)


def log_ratio(target: np.ndarray, raw: np.ndarray, shrink: float = SHRINK) -> np.ndarray:
    """Log of target probability over raw probability for each bucket, from counts; 0 where nothing was seen."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(target))
    share = target.sum() / raw.sum()
    return np.log((target + shrink) / (raw * share + shrink))


def _counted(rows: DataFrame) -> tuple[np.ndarray, int]:
    """(n-grams by bucket, documents) of a table whose first column is text. A row per bucket and task at most is shuffled."""

    def count(batches: Batches) -> Batches:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                total += np.bincount(features(text), minlength=BUCKETS)
                n += 1
        at = np.flatnonzero(total)
        yield record(bucket=np.r_[at, -1], n=np.r_[total[at], n])

    sums = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS + 1 rows
    out = np.zeros(BUCKETS + 1)
    out[sums["bucket"]] = sums["n"]
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, float]:
    """(log ratio by bucket, log odds of a labelled document being of the target). docs: doc_id, text; labels: doc_id, quality, toxic.

    Of labels that name a document twice the least quality and the greatest toxicity count. Only the named columns are looked at,
    whatever others are called. Nothing labelled: all ratios are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    by_doc = named.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("good")).where("good is not null")
    there = rows.select("doc_id").distinct().join(by_doc, "doc_id")
    chosen = materialise(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs), "labelled")  # the bound of the fit
    n_good, n = chosen.agg(F.count_if("good"), F.count(F.lit(1))).first()
    # at most fit_docs ids
    target, _ = _counted(rows.join(F.broadcast(chosen.where("good").select("doc_id")), "doc_id", "left_semi").select("text"))
    raw, _ = _counted(rows.select("text"))
    return log_ratio(target, raw), math.log((n_good + 1) / (n - n_good + 1))


def weigh(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", weight_as: str = "log_weight") -> DataFrame:
    """docs with the log importance weight of each whole text added; all columns stay. A null or empty text has weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number a bucket
    at = docs.columns.index(text_col)

    def run(batches: Batches) -> Batches:
        forget()
        by_bucket = shared.value
        for batch in batches:
            weights = [float(by_bucket[features(t)].sum()) for t in texts(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weights, pa.float64())], names=[*batch.schema.names, weight_as])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(weight_as, DoubleType())]))


def gumbel(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, score: str, k: int) -> float:
    """The k-th largest score (1: the largest). Each pass cuts the span of scores where it lies into 4096 parts and counts."""
    low, high = rows.agg(F.min(score), F.max(score)).first()
    for _ in range(6):
        if not high > low:
            break
        step = (high - low) / 4096
        part = F.least(F.greatest(F.floor((F.col(score) - F.lit(low)) / F.lit(step)), F.lit(0)), F.lit(4095))
        inside = rows.where((F.col(score) >= F.lit(low)) & (F.col(score) <= F.lit(high)))
        found = sorted(inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).collect(), key=lambda r: -r.p)
        for r in found:
            if k <= r.n:
                low, high = r.lo, r.hi
                break
            k -= r.n
    return low


def resample(weighted: DataFrame, odds: float, weight: str = "log_weight", score_as: str = "score", kept_as: str = "kept", id_col: str = "doc_id", seed: int = SEED, least_odds: float = LEAST_ODDS) -> DataFrame:
    """Adds the Gumbel score and whether a row is drawn.

    k is the number of rows whose weight times the prior odds of the target is at least least_odds; the k rows with the greatest
    sum of log weight and Gumbel noise are drawn, and what ties with the last of them.
    """
    scored = materialise(weighted.withColumn(score_as, F.col(weight) + gumbel(id_col, seed)), "weights")
    k = scored.where(F.col(weight) >= math.log(least_odds) - odds).count()
    if not k:
        return scored.withColumn(kept_as, F.lit(False))
    return scored.withColumn(kept_as, F.col(score_as) >= F.lit(kth_largest(scored, score_as, k)))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, log_weight, score, kept) for every document.

    Repeated rows get the same noise and so the same verdict; null ids share theirs. Null and empty texts have log weight 0.
    Other columns aren't read. An empty table gives an empty table; without labels all documents have weight 0 and stay.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratio, odds = fit(rows, labels)
    return resample(weigh(rows, ratio).drop("text"), odds)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are drawn; all columns stay, under whatever names.

    Nulls, empty texts, repeated rows and empty tables fare as in judge(); no row is lost but those not drawn.
    """
    ratio, odds = fit(docs, labels)
    weight, score, kept = fresh(docs.columns, "log_weight", "score", "kept")
    got = resample(weigh(docs, ratio, weight_as=weight), odds, weight, score, kept)
    return got.where(F.col(kept)).select(*(f"`{c}`" for c in docs.columns))
