"""Ranking one list for two members, and starting without history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duolist.functions import clip, genre_list, percentile_rank
from duolist.operators import ranks
from duolist.operators.checks import check_ratings
from duolist.schema import assert_unique, require_columns

ORDER = ("groupScore", "minimumScore", "averageScore")
#: Genres of the onboarding list, in the order they take turns.
ONBOARDING_GENRES = ("Drama", "Comedy", "Action", "Thriller", "Adventure", "Crime", "Sci-Fi", "Romance", "Animation", "Children", "Fantasy", "Mystery", "Documentary", "Horror", "Musical", "War", "Western", "Film-Noir")


def normalize_scores(scores: DataFrame) -> DataFrame:
    """Adds qA and qB, percentile ranks of scoreA and scoreB among each pair's candidates."""
    require_columns(scores, ["pairId", "movieId", "scoreA", "scoreB"], "scores")
    return scores.withColumns({"qA": percentile_rank("scoreA", "pairId"), "qB": percentile_rank("scoreB", "pairId")})


def group_scores(normalized: DataFrame, conflict_weight: float | None) -> DataFrame:
    """Adds averageScore, minimumScore, disagreement and groupScore.

    groupScore is (1 - w) * average + w * minimum; without a weight it is the square root of the product.
    """
    if conflict_weight is not None and not 0 <= conflict_weight <= 1:
        raise ValueError("conflict_weight must lie between 0 and 1")
    a, b = F.col("qA"), F.col("qB")
    out = normalized.withColumns({"averageScore": (a + b) / 2, "minimumScore": F.least(a, b), "disagreement": F.abs(a - b)})
    group = F.sqrt(a * b) if conflict_weight is None else (1 - conflict_weight) * F.col("averageScore") + conflict_weight * F.col("minimumScore")
    return out.withColumn("groupScore", group)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Rank 1 to k within each pair; ties by minimum, average, then the smaller movieId."""
    if k <= 0:
        raise ValueError("k must be positive")
    # rounded, for sums of the same ranks in another order may differ in their last bits
    order = Window.partitionBy("pairId").orderBy(*(F.round(c, 12).desc() for c in ORDER), "movieId")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_linear(normalized: DataFrame, conflict_weight: float, k: int = 10) -> DataFrame:
    """Average (0), least misery (1) and what lies between."""
    return top_k(group_scores(normalized, conflict_weight), k)


def rank_nash(normalized: DataFrame, k: int = 10) -> DataFrame:
    return top_k(group_scores(normalized, None), k)


def recommend_from_scores(pairs: DataFrame, scores: DataFrame, catalog: DataFrame, seen: DataFrame, conflict_weight: float | None = 0.65, k: int = 10) -> DataFrame:
    """Lists from long scores (userId, movieId, score). A movie of the catalogue without a score has score 0.

    What either member has seen goes before scores are normalised.
    """
    return lists_from_scores(pairs, scores, catalog, seen, [conflict_weight], k).drop("conflictWeight")


def lists_from_scores(pairs: DataFrame, scores: DataFrame, catalog: DataFrame, seen: DataFrame, weights: list[float | None], k: int = 10) -> DataFrame:
    """recommend_from_scores() for several conflict weights in one pass, with a column conflictWeight (null: product)."""
    return ranks.lists_of_scored(pairs, scores, ranks.numbered(catalog), seen, weights, k)


def recommend_from_vectors(pairs: DataFrame, users: DataFrame, items: DataFrame, seen: DataFrame, conflict_weight: float | None = 0.65, k: int = 10) -> DataFrame:
    """Lists from inner products. users: userId, vec; items: movieId, vec. Pairs without candidates get no rows.

    KeyError that names members without a vector.
    """
    return lists_from_vectors(pairs, users, items, seen, [conflict_weight], k).drop("conflictWeight")


def lists_from_vectors(pairs: DataFrame, users: DataFrame, items: DataFrame, seen: DataFrame, weights: list[float | None], k: int = 10) -> DataFrame:
    """recommend_from_vectors() for several conflict weights in one pass, with a column conflictWeight (null: product)."""
    return ranks.lists_of_vectors(pairs, users, items, seen, weights, k)


def movie_catalog(movies: DataFrame, catalog: DataFrame) -> DataFrame:
    """Movies of the catalogue with title, genres and count; ValueError if none is left, or ids repeat or counts are negative."""
    assert_unique(movies, ["movieId"], "movies")
    assert_unique(catalog, ["movieId"], "catalog")
    out = catalog.join(movies, "movieId").withColumn("genres", F.coalesce("genres", F.lit("(no genres listed)")))
    if out.isEmpty() or not catalog.where("trainPositiveCount < 0").isEmpty():
        raise ValueError("the catalogue is empty or has negative counts")
    return out


def onboarding_movies(movies: DataFrame, catalog: DataFrame, n: int = 36, pool_size: int = 750, genres: tuple[str, ...] = ONBOARDING_GENRES) -> DataFrame:
    """(movieId, title, genres, trainPositiveCount, onboardingOrder): genres take turns with their most popular unused title.

    Sequential by nature, over a pool of max(n, pool_size) rows.
    """

    def turns(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["trainPositiveCount", "movieId"], ascending=[False, True])
        waiting = {g: [i for i, names in zip(pool.index, pool["genres"].str.split("|"), strict=True) if g in names] for g in genres}
        taken: list[int] = []
        while len(taken) < n:
            before = len(taken)
            for g in genres:
                nxt = next((i for i in waiting[g] if i not in taken), None)
                if nxt is not None and len(taken) < n:
                    taken.append(nxt)
            if len(taken) == before:
                break
        taken += [i for i in pool.index if i not in taken][: n - len(taken)]
        out = pool.loc[taken].copy()
        out["onboardingOrder"] = range(1, len(out) + 1)
        return out[["movieId", "title", "genres", "trainPositiveCount", "onboardingOrder"]]

    if n <= 0:
        raise ValueError("n must be positive")
    pool = movie_catalog(movies, catalog).select(F.col("movieId").cast("long"), "title", "genres", F.col("trainPositiveCount").cast("long")).orderBy(F.desc("trainPositiveCount"), "movieId").limit(max(n, pool_size))
    return pool.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda f: turns(f), "movieId long, title string, genres string, trainPositiveCount long, onboardingOrder long")


def cold_start_scores(movies: DataFrame, catalog: DataFrame, ratings: DataFrame, pool_size: int = 2000, profile_prior: float = 2.0, confidence_prior: float = 5.0) -> DataFrame:
    """(movieId, trainPositiveCount, popularity, taste, confidence, score) of the most popular movies a member hasn't rated."""
    films = movie_catalog(movies, catalog)
    own = check_ratings(ratings, "ratings", catalog).select("movieId", "rating").join(films.select("movieId", "genres"), "movieId")
    n = own.count()
    confidence = n / (n + confidence_prior)
    preference = own.select(F.explode(F.array_distinct(genre_list("genres"))).alias("genre"), (F.col("rating").cast("double") - 3).alias("d")).where("genre <> '(no genres listed)'").groupBy("genre").agg((F.sum("d") / (F.count(F.lit(1)) + profile_prior)).alias("pref"))
    pool = films.join(own.select("movieId"), "movieId", "left_anti").orderBy(F.desc("trainPositiveCount"), "movieId").limit(pool_size)
    pool = pool.withColumn("__one", F.lit(1)).withColumn("popularity", percentile_rank("trainPositiveCount", "__one")).drop("__one")
    named = pool.select("movieId", F.explode(F.array_distinct(genre_list("genres"))).alias("genre")).where("genre <> '(no genres listed)'")
    taste = named.join(preference, "genre", "left").groupBy("movieId").agg(F.avg(F.coalesce("pref", F.lit(0.0))).alias("m"))
    out = pool.join(taste, "movieId", "left").withColumns({"taste": F.coalesce(clip(0.5 + F.col("m") / 2), F.lit(0.5)), "confidence": F.lit(confidence)})
    w = 0.8 * F.col("confidence")
    return out.select("movieId", "trainPositiveCount", "popularity", "taste", "confidence", (w * F.col("taste") + (1 - w) * F.col("popularity")).alias("score"))


def diversify(ranked: DataFrame, k: int, weight: float) -> DataFrame:
    """Re-ranks each pair's list one title at a time: its score is groupScore plus `weight` times how unlike its genres are.

    diversityBonus is 1 less the greatest Jaccard overlap with a title taken before, 0 for the first; ties go by minimum, average,
    then the smaller movieId. baseRank is the rank that a title came with. Lists are short by construction. ValueError if a list
    has fewer than k titles.
    """
    if k <= 0 or not 0 <= weight <= 1:
        raise ValueError("k must be positive and the weight lie between 0 and 1")
    rows = ranked.select(F.col("pairId").cast("long"), F.col("movieId").cast("long"), "genres", F.col("rank").cast("long").alias("baseRank"), *(F.col(c).cast("double") for c in ORDER))
    if not rows.groupBy("pairId").count().where(F.col("count") < k).isEmpty():
        raise ValueError("k is larger than a list")

    def reranked(frame: pd.DataFrame) -> pd.DataFrame:
        base = frame["groupScore"].to_numpy()
        names = [set(filter(None, (g or "").split("|"))) - {"(no genres listed)"} for g in frame["genres"]]
        every = sorted(set().union(*names))
        has = np.array([[g in own for g in every] for own in names], float).reshape(len(names), len(every))
        size = has.sum(axis=1)
        overlap, open_, picks = np.zeros(len(base)), np.ones(len(base), bool), []
        for turn in range(k):
            bonus = 1 - overlap if turn else np.zeros(len(base))
            total = base + weight * bonus
            at = np.lexsort((frame["movieId"], -frame["averageScore"], -frame["minimumScore"], -total, ~open_))[0]
            picks.append((at, bonus[at], total[at]))
            open_[at] = False
            common = has @ has[at]
            overlap = np.maximum(overlap, np.divide(common, size + size[at] - common, out=np.zeros(len(base)), where=size + size[at] > common))
        out = frame.iloc[[p[0] for p in picks]].reset_index(drop=True)
        return out[["pairId", "movieId", "groupScore", "baseRank"]].assign(diversityBonus=[p[1] for p in picks], diversifiedScore=[p[2] for p in picks], rank=range(1, k + 1))

    return rows.groupBy("pairId").applyInPandas(reranked, "pairId long, movieId long, groupScore double, baseRank long, diversityBonus double, diversifiedScore double, rank long")


def recommend_cold_start(movies: DataFrame, catalog: DataFrame, ratings_a: DataFrame, ratings_b: DataFrame, conflict_weight: float = 0.65, k: int = 10, pool_size: int = 2000, diversity_weight: float = 0.0, diversity_pool: int = 100) -> DataFrame:
    """One list for two newcomers; neither's rated movies are on it."""
    rated = ratings_a.select("movieId").unionAll(ratings_b.select("movieId")).distinct()
    larger = pool_size + rated.count()
    a, b = (cold_start_scores(movies, catalog, r, larger) for r in (ratings_a, ratings_b))
    both = a.select("movieId", "trainPositiveCount", F.col("score").alias("scoreA")).join(b.select("movieId", F.col("score").alias("scoreB")), "movieId").join(rated, "movieId", "left_anti")
    pool = both.orderBy(F.desc("trainPositiveCount"), "movieId").limit(pool_size).drop("trainPositiveCount").withColumn("pairId", F.lit(0))
    normalized = normalize_scores(pool)
    details = movie_catalog(movies, catalog)
    if not diversity_weight:
        return rank_linear(normalized, conflict_weight, k).join(details, "movieId", "left")
    ranked = rank_linear(normalized, conflict_weight, max(k, diversity_pool)).join(details, "movieId", "left")
    return diversify(ranked, k, diversity_weight).join(details, "movieId", "left")
