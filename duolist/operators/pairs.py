"""Pairs of users: their features, selection and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duolist.config import PrepConfig
from duolist.functions import genre_list, hash_order, pearson
from duolist.operators.statistics import quantiles
from duolist.schema import dense_index, shared_table


def genre_profiles(train: DataFrame, movies: DataFrame, users: DataFrame, config: PrepConfig) -> DataFrame:
    """(userId, genre, weight): how much more a user likes a genre than films in general, shrunk and scaled to length 1.

    Genres that a user hasn't met weigh 0 and are left out, as are users all of whose weights are 0.
    """
    rated = train.join(users.select("userId"), "userId", "left_semi").select("userId", "movieId", (F.col("rating") >= config.positive_threshold).cast("double").alias("liked"))
    rate = rated.groupBy("userId").agg(F.avg("liked").alias("rate"))
    met = rated.join(movies.select("movieId", F.explode(F.array_distinct(genre_list("genres"))).alias("genre")), "movieId")
    m = config.genre_prior_strength
    raw = met.groupBy("userId", "genre").agg(F.sum("liked").alias("likes"), F.count(F.lit(1)).alias("n")).join(rate, "userId")
    raw = raw.select("userId", "genre", ((F.col("likes") + m * F.col("rate")) / (F.col("n") + m) - F.col("rate")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("userId")))
    return raw.withColumn("norm", norm).where("norm > 0").select("userId", "genre", (F.col("w") / F.col("norm")).alias("weight"))


def genre_similarity(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(userA, userB, genreSimilarity): inner product of the two profiles."""
    a = profiles.select(F.col("userId").alias("userA"), "genre", F.col("weight").alias("wa"))
    b = profiles.select(F.col("userId").alias("userB"), "genre", F.col("weight").alias("wb"))
    shared = pairs.select("userA", "userB").join(a, "userA").join(b, ["userB", "genre"])
    sums = shared.groupBy("userA", "userB").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    return pairs.select("userA", "userB").join(sums, ["userA", "userB"], "left").select("userA", "userB", F.coalesce("s", F.lit(0.0)).alias("genreSimilarity"))


def co_rated(pairs: DataFrame, train: DataFrame, config: PrepConfig) -> DataFrame:
    """(userA, userB, coRatedTrain, ratingCorrelation): correlation is missing below the least number of shared movies."""
    a = train.select(F.col("userId").alias("userA"), "movieId", F.col("rating").cast("double").alias("ra"))
    b = train.select(F.col("userId").alias("userB"), "movieId", F.col("rating").cast("double").alias("rb"))
    both = pairs.select("userA", "userB").join(a, "userA").join(b, ["userB", "movieId"])
    found = both.groupBy("userA", "userB").agg(F.count(F.lit(1)).alias("n"), pearson("ra", "rb").alias("r"))
    out = pairs.select("userA", "userB").join(found, ["userA", "userB"], "left")
    return out.select("userA", "userB", F.coalesce("n", F.lit(0)).cast("long").alias("coRatedTrain"), F.when(F.col("n") >= config.pair_min_co_rated, F.col("r")).alias("ratingCorrelation"))


def pair_features(pairs: DataFrame, train: DataFrame, movies: DataFrame, config: PrepConfig) -> DataFrame:
    """pairs with coRatedTrain, genreSimilarity and ratingCorrelation."""
    members = pairs.select(F.explode(F.array("userA", "userB")).alias("userId")).distinct()
    of_members = train.join(members, "userId", "left_semi")
    key = ["userA", "userB"]
    return pairs.join(co_rated(pairs, of_members, config), key, "left").join(genre_similarity(pairs, genre_profiles(of_members, movies, members, config)), key, "left")


def sample_pairs(users: DataFrame, config: PrepConfig) -> DataFrame:
    """Distinct pairs from draws with replacement: each draw takes two places in the order of ids by hashes of its number."""
    placed = dense_index(users.select("userId").distinct(), ["userId"], "i")
    n = placed.count()
    if n < 2:
        raise ValueError("pairs need at least two users")
    draws = users.sparkSession.range(config.pair_candidate_sample_size)
    left = F.pmod(F.xxhash64(F.lit(config.random_seed), F.lit("a"), "id"), F.lit(n))
    right = F.pmod(left + 1 + F.pmod(F.xxhash64(F.lit(config.random_seed), F.lit("b"), "id"), F.lit(n - 1)), F.lit(n))
    drawn = draws.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct()
    return drawn.join(placed.select(F.col("i").alias("a"), F.col("userId").alias("userA")), "a").join(placed.select(F.col("i").alias("b"), F.col("userId").alias("userB")), "b").select("userA", "userB")


def consecutive_pairs(users: DataFrame) -> DataFrame:
    """(pairId, userA, userB): users in the order of their ids, two by two; one who is left over goes."""
    placed = dense_index(users.select("userId").distinct(), ["userId"], "i")
    pairs = placed.groupBy(F.floor(F.col("i") / 2).alias("pairId")).agg(F.min("userId").alias("userA"), F.max("userId").alias("userB"), F.count(F.lit(1)).alias("n"))
    return pairs.where("n = 2").select("pairId", "userA", "userB")


def random_disjoint_pairs(users: DataFrame, pair_count: int, seed: int) -> DataFrame:
    """(pairId, userA < userB): 2 * pair_count different users by hash order, two by two; ValueError if there are too few."""
    chosen = users.select("userId").distinct().orderBy(hash_order(seed, "userId"), "userId").limit(2 * pair_count)
    placed = chosen.withColumn("i", F.row_number().over(Window.orderBy(hash_order(seed, "userId"), "userId")) - 1)  # as many rows as asked for
    pairs = shared_table(placed.groupBy(F.floor(F.col("i") / 2).cast("long").alias("pairId")).agg(F.min("userId").alias("userA"), F.max("userId").alias("userB"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n"), "pairs")
    if pairs.count() < pair_count:
        raise ValueError("too few users for the pairs asked for")
    return pairs


def greedy_pairs(pairs: DataFrame, order: str, cap: int) -> DataFrame:
    """Of pairs in ascending order, those that find both members in fewer than cap pairs taken before.

    The same choice as going through them one by one, made in rounds: a pair is taken once even all its members' undecided
    earlier pairs couldn't fill the cap, and dropped once the taken ones do. The first undecided pair is decided in each
    round, and usually a large share of them.
    """
    state = shared_table(pairs.select(F.col(order).alias("o"), "userA", "userB", F.lit(None).cast("boolean").alias("taken")), "greedy")
    before = Window.partitionBy("u").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    while not state.where("taken is null").isEmpty():
        of_user = state.select("o", "taken", F.explode(F.array("userA", "userB")).alias("u"))
        counts = of_user.select("o", F.coalesce(F.count_if("taken").over(before), F.lit(0)).alias("full"), F.coalesce(F.count_if(F.col("taken").isNull()).over(before), F.lit(0)).alias("open"))
        most = counts.groupBy("o").agg(F.max("full").alias("full"), F.max(F.col("full") + F.col("open")).alias("could"))
        decided = F.when(F.col("taken").isNotNull(), F.col("taken")).when(F.col("full") >= cap, F.lit(False)).when(F.col("could") < cap, F.lit(True))
        state = shared_table(state.join(most, "o").select("o", "userA", "userB", decided.alias("taken")), "greedy")
    return pairs.join(state.where("taken").select(F.col("o").alias(order)), order, "left_semi")


def disjoint_pairs(pairs: DataFrame, pair_limit: int) -> DataFrame:
    """The first pair_limit pairs in the order of pairId that share no member, with pairId anew from 0; ValueError if fewer."""
    chosen = greedy_pairs(pairs, "pairId", 1).orderBy("pairId").limit(pair_limit)
    out = shared_table(chosen.withColumn("pairId", (F.row_number().over(Window.orderBy("pairId")) - 1).cast("long")), "pairs")
    if out.count() < pair_limit:
        raise ValueError("too few pairs without a shared member")
    return out


def dissimilar_pairs(features: DataFrame, config: PrepConfig) -> tuple[DataFrame, dict[str, object]]:
    """(pairs, summary): eligible pairs low in both similarities, each user in a few at most; ValueError if none is eligible."""
    eligible = features.where((F.col("coRatedTrain") >= config.pair_min_co_rated) & F.col("ratingCorrelation").isNotNull())
    q = config.pair_similarity_quantile
    n = eligible.count()
    if not n:
        raise ValueError("no pair is eligible")
    (genre,), (rating,) = (quantiles(eligible, c, [q]) for c in ("genreSimilarity", "ratingCorrelation"))
    low = eligible.where((F.col("genreSimilarity") <= genre) & (F.col("ratingCorrelation") <= rating))
    keyed = dense_index(low.withColumn("__h", hash_order(config.random_seed, "userA", "userB")), ["__h", "userA", "userB"], "pairId").drop("__h")
    chosen = greedy_pairs(keyed, "pairId", config.max_pairs_per_user)
    out = dense_index(chosen.withColumnRenamed("pairId", "__o"), ["__o"], "pairId").drop("__o")
    summary = {"sampled_pairs": features.count(), "eligible_pairs": n, "genre_cutoff": genre, "correlation_cutoff": rating, "candidate_pairs": keyed.count(), "selected_pairs": out.count(), "max_pairs_per_user": config.max_pairs_per_user}
    return out, summary


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles (interpolated) and greatest of a column; missing values don't count."""
    c = F.col(f"`{column}`")
    quartiles = [F.lit(q).cast("double").alias(n) for q, n in zip(quantiles(df, c, [0.25, 0.5, 0.75]), ("q25", "q50", "q75"), strict=True)]
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *quartiles, F.max(c).alias("max"))


def evaluated_members(pairs: DataFrame, first: int = 100, disjoint: int = 500) -> DataFrame:
    """(userId) of the first pairs by pairId and of the first that share no member: users whom a new holdout must leave out."""
    chosen = pairs.where(F.col("pairId") < first).select("userA", "userB").unionByName(disjoint_pairs(pairs, disjoint).select("userA", "userB"))
    return chosen.select(F.explode(F.array("userA", "userB")).alias("userId")).distinct()


def band_rule(development: DataFrame) -> dict[str, float]:
    """Lower and upper tertile of genreSimilarity, interpolated."""
    lower, upper = quantiles(development, "genreSimilarity", [1 / 3, 2 / 3])
    return {"lower": lower, "upper": upper}


def similarity_bands(pairs: DataFrame, rule: dict[str, float]) -> DataFrame:
    """Adds similarityBand; a missing similarity counts as similar."""
    s = F.col("genreSimilarity")
    return pairs.withColumn("similarityBand", F.when(s <= rule["lower"], "high_conflict").when(s <= rule["upper"], "mixed").otherwise("similar"))


def _ranked(rows: DataFrame, score: str, as_name: str) -> DataFrame:
    """Adds the percentile rank of the negated score among all rows, as percentile_rank has it, without a sort in one task.

    Different values are dealt by range; a value's rank follows from the counts in its range and those of the earlier ranges.
    """
    values = rows.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = shared_table(values.repartitionByRange("__v").withColumn("__p", F.spark_partition_id()), "values")
    before, starts = 0, []
    for p, n in sorted(placed.groupBy("__p").agg(F.sum("__n")).collect()):
        starts.append((p, before))
        before += n
    first = rows.sparkSession.createDataFrame(starts, "__p int, __first long")
    up_to = F.sum("__n").over(Window.partitionBy("__p").orderBy("__v"))
    ranks = placed.withColumn("__to", up_to).join(F.broadcast(first), "__p").select("__v", ((F.col("__first") + F.col("__to") - (F.col("__n") - 1) / 2) / F.lit(before)).alias(as_name))
    return rows.withColumn("__v", -F.col(score)).join(ranks, "__v", "left").drop("__v")


def conflict_scores(features: DataFrame) -> DataFrame:
    """Adds conflictScore: mean percentile rank of both negated similarities; null where one is missing."""
    both = _ranked(_ranked(features, "genreSimilarity", "__a"), "ratingCorrelation", "__b")
    return shared_table(both.withColumn("conflictScore", (F.col("__a") + F.col("__b")) / 2).drop("__a", "__b"), "conflicts")


def conflict_bands(features: DataFrame, distinct: bool = True) -> DataFrame:
    """Adds conflictScore and conflictBand, the score cut at its tertiles.

    ValueError if a pair lacks a similarity, or, when distinct tertiles are asked for, if they coincide or there are no pairs. Else
    scores up to coinciding tertiles are low and none is medium.
    """
    if not features.where("genreSimilarity is null or ratingCorrelation is null").isEmpty():
        raise ValueError("some pairs lack a similarity")
    ranked = conflict_scores(features)
    low, high = quantiles(ranked, "conflictScore", [1 / 3, 2 / 3])
    if distinct and low == high:
        raise ValueError("the tertiles of the conflict score coincide")
    s = F.col("conflictScore")
    return ranked.withColumn("conflictBand", F.when(s <= low, "low").when(s <= high, "medium").otherwise("high"))


def joint_counts(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """pairs with jointTestPositiveCount: movies that both members have among the events."""
    liked = events.select("userId", "movieId").distinct()
    a = liked.select(F.col("userId").alias("userA"), "movieId")
    b = liked.select(F.col("userId").alias("userB"), "movieId")
    shared = pairs.select("userA", "userB").distinct().join(a, "userA").join(b, ["userB", "movieId"]).groupBy("userA", "userB").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(shared, ["userA", "userB"], "left").withColumn("jointTestPositiveCount", F.coalesce("n", F.lit(0))).drop("n")
