"""Recommenders: popularity, item neighbourhoods, alternating least squares, biased factorisation, propagated embeddings."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duolist.config import AlsConfig, BiasedMfConfig, GraphConfig
from duolist.functions import dot
from duolist.operators import strata
from duolist.operators.cohorts import seen_by_pair
from duolist.schema import dense_index, drop_table, shared_table

#: Likes of one user that meet each other in one part of a join; a heavier user's are cut into blocks.
USER_BLOCK = 1024
#: Rows that come out of a task of a neighbourhood's joins, on average: bytes read don't tell how many that are.
ROWS_AT_ONCE = 2_000_000
#: Numbers of sums that a task of least squares holds at once.
NUMBERS_AT_ONCE = 4_000_000


def popularity_ranks(catalog: DataFrame) -> DataFrame:
    """Adds popularityRank from 1: most training likes first, then the smaller movieId."""
    ranked = dense_index(catalog.withColumn("__c", -F.col("trainPositiveCount")), ["__c", "movieId"], "popularityRank")
    return ranked.withColumn("popularityRank", F.col("popularityRank") + 1).drop("__c")


def recommend_popular(pairs: DataFrame, catalog: DataFrame, seen: DataFrame, k: int = 10) -> DataFrame:
    """(pairId, userA, userB, rank, movieId, score): the k most popular movies that neither member has seen.

    A pair that has seen s movies finds its k among the first k + s of the catalogue, so no more of it is looked at.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    watched = seen_by_pair(pairs, seen.join(catalog.select("movieId"), "movieId", "left_semi"))
    n = watched.groupBy("pairId").agg(F.count(F.lit(1)).alias("n"))
    slots = pairs.select("pairId", "userA", "userB").join(n, "pairId", "left").withColumn("popularityRank", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(0)) + k)))
    open_ = slots.join(popularity_ranks(catalog), "popularityRank").join(watched, ["pairId", "movieId"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("pairId").orderBy("popularityRank"))
    return open_.withColumn("rank", rank).where(F.col("rank") <= k).select("pairId", "userA", "userB", "rank", "movieId", F.col("trainPositiveCount").cast("double").alias("score"))


def _parts(rows: int | None) -> int:
    return max(1, math.ceil((rows or 0) / ROWS_AT_ONCE))


def _met(likes: DataFrame) -> int:
    """Tasks for all that meets where every two likes of a user do. likes: distinct userId, movieId."""
    sizes = likes.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    return _parts(sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0])


def co_counts(likes: DataFrame, block: int = USER_BLOCK, met: int | None = None) -> DataFrame:
    """(src, cand, n): in how many users' likes both movies are, src below cand. likes: distinct userId, movieId.

    A user's likes meet in one row, without a join. A user with more than `block` of them is cut into blocks by movie, and each
    pair of blocks meets for itself, so no key holds more than two blocks of rows. met: tasks, where they are known.
    """
    likes = likes.select("userId", "movieId")
    sizes = likes.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))
    met = met or _met(likes)
    heavy = shared_table(sizes.select("userId", F.ceil(F.col("n") / block).alias("parts")).where("parts > 1"), "heavy")
    lists = likes.join(heavy, "userId", "left_anti").repartition(met, "userId").groupBy("userId").agg(F.sort_array(F.collect_list("movieId")).alias("m"))
    own = lists.select(F.posexplode("m").alias("i", "src"), "m").select("src", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("cand"))
    if not heavy.isEmpty():
        cut = likes.join(heavy, "userId").withColumn("part", F.pmod(F.xxhash64("movieId"), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = cut.select("userId", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "movieId", "part")
        a, b = (dealt.select("userId", "low", "high", F.col("movieId").alias(f"m{x}"), F.col("part").alias(f"p{x}")) for x in "ab")
        within, across = (F.col("low") == F.col("high")) & (F.col("ma") < F.col("mb")), (F.col("low") < F.col("high")) & (F.col("pa") == F.col("low")) & (F.col("pb") == F.col("high"))
        key = ["userId", "low", "high"]
        cross = a.repartition(met, *key).join(b.repartition(met, *key), key).where(within | across)
        own = own.unionAll(cross.select(F.least("ma", "mb"), F.greatest("ma", "mb")))
    return own.repartition(met, "src", "cand").groupBy("src", "cand").agg(F.count(F.lit(1)).alias("n"))


def item_neighbours(edges: DataFrame, max_neighbors: int = 100, shrinkage: float = 0.0, block: int = USER_BLOCK) -> DataFrame:
    """(src, cand, similarity, rank): shared likers over the root of both counts' product plus shrinkage.

    As in a dense matrix every other movie is a neighbour, but those without shared likers have similarity 0 and are left
    out; they would come last.
    """
    if max_neighbors <= 0 or shrinkage < 0:
        raise ValueError("max_neighbors must be positive and shrinkage not negative")
    likes = shared_table(edges.select("userId", "movieId").distinct(), "likes")
    degree = likes.groupBy("movieId").agg(F.count(F.lit(1)).alias("d"))
    met = _met(likes)

    def dealt(df: DataFrame, key: str, times: int = 1) -> DataFrame:  # the shuffle's usual number of tasks doesn't grow with what meets
        return df.repartition(times * met, key) if met > df.sparkSession.sparkContext.defaultParallelism else df

    sim = co_counts(likes, block, met)  # each unordered pair is counted once and mirrored afterwards
    for end, d in (("src", "ds"), ("cand", "dc")):
        sim = dealt(sim, end).join(dealt(degree.select(F.col("movieId").alias(end), F.col("d").alias(d)), end), end)
    sim = sim.select("src", "cand", (F.col("n") / (F.sqrt(F.col("ds").cast("double") * F.col("dc")) + shrinkage)).alias("similarity"))
    both = sim.select("src", "cand", "similarity", F.explode(F.array(F.lit(False), F.lit(True))).alias("turn"))
    both = both.select(F.when(F.col("turn"), F.col("cand")).otherwise(F.col("src")).alias("src"), F.when(F.col("turn"), F.col("src")).otherwise(F.col("cand")).alias("cand"), "similarity")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "cand")
    return dealt(both, "src", 2).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_neighbors)


def neighbour_scores(likes: DataFrame, neighbours: DataFrame, width: int) -> DataFrame:
    """(userId, movieId, score): sum of similarities from a user's likes; movies that don't appear have score 0."""
    near = neighbours.where(F.col("rank") <= width).select(F.col("src").alias("movieId"), "cand", "similarity")
    likes = shared_table(likes.select("userId", "movieId").distinct(), "likes")
    parts = _parts(likes.count() * width)
    met = likes.repartition(parts, "movieId").join(near.repartition(parts, "movieId"), "movieId")
    return met.select("userId", F.col("cand").alias("movieId"), "similarity").repartition(parts, "userId", "movieId").groupBy("userId", "movieId").agg(F.sum("similarity").alias("score"))


#: Ids and degrees that one number holds together.
PACKED_IDS = 2**31


def small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{max(1, len(packed) // max(1, n))}").astype(np.int64)


LISTED = "at long, degree long, size int, first long, steps binary, n binary, degrees binary"


def neighbour_lists(edges: DataFrame, max_neighbors: int, shrinkage: float = 0.0, block: int = USER_BLOCK) -> DataFrame:
    """item_neighbours() as one row a movie, packed (see similarities()): a table of its own. edges: userId, at.

    at: from 0 and below PACKED_IDS. A similarity follows from both movies' numbers of likes and that of shared likers, which take a
    few bytes where it takes eight, so lists that travel to each user who likes a movie stay small.
    """
    if max_neighbors <= 0 or shrinkage < 0:
        raise ValueError("max_neighbors must be positive and shrinkage not negative")
    likes = edges.select("userId", F.col("at").cast("long").alias("at")).distinct()
    degree = likes.groupBy("at").agg(F.count(F.lit(1)).alias("d"))
    coded = shared_table(likes.join(degree, "at").select("userId", (F.col("at") * PACKED_IDS + F.col("d")).alias("movieId")), "likes")
    met = _met(coded)
    blocks = max(met, min(coded.sparkSession.sparkContext.defaultParallelism, max(1, coded.count() // 1000)))

    def mirrored(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            src, cand, n = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([n, n])
            part = (src // PACKED_IDS) % blocks
            order = np.lexsort((cand, src, part))
            src, cand, n, part = src[order], cand[order], n[order], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            parts = []
            for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
                own = np.flatnonzero(np.r_[True, src[i + 1 : j] != src[i : j - 1]])
                parts.append((part[i], src[i:j][own].tobytes(), small(np.diff(own, append=j - i)), small(cand[i:j] // PACKED_IDS), small(cand[i:j] % PACKED_IDS), small(n[i:j])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts, strict=True)], names=["part", "src", "sizes", "cand", "degrees", "n"])

    def listed(rows: pa.Table) -> pa.Table:
        held = [[] for _ in range(4)]
        for src, sizes, *more in zip(*(rows.column(i).to_pylist() for i in range(1, 6)), strict=True):
            src = np.frombuffer(src, np.int64)
            sizes = wide(sizes, len(src))
            for to, x in zip(held, (np.repeat(src, sizes), *(wide(m, int(sizes.sum())) for m in more)), strict=True):
                to.append(x)
        src, cand, dc, n = (np.concatenate(h) for h in held)
        similarity = n / (np.sqrt((src % PACKED_IDS).astype(float) * dc) + shrinkage)
        order = np.lexsort((cand, -similarity, src))
        first = np.flatnonzero(np.r_[True, src[order][1:] != src[order][:-1]])
        rank = np.arange(len(src)) - np.repeat(first, np.diff(first, append=len(src)))
        kept = order[rank < max_neighbors]
        kept = kept[np.lexsort((cand[kept], src[kept]))]
        src, cand, dc, n = src[kept], cand[kept], dc[kept], n[kept]
        cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        spans = list(zip(cuts, [*cuts[1:], len(src)], strict=True))
        columns = (src[cuts] // PACKED_IDS, src[cuts] % PACKED_IDS, [j - i for i, j in spans], cand[cuts], *([f(i, j) for i, j in spans] for f in (lambda i, j: small(np.diff(cand[i:j], prepend=cand[i])), lambda i, j: small(n[i:j]), lambda i, j: small(dc[i:j]))))
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=[c.split()[0] for c in LISTED.split(", ")])

    packed = co_counts(coded, block, met).mapInArrow(mirrored, "part long, src binary, sizes binary, cand binary, degrees binary, n binary")
    out = shared_table(packed.repartition(blocks, "part").groupBy("part").applyInArrow(listed, LISTED), "neighbours")
    drop_table(coded)
    return out


def similarities(rows: list[tuple], shrinkage: float) -> tuple[np.ndarray, np.ndarray]:
    """(movies, sums of their similarities to the movies of some lists): rows (degree, size, first, steps, n, degrees)."""
    at, sim = [], []
    for degree, size, first, steps, n, degrees in rows:
        at.append(first + np.cumsum(wide(steps, size)))
        sim.append(wide(n, size) / (np.sqrt(float(degree) * wide(degrees, size)) + shrinkage))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0)
    found, own = np.unique(np.concatenate(at), return_inverse=True)
    return found, np.bincount(own, np.concatenate(sim))


def scores_of_lists(likes: DataFrame, lists: DataFrame, shrinkage: float, users_at_once: int = 1024) -> DataFrame:
    """(userId, at, score): neighbour_scores() of likes (userId, at) from neighbour_lists(), without a row for each like and neighbour."""
    likes = likes.select(F.col("userId").cast("long").alias("userId"), F.col("at").cast("long").alias("at")).distinct()
    blocks = max(1, math.ceil(likes.count() / (4 * users_at_once)))  # users have several likes each
    met = likes.join(lists, "at").withColumn("block", F.pmod(F.xxhash64("userId"), F.lit(blocks)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("userId", "ascending"), ("at", "ascending")])
        user, own = rows.column("userId").to_numpy(), list(zip(*(rows.column(c).to_pylist() for c in ("degree", "size", "first", "steps", "n", "degrees")), strict=True))
        cuts, users, at, scores = np.flatnonzero(np.r_[True, user[1:] != user[:-1]]), [], [], []
        for i, j in zip(cuts, [*cuts[1:], len(user)], strict=True):
            found, score = similarities(own[i:j], shrinkage)
            users.append(np.full(len(found), user[i]))
            at.append(found)
            scores.append(score)
        return pa.table({"userId": np.concatenate(users), "at": np.concatenate(at), "score": np.concatenate(scores)})

    return met.groupBy("block").applyInArrow(run, "userId long, at long, score double")


def profile_scores(movies: DataFrame, neighbours: DataFrame, width: int) -> DataFrame:
    """(movieId, score) for a profile from elsewhere; ValueError if no movie of it is known."""
    known = movies.select("movieId").distinct().join(neighbours.select(F.col("src").alias("movieId")).distinct(), "movieId", "left_semi")
    if known.isEmpty():
        raise ValueError("no movie of the profile is known")
    return neighbour_scores(known.withColumn("userId", F.lit(0)), neighbours, width).select("movieId", "score")


def _start(ids: DataFrame, key: str, factors: int, seed: int, scale: float) -> DataFrame:
    """(key, vec): normal numbers that depend on the seed, the id and the place alone (Box-Muller over hashes)."""
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(t), key, "f"), 11).cast("double") + 0.5) / float(2**53) for t in ("a", "b")]
    value = scale * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
    parts = ids.select(key, F.explode(F.sequence(F.lit(0), F.lit(factors - 1))).alias("f")).select(key, "f", value.alias("v"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "v"))), lambda x: x["v"]).alias("vec"))


def gram(vectors: DataFrame, factors: int) -> np.ndarray:
    """Sum of outer products, d x d."""

    def parts(frames):
        total = np.zeros((factors, factors))
        for f in frames:
            x = np.stack(f["vec"].to_list()) if len(f) else np.zeros((0, factors))
            total += x.T @ x
        yield pd.DataFrame({"at": range(factors * factors), "v": total.ravel()})

    rows = vectors.select("vec").mapInPandas(parts, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(factors * factors)
    for r in rows:
        out[r.at] = r.v
    return out.reshape(factors, factors)


def least_squares(edges: DataFrame, key: str, other: str, vectors: DataFrame, config: AlsConfig) -> DataFrame:
    """(key, vec): the exact solution for one side with the other fixed; preference 1 with confidence 1 + alpha, else 0 with 1.

    Each row's sums are taken in parts of bounded size first, so no task holds all that a very popular movie has. Rows are summed and
    solved many at once, in blocks whose number follows from that of the edges.
    """
    base = gram(vectors, config.factors) + config.regularization * np.eye(config.factors)
    d = config.factors
    blocks = max(1, math.ceil(edges.count() * (d * d + d) / NUMBERS_AT_ONCE))

    def starts(frame: pd.DataFrame, *names: str) -> np.ndarray:
        at = frame[list(names)].to_numpy()
        return np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, "part"], kind="stable")
        x, first = np.stack(frame["vec"].to_list()), starts(frame, key, "part")
        runs = [x[i:j] for i, j in zip(first, [*first[1:], len(x)], strict=True)]
        return pd.DataFrame({key: frame[key].to_numpy()[first], "s": [r.sum(axis=0) for r in runs], "o": [(r.T @ r).ravel() for r in runs]})

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable")
        first = starts(frame, key)
        s, o = (np.add.reduceat(np.stack(frame[c].to_list()), first) for c in "so")
        vec = np.linalg.solve(base + config.alpha * o.reshape(-1, d, d), (1 + config.alpha) * s[..., None])[..., 0]
        return pd.DataFrame({key: frame[key].to_numpy()[first], "vec": list(vec)})

    def block(*names: str) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(blocks)).alias("block")

    size = edges.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / 8192).alias("parts"))
    rows = edges.select(F.col(key).cast("long"), F.col(other).cast("long")).join(size.withColumn(key, F.col(key).cast("long")), key).join(vectors, other).withColumn("part", F.pmod(F.xxhash64(other), "parts"))
    sums = rows.select(key, "part", "vec").groupBy(block(key, "part")).applyInPandas(partial, f"{key} long, s array<double>, o array<double>")
    return sums.groupBy(block(key)).applyInPandas(solve, f"{key} long, vec array<double>")


def stop_early(scores: list[tuple[int, tuple[float, float]]], patience: int, window: int = 1) -> tuple[int, bool]:
    """(best step, whether patience ran out) for validation results in order.

    A step counts by the mean of its last `window` results; ties keep the earlier step.
    """
    best, best_key, waited = -1, None, 0
    for i, (step, _) in enumerate(scores):
        recent = [s for _, s in scores[max(0, i - window + 1) : i + 1]]
        key = tuple(sum(x[j] for x in recent) / len(recent) for j in (0, 1))
        if best_key is None or key > best_key:
            best, best_key, waited = step, key, 0
        else:
            waited += 1
            if waited >= patience:
                return best, True
    return best, False


def train_als(edges: DataFrame, config: AlsConfig, validate: Callable[[DataFrame, DataFrame, int], tuple[float, float]] | None = None) -> dict[str, object]:
    """users (userId, vec), movies (movieId, vec), history. Users first, then movies; the best validated factors are kept."""
    edges = shared_table(edges.select(F.col("userId").cast("long"), F.col("movieId").cast("long")).distinct(), "likes")
    movies = shared_table(_start(edges.select("movieId").distinct(), "movieId", config.factors, config.random_seed, 0.1), "factors")
    users, history, kept = None, [], {}
    for i in range(1, config.iterations + 1):
        users = shared_table(least_squares(edges, "userId", "movieId", movies, config), "factors")
        movies = shared_table(least_squares(edges, "movieId", "userId", users, config), "factors")
        if validate and (i % config.validation_interval == 0 or i == config.iterations):
            history.append((i, validate(users, movies, i)))
            kept[i] = (users, movies)
            best, early = stop_early(history, config.patience)
            if early:
                break
    best, early = stop_early(history, config.patience) if history else (i, False)
    users, movies = kept.get(best, (users, movies))
    return {"users": users, "movies": movies, "best": best, "stopped": i, "early": early, "history": history}


def fold_in_als(likes: DataFrame, movies: DataFrame, config: AlsConfig) -> DataFrame:
    """(userId, vec): new users by the same equation, the movies fixed; unknown movies don't count."""
    return least_squares(likes.select("userId", "movieId").distinct(), "userId", "movieId", movies, config)


def _sides(rows: DataFrame) -> DataFrame:
    """(kind, node) of all users and movies of rows (a, b)."""
    return rows.select(F.lit(strata.USER).alias("kind"), F.col("a").alias("node")).unionAll(rows.select(F.lit(strata.MOVIE), "b")).distinct()


def _with_zeros(width: int, again: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Parameters with what a training step needs beside them; again: and once more, as they were before a sweep."""
    return lambda x: np.hstack([x, np.zeros((len(x), 2 * width + 1)), *([x] if again else [])])


def train_biased_mf(ratings: DataFrame, config: BiasedMfConfig, validate: Callable[[dict, int], tuple[float, float]] | None = None) -> dict[str, object]:
    """mean, users (userId, bias, vec), movies (movieId, bias, vec), and each epoch's error, by Adam.

    An epoch is a sweep: every rating is used once, batch_size of them a step, so steps grow with the table; see strata.
    ValueError if there are no ratings or a user rates a movie twice.
    """
    rows = shared_table(ratings.select(F.col("userId").cast("long").alias("a"), F.col("movieId").cast("long").alias("b"), F.col("rating").cast("double").alias("y")), "ratings")
    n, distinct, mean, users, movies = rows.agg(F.count(F.lit(1)), F.count_distinct("a", "b"), F.avg("y"), F.count_distinct("a"), F.count_distinct("b")).first()
    if n != distinct or not n:
        drop_table(rows)
        raise ValueError("ratings are empty or a movie is rated twice")
    d, blocks = config.factors, strata.blocks_for(users, movies, config.block_nodes)
    zeros = _with_zeros(d + 1)
    nodes = shared_table(strata.start_nodes(_sides(rows), d, config.random_seed, 0.05, lambda x: zeros(np.hstack([np.zeros((len(x), 1)), x]))), "parameters")
    step = strata.rating_steps(d, config.batch_size, config.learning_rate, config.regularization, mean)

    def model_of(own: DataFrame) -> dict[str, object]:
        u, m = (strata.vectors_of(own, k, name, 0, d + 1).select(name, F.col("vec")[0].alias("bias"), F.slice("vec", 2, d).alias("vec")) for k, name in ((strata.USER, "userId"), (strata.MOVIE, "movieId")))
        return {"mean": mean, "users": u, "movies": m}

    history, losses, kept = [], [], Kept(nodes)
    for epoch in range(1, config.epochs + 1):
        after, squares = strata.sweep(kept.now, rows, blocks, config.random_seed + epoch, step)
        kept.replace(after)
        losses.append(float(np.sqrt(squares)))
        if validate and (epoch % config.validation_interval == 0 or epoch == config.epochs):
            history.append((epoch, validate(model_of(kept.now), epoch)))
            best, early = stop_early(history, config.patience)
            kept.hold(epoch, best)
            if early:
                break
    best, early = stop_early(history, config.patience) if history else (epoch, False)
    drop_table(rows)
    return model_of(kept.finish(best)) | {"best": best, "stopped": epoch, "early": early, "losses": losses, "history": history}


class Kept:
    """The table of a training run as it is now, and as it was when it was best; others are dropped as soon as they are neither."""

    def __init__(self, now: DataFrame):
        self.now, self.best, self.step = now, None, None

    def replace(self, after: DataFrame) -> None:
        if self.now is not self.best:
            drop_table(self.now)
        self.now = after

    def hold(self, step: int, best: int) -> None:
        """To be called after a validation: the present table is kept if its step is the best."""
        if step == best:
            if self.best is not None and self.best is not self.now:
                drop_table(self.best)
            self.best, self.step = self.now, step

    def finish(self, best: int) -> DataFrame:
        """The table of the best step, or the last one; only its files stay."""
        if self.best is None or self.step != best:
            return self.now
        if self.now is not self.best:
            drop_table(self.now)
        return self.best


def predict_biased_mf(pairs: DataFrame, model: dict[str, object]) -> DataFrame:
    """pairs (userId, movieId) with score: the predicted rating; pairs without a known user and movie go.

    Blocks of users meet blocks of movies, so what moves are the pairs as they are and a block's vectors once for each task that
    asks for it; in two joins every pair would take a vector along.
    """
    users, movies = (model[k].select(F.lit(k).alias("__side"), F.col(name).cast("long").alias("__id"), "bias", "vec") for k, name in (("users", "userId"), ("movies", "movieId")))
    blocks, mean, columns = strata.blocks_for(users.count(), movies.count()), model["mean"], pairs.columns
    parts = max(1, math.ceil(pairs.count() / blocks**2 / ROWS_AT_ONCE))

    def block(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def run(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        score, known, sides = np.full(rows.num_rows, mean), np.ones(rows.num_rows, bool), []
        for side, name in (("users", "userId"), ("movies", "movieId")):
            own = nodes.filter(pc.equal(nodes["__side"], side)).sort_by("__id")
            if not own.num_rows:
                return rows.select(columns).slice(0, 0).append_column("score", pa.array([], pa.float64()))
            ids, asked = own["__id"].to_numpy(), rows[name].to_numpy()
            at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            known &= ids[at] == asked
            score += own["bias"].to_numpy()[at]
            sides.append((own["vec"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1), at))
        (x, i), (y, j) = sides
        product = np.zeros(rows.num_rows)
        for k in range(x.shape[1]):
            product += x[i, k] * y[j, k]
        return rows.select(columns).append_column("score", pa.array(score + product)).filter(pa.array(known))

    at = ["__i", "__j", "__part"]
    asked = pairs.where("userId is not null and movieId is not null").select("*", block("userId").alias("__i"), block("movieId").alias("__j"), F.pmod(F.xxhash64("userId", "movieId"), F.lit(parts)).cast("int").alias("__part"))
    sent = users.select("*", block("__id").alias("__i"), every(blocks).alias("__j")).unionAll(movies.select("*", every(blocks).alias("__i"), block("__id").alias("__j"))).withColumn("__part", every(parts))
    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())])
    return asked.groupBy(*at).cogroup(sent.select("__side", "__id", "bias", "vec", *at).groupBy(*at)).applyInArrow(run, schema)


def _with_vectors(triples: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, i, j, xu, away, gap): away points from the negative's vector to the positive's, gap is the difference of both scores."""
    out = triples
    for key in ("u", "i", "j"):
        out = out.join(vectors.select(F.col("node").alias(key), F.col("vec").alias(f"x{key}")), key)
    out = out.withColumn("away", F.zip_with("xi", "xj", lambda a, b: a - b))
    return out.select("u", "i", "j", "xu", "away", dot("xu", "away").alias("gap"))


def pairwise_gradient(triples: DataFrame, vectors: DataFrame, size: int, spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, pos, value): gradient of the mean ranking loss in the embeddings behind propagated vectors.

    spread: propagation of components, which is linear and symmetric, so it carries gradients back as it carries vectors on.
    """
    pull = -1 / (1 + F.exp(F.col("gap"))) / F.lit(float(size))
    rows = _with_vectors(triples, vectors).withColumn("g", pull)
    scaled = F.array(
        F.struct(F.col("u").alias("node"), F.zip_with("away", F.array_repeat("g", F.size("away")), lambda x, g: x * g).alias("d")),
        F.struct(F.col("i").alias("node"), F.zip_with("xu", F.array_repeat("g", F.size("xu")), lambda x, g: x * g).alias("d")),
        F.struct(F.col("j").alias("node"), F.zip_with("xu", F.array_repeat("g", F.size("xu")), lambda x, g: -x * g).alias("d")),
    )
    parts = rows.select(F.explode(scaled).alias("s")).select("s.node", F.posexplode("s.d").alias("pos", "value"))
    return spread(parts.groupBy("node", "pos").agg(F.sum("value").alias("value")))


def train_graph_model(edges: DataFrame, config: GraphConfig, validate: Callable[[DataFrame, DataFrame, int], tuple[float, float]] | None = None) -> dict[str, object]:
    """users (userId, vec), movies (movieId, vec), losses (before, after) on fixed triples, best, stopped, early, history.

    Steps of batch_size triples are taken in strata, many in one task; see strata. A sweep uses every like once and ends at the
    next validation; then what vectors moved by is spread over the graph. validate gets the propagated vectors of both sides
    before the first step (step 0), every validation_interval steps and after the last; the best by the mean of its last
    `smoothing` results is kept, and training ends after `patience` results without a better one. Only the tables behind the
    result stay. ValueError if there are no edges, an id is missing, or every user likes every movie.
    """
    likes = shared_table(edges.select(F.col("userId").cast("long").alias("a"), F.col("movieId").cast("long").alias("b")).distinct(), "likes")
    n, missing, users, movies = likes.agg(F.count(F.lit(1)), F.count_if(F.col("a").isNull() | F.col("b").isNull()), F.count_distinct("a"), F.count_distinct("b")).first()
    if not n or missing or n == users * movies:
        drop_table(likes)
        raise ValueError("edges are empty, lack ids, or leave no movie that isn't liked")
    d, layers, blocks = config.width, config.layers, strata.blocks_for(users, movies, config.block_nodes)
    each = math.ceil(n / config.batch_size) if config.batch_size else 1  # steps of a whole sweep
    rows = likes.withColumn("y", F.lit(0.0))
    first = shared_table(strata.start_nodes(_sides(likes), d, config.random_seed, 0.1, lambda x: x), "embeddings")
    spread = strata.Spread(shared_table(strata.weighted_edges(likes), "weights"), strata.spread_blocks(blocks)) if layers else None
    mean_of = [1 / (layers + 1)] * (layers + 1)
    twice = np.convolve(mean_of, mean_of).tolist()
    begun = spread.polynomial(first, mean_of) if layers else first
    nodes = shared_table(strata.changed(begun, _with_zeros(d, again=layers > 0)), "parameters")
    for table in [first, *([begun] if layers else [])]:
        drop_table(table)

    def both(own: DataFrame) -> tuple[DataFrame, DataFrame]:
        return strata.vectors_of(own, strata.USER, "userId", 0, d), strata.vectors_of(own, strata.MOVIE, "movieId", 0, d)

    def loss(own: DataFrame) -> float:
        return strata.met_loss(own, rows, d, blocks, config.random_seed + 2, strata.pairwise_loss(d))

    def propagated(after: DataFrame) -> DataFrame:
        moved = shared_table(strata.changed(after, lambda s: s[:, :d] - s[:, 3 * d + 1 :]), "moved")

        def apply(s: np.ndarray, z: np.ndarray) -> np.ndarray:
            s[:, :d] = s[:, 3 * d + 1 :] = s[:, 3 * d + 1 :] + z
            return s

        spread_out = spread.polynomial(moved, twice)
        out = shared_table(strata.joined(after, spread_out, apply), "parameters")
        for table in (moved, spread_out, after):
            drop_table(table)
        return out

    before, history, kept, t, k, early = loss(nodes), [], Kept(nodes), 0, 0, False
    while True:
        if validate and (t % config.validation_interval == 0 or t == config.steps):
            history.append((t, validate(*both(kept.now), t)))
            best, early = stop_early(history, config.patience, config.smoothing)
            kept.hold(t, best)
        if early or t == config.steps:
            break
        stop = min(config.steps, t + each, (t // config.validation_interval + 1) * config.validation_interval if validate else config.steps)
        k += 1
        after, _ = strata.sweep(kept.now, rows, blocks, config.random_seed + 1000 * k, strata.pairwise_steps(d, config.batch_size, config.learning_rate, config.decay, (stop - t) / each))
        kept.replace(propagated(after) if layers else after)
        t = stop
    best = stop_early(history, config.patience, config.smoothing)[0] if history else t
    own = kept.finish(best)
    after = loss(own)
    for table in [likes, *([spread.edges] if layers else [])]:
        drop_table(table)
    users, movies = both(own)
    return {"users": users, "movies": movies, "losses": (before, after), "best": best, "stopped": t, "early": early, "history": history}


def train_graph_models(edges: DataFrame, configs: dict[str, GraphConfig]) -> DataFrame:
    """(run, kind, id, vec, loss_before, loss_after): all runs of a grid, one after the other, each over the whole cluster."""
    out = None
    for run, config in configs.items():
        fit = train_graph_model(edges, config)
        before, after = fit["losses"]
        both = fit["users"].select(F.lit("user").alias("kind"), F.col("userId").alias("id"), "vec").unionAll(fit["movies"].select(F.lit("movie"), "movieId", "vec"))
        rows = both.select(F.lit(run).alias("run"), "kind", "id", "vec", F.lit(before).alias("loss_before"), F.lit(after).alias("loss_after"))
        out = rows if out is None else out.unionAll(rows)
    return out
