"""Samples of ids by the least hashes, which can be merged, grown and replayed, and the controlled subsets drawn by them.

An id's hash depends on the seed and the id alone. The k ids with the least hashes are a sample without replacement; the sample of a
union lies in the union of samples, a larger sample holds a smaller one, and all that has to be remembered of one is the greatest
hash in it. So a subset that a model was trained on is drawn again from a short manifest, whatever the partitions, and a digest
tells whether the ids are what they were.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duolist.operators.cohorts import require_same
from duolist.operators.statistics import values_at
from duolist.schema import shared_table


def id_hash(seed: int, column: str) -> Column:
    """52 bits of an md5 of the seed and an id, which a double number holds exactly."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))), 1, 13), 16, 10).cast("long")


def draw(ids: DataFrame, key: str, size: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """((key, h) of the `size` ids with the least hashes, manifest). All ids, if there are no more; missing ids don't count.

    The greatest hash of the sample is found by distributed selection, so no task orders or holds the sample.
    """
    rows = shared_table(ids.where(F.col(key).isNotNull()).select(key).distinct().withColumn("h", id_hash(seed, key)), "hashes")
    n = rows.count()
    if size <= 0:
        return rows.limit(0), {"seed": seed, "size": 0, "threshold": -1, "digest": 0}
    threshold = int(values_at(rows.select(F.col("h").cast("double").alias("v")), {size - 1})[size - 1]) if n > size else 2**52
    sample = rows.where(F.col("h") <= threshold)
    held, digest = sample.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(F.col(key).cast("long"))), F.lit(0))).first()
    if held > max(size, 0) and n > size:
        raise ValueError("two ids share a hash; take another seed")
    return sample, {"seed": seed, "size": held, "threshold": threshold, "digest": digest}


def replay(ids: DataFrame, key: str, manifest: dict[str, int]) -> DataFrame:
    """The sample of a manifest, drawn from ids again; ValueError if they no longer give the same."""
    sample = shared_table(ids.where(F.col(key).isNotNull()).select(key).distinct().withColumn("h", id_hash(manifest["seed"], key)).where(F.col("h") <= manifest["threshold"]), "sample")
    held, digest = sample.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64(F.col(key).cast("long"))), F.lit(0))).first()
    if (held, digest) != (manifest["size"], manifest["digest"]):
        raise ValueError(f"the sample of {manifest['size']} ids has changed")
    return sample


def merged(samples: Iterable[DataFrame], key: str, size: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """The sample of a union of tables from their samples, which must be at least `size` large or whole, of the same seed."""
    every = None
    for s in samples:
        every = s.select(key) if every is None else every.unionByName(s.select(key))
    return draw(every, key, size, seed)


def catalog_of(edges: DataFrame) -> DataFrame:
    """(movieId, trainPositiveCount) of a subset's own likes."""
    return edges.select("userId", "movieId").distinct().groupBy("movieId").agg(F.count(F.lit(1)).alias("trainPositiveCount"))


def _subset(edges: DataFrame, chosen: DataFrame, focus: DataFrame, context: DataFrame) -> dict[str, DataFrame]:
    users = shared_table(focus.withColumn("focus", F.lit(True)).unionByName(context.select("userId").withColumn("focus", F.lit(False))), "users")
    kept = shared_table(edges.join(users.select("userId"), "userId", "left_semi"), "edges")
    return {"pairs": chosen, "users": users, "edges": kept, "catalog": shared_table(catalog_of(kept), "catalog")}


def _focus(edges: DataFrame, pairs: DataFrame, pair_limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    chosen = pairs.where(F.col("pairId") < pair_limit)
    focus = shared_table(chosen.select(F.explode(F.array("userA", "userB")).alias("userId")).distinct(), "focus")
    there = edges.select("userId").distinct()
    if not focus.join(there, "userId", "left_anti").isEmpty():
        raise ValueError("some pair members have no edges")
    return chosen, focus, there.join(focus, "userId", "left_anti")


def controlled_subset(edges: DataFrame, pairs: DataFrame, pair_limit: int, user_limit: int, seed: int) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """(pairs, users (userId, focus), edges and catalog of the first pairs' members and as many others as fit; manifest).

    ValueError if members lack edges or are more than user_limit.
    """
    chosen, focus, others = _focus(edges, pairs, pair_limit)
    n = focus.count()
    if n > user_limit:
        raise ValueError("the user limit is below the number of pair members")
    context, manifest = draw(others, "userId", user_limit - n, seed)
    made = _subset(edges, chosen, focus, context)
    return made, {"pair_limit": pair_limit, "context": manifest, "users": made["users"].count(), "edges": made["edges"].count(), "movies": made["catalog"].count()}


def replay_subset(edges: DataFrame, pairs: DataFrame, manifest: dict[str, object], movies: DataFrame | None = None) -> dict[str, DataFrame]:
    """The subset of a manifest from edges and pairs again. ValueError if users, edges or movies are other or others' number has changed.

    movies: those that an earlier model of the subset knows; its catalogue must hold the same.
    """
    chosen, focus, others = _focus(edges, pairs, manifest["pair_limit"])
    made = _subset(edges, chosen, focus, replay(others, "userId", manifest["context"]))
    found = {n: made[t].count() for n, t in (("users", "users"), ("edges", "edges"), ("movies", "catalog"))}
    if changed := [n for n, v in found.items() if v != manifest[n]]:
        raise ValueError(f"the subset has other {', '.join(changed)} than its manifest says")
    if movies is not None:
        require_same(movies, made["catalog"], "movieId", "model and subset")
    return made
