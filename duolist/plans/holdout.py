"""A frozen experiment below one folder: prepared, trained and selected, and evaluated on held-out pairs once.

Every step checks by digest that the tables of the steps before it are what they were.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolist.config import GraphConfig, PrepConfig
from duolist.operators import cohorts, evaluation, models, pairs
from duolist.plans import experiments
from duolist.schema import shared_table
from duolist.sources import sinks

PREPARED, TRAINED = ("development", "holdout", "edges", "catalog"), ("users", "movies", "neighbours")
#: Methods compared on both sets of pairs.
METHODS = ("popularity", "graph", "neighbours")


def _read(spark: SparkSession, path: str, step: str, parts: tuple[str, ...]) -> tuple[dict[str, DataFrame], dict]:
    """Tables and notes of a step; ValueError if a table has changed."""
    tables, notes = sinks.load_model(spark, f"{path}/{step}", list(parts))
    sinks.verify_frozen(tables, notes["digests"])
    return tables, notes


def prepare(ratings: DataFrame, movies: DataFrame, config: PrepConfig, path: str, excluded: DataFrame, development: int, holdout: int) -> dict[str, object]:
    """Write pairs of users not in excluded, training edges and catalogue; returns the notes. No test event is looked at.

    Users without a like among the edges aren't drawn: no model could have a vector for them.
    """
    split = shared_table(cohorts.add_temporal_split(ratings, config).where("split <> 'test'"), "split")
    stats = shared_table(cohorts.user_split_statistics(split), "statistics")
    edges = cohorts.training_edges(split, cohorts.training_users(stats, config))
    catalog = shared_table(cohorts.warm_catalog(edges, config), "catalog")
    edges = shared_table(cohorts.edges_of_catalog(edges, catalog), "edges")
    made = experiments.prepare_holdout(stats, split.where("split = 'train'"), movies, config, excluded, development, holdout, edges.select("userId").distinct())
    tables = {"development": made["development"], "holdout": made["holdout"], "edges": edges, "catalog": catalog}
    tables = {n: shared_table(df, n) for n, df in tables.items()}
    both = tables["development"].unionByName(tables["holdout"])
    notes = {
        "config": config.to_dict(),
        "rule": made["rule"],
        "similarity": pairs.describe(both, "genreSimilarity").first().asDict(),
        "pairs_with_correlation": both.where("ratingCorrelation is not null").count(),
        "members": cohorts.count_members(both).first().members,
        "digests": sinks.freeze(tables),
    }
    sinks.save_model(tables, notes, f"{path}/prepared")
    return notes


def _lists(context: experiments.Context, fitted: dict[str, DataFrame], edges: DataFrame, width: int, k: int) -> DataFrame:
    members = cohorts.pair_members(context.pairs).select("userId").distinct()
    scores = models.neighbour_scores(edges.join(members, "userId", "left_semi"), fitted["neighbours"], width)
    columns = ["method", "pairId", "userA", "userB", "rank", "movieId"]
    made = [context.popular(k), context.by_vectors(fitted["users"], fitted["movies"], "graph", 0.0, k), context.by_scores(scores, "neighbours", 0.0, k)]
    out = made[0].select(columns)
    for one in made[1:]:
        out = out.unionByName(one.select(columns))
    return shared_table(out, "lists")


def _evaluate(context: experiments.Context, lists: DataFrame, k: int) -> tuple[DataFrame, dict[str, dict]]:
    """(metrics of all methods, each method's summary)."""
    metrics, summaries = None, {}
    for m in METHODS:
        own = lists.where(F.col("method") == m)
        one = evaluation.pair_metrics(own, context.relevant, k).withColumn("method", F.lit(m))
        metrics = one if metrics is None else metrics.unionByName(one)
        summaries[m] = evaluation.require_evaluated(context.evaluate(own, k)).first().asDict()
    return shared_table(metrics, "metrics"), summaries


def train(spark: SparkSession, path: str, ratings: DataFrame, config: GraphConfig, width: int = 50, shrinkage: float = 10.0, k: int = 10) -> dict[str, object]:
    """Train on the frozen edges, stop by the development pairs' validation period, save the models; returns the notes.

    A graph model whose best check is the last that its steps allow might have gone on improving: its status says so, and
    evaluate_once refuses it.
    """
    frozen, notes = _read(spark, path, "prepared", PREPARED)
    prep = PrepConfig(**notes["config"])
    split = shared_table(cohorts.add_temporal_split(ratings, prep).where("split <> 'test'"), "split")
    context = experiments.Context(frozen["development"], split, frozen["catalog"], "validation")

    def check(users: DataFrame, movies: DataFrame, _: int) -> tuple[float, float]:
        return evaluation.selection_key(evaluation.require_evaluated(context.evaluate(context.by_vectors(users, movies, "graph", 0.0, k), k)).first().asDict(), k)

    fit = models.train_graph_model(frozen["edges"], config, check)
    fitted = {"users": fit["users"], "movies": fit["movies"], "neighbours": models.item_neighbours(frozen["edges"], width, shrinkage)}
    fitted = {n: shared_table(df, n) for n, df in fitted.items()}
    _, summaries = _evaluate(context, _lists(context, fitted, frozen["edges"], width, k), k)
    made = {
        "status": "frozen" if fit["best"] < config.steps else "best check at the end of the steps: train for longer",
        "best": fit["best"],
        "stopped": fit["stopped"],
        "early": fit["early"],
        "width": width,
        "k": k,
        "validation": summaries,
        "digests": sinks.freeze(fitted),
    }
    sinks.save_model(fitted, made, f"{path}/trained")
    return made


def evaluate_once(spark: SparkSession, path: str, ratings: DataFrame, resamples: int = 10_000) -> dict[str, object]:
    """The held-out pairs' test period, looked at once: FileExistsError if it was before, RuntimeError if nothing is frozen.

    The look is claimed before any event of the test period is read, by a file that only one run can create. A run that breaks off
    afterwards has had its look: the claim stays.
    """
    frozen, notes = _read(spark, path, "prepared", PREPARED)
    fitted, chosen = _read(spark, path, "trained", TRAINED)
    if chosen["status"] != "frozen":
        raise RuntimeError(chosen["status"])
    sinks.claim(spark, f"{path}/evaluation-claim", json.dumps({"application": spark.sparkContext.applicationId, "user": spark.sparkContext.sparkUser()}))
    k = chosen["k"]
    split = shared_table(cohorts.add_temporal_split(ratings, PrepConfig(**notes["config"])), "split")
    context = experiments.Context(frozen["holdout"], split, frozen["catalog"], "test")
    lists = _lists(context, fitted, frozen["edges"], chosen["width"], k)
    metrics, summaries = _evaluate(context, lists, k)
    bands = evaluation.subgroup_summary(metrics, pairs.similarity_bands(frozen["holdout"], notes["rule"]), "similarityBand", k)
    compared = experiments.compare_methods(metrics, [("graph", "popularity"), ("neighbours", "popularity"), ("graph", "neighbours")], [f"minimumNDCG@{k}", f"averageNDCG@{k}"], resamples)
    report = {"methods": summaries, "coverage": context.coverage().first().asDict(), "bands": [r.asDict() for r in bands.collect()], "compared": [r.asDict() for r in compared.collect()]}
    sinks.save_model({"lists": lists, "metrics": metrics}, report, f"{path}/evaluated")
    return report
