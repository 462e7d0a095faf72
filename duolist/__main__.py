"""Command line: python -m duolist COMMAND --help. Tables are CSV files named as in schema.TABLES; results are Parquet folders."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolist.config import AlsConfig, BiasedMfConfig, GraphConfig, PrepConfig
from duolist.operators import checks, cohorts, evaluation, models, pairs
from duolist.plans import experiments, holdout
from duolist.schema import shared_table
from duolist.sources import imports, sinks, tables


def _config(args: argparse.Namespace) -> PrepConfig:
    return PrepConfig.from_json(args.config) if args.config else PrepConfig()


def _note(spark: SparkSession, report: dict, path: str) -> dict:
    """A report beside a command's tables, readable through Spark wherever the folder lies."""
    sinks.write_table(spark.createDataFrame([(json.dumps(report, default=str),)], "settings string"), path)
    return report


def check(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Data quality of the four tables."""
    return checks.validate_tables(tables.load_all(spark, args.data))


def prepare(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Split, cohorts, edges, catalogue and pairs."""
    made = experiments.prepare(tables.load_table(spark, args.data, "ratings"), tables.load_table(spark, args.data, "movies"), _config(args), args.out)
    return _note(spark, made, f"{args.out}/manifest")


def popularity(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Popular lists against each member's own test likes inside the catalogue, whatever the other has seen."""
    rows, catalog = (spark.read.parquet(f"{args.prepared}/{n}") for n in ("pairs", "warm_catalog"))
    split = shared_table(cohorts.add_temporal_split(tables.load_table(spark, args.data, "ratings"), _config(args)), "split")
    members = cohorts.pair_members(rows).select("userId").distinct()
    lists = shared_table(models.recommend_popular(rows, catalog, cohorts.seen_items(split, members), args.k), "lists")
    relevant = evaluation.relevant_items(cohorts.positive_events(split, "test", members), catalog)
    relevant = cohorts.pair_members(rows).select("pairId", "userId").join(relevant, "userId")
    sinks.write_table(lists, f"{args.out}/lists")
    sinks.write_table(evaluation.pair_metrics(lists, relevant, args.k), f"{args.out}/metrics")
    return _note(spark, evaluation.method_summary(lists, relevant, catalog.count(), args.k).first().asDict(), f"{args.out}/summary")


def select(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The best of a grid of one kind of model on validation, by a JSON object from run names to settings."""
    rows, catalog, edges = (spark.read.parquet(f"{args.prepared}/{n}") for n in ("pairs", "warm_catalog", "train_edges"))
    split = shared_table(cohorts.add_temporal_split(tables.load_table(spark, args.data, "ratings"), _config(args)), "split")
    context = experiments.Context(shared_table(pairs.disjoint_pairs(rows, args.pairs), "pairs"), split, catalog, "validation")
    grid = json.loads(args.grid)
    if args.model == "neighbours":
        best, found = experiments.select_neighbours(context, edges, [(s["width"], s.get("shrinkage", 0.0)) for s in grid.values()], args.weight, args.k)
    elif args.model == "als":
        best, found = experiments.select_als(context, edges, {n: AlsConfig(**s) for n, s in grid.items()}, args.weight, args.k)
    elif args.model == "biased":
        ratings = split.where("split = 'train'").join(edges.select("userId").distinct(), "userId", "left_semi")
        best, found = experiments.select_biased_mf(context, ratings, {n: BiasedMfConfig(**s) for n, s in grid.items()}, (args.weight,), args.k)
    else:
        best, found = experiments.select_graph_model(context, edges, {n: GraphConfig(**s) for n, s in grid.items()}, (args.weight,), args.k)
    return _note(spark, {"best": best, "found": found}, args.out)


def test(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The run that was selected, against popularity on the test period, once; its settings are a JSON object."""
    rows, catalog, edges = (spark.read.parquet(f"{args.prepared}/{n}") for n in ("pairs", "warm_catalog", "train_edges"))
    split = shared_table(cohorts.add_temporal_split(tables.load_table(spark, args.data, "ratings"), _config(args)), "split")
    train = split.where("split = 'train'").join(edges.select("userId").distinct(), "userId", "left_semi")
    chosen = shared_table(pairs.disjoint_pairs(rows, args.pairs), "pairs")
    movies = tables.load_table(spark, args.data, "movies")
    features = shared_table(pairs.pair_features(chosen, train, movies, _config(args)), "features")
    context = experiments.Context(chosen, split, catalog, "test")
    lists = {args.model: experiments.family_lists(context, args.model, edges, train, json.loads(args.settings), args.weight, args.k), "popularity": context.popular(args.k)}
    return experiments.frozen_test(args.out, args.model, context, lists, features, pairs.band_rule(features), json.loads(args.counts), args.k, args.resamples, exploratory=args.exploratory)


def holdout_prepare(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Freeze development and held-out pairs of users that no earlier pair has."""
    ratings, movies = (tables.load_table(spark, args.data, n) for n in ("ratings", "movies"))
    none = spark.createDataFrame([], "userId long")
    earlier = pairs.evaluated_members(spark.read.parquet(f"{args.prepared}/pairs"), disjoint=args.evaluated) if args.prepared else none
    return holdout.prepare(ratings, movies, _config(args), args.out, earlier, args.development, args.held_out)


def holdout_train(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Train and select on the development pairs, then freeze."""
    return holdout.train(spark, args.out, tables.load_table(spark, args.data, "ratings"), GraphConfig(**json.loads(args.settings)), args.width, args.shrinkage, args.k)


def holdout_evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Evaluate the held-out pairs; a second time is an error."""
    return holdout.evaluate_once(spark, args.out, tables.load_table(spark, args.data, "ratings"))


def recommend(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One list for two rating exports."""
    movies, links = (tables.load_table(spark, args.data, n) for n in ("movies", "links"))
    catalog, model = spark.read.parquet(f"{args.prepared}/warm_catalog"), spark.read.parquet(args.items)
    (a, report_a), (b, report_b) = (imports.import_ratings(imports.read_export(spark, f), links, catalog) for f in (args.a, args.b))
    weights = sorted({0.0, args.weight, 1.0})
    if args.model == "neighbours":
        lists = experiments.recommend_for_two_by_neighbours(spark, a, b, movies, catalog, model, args.width, weights, args.k)
    else:
        als = AlsConfig(**json.loads(args.settings)) if args.model == "als" else None
        lists = experiments.recommend_for_two(spark, a, b, movies, catalog, model, weights, args.k, als)
    sinks.write_table(lists, args.out)
    chosen = spark.read.parquet(args.out).where(F.col("conflictWeight") == args.weight).orderBy("rank")
    return {"imports": [report_a, report_b], "list": [r.asDict() for r in _shown(chosen).collect()]}  # k rows


def _shown(lists: DataFrame) -> DataFrame:
    return lists.select("rank", "title", "genres", "qA", "qB", "groupScore", "disagreement")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m duolist", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(f, *needs: str, **optional: object) -> argparse.ArgumentParser:
        one = commands.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        one.set_defaults(run=f)
        one.add_argument("--config", help="JSON file of thresholds")
        for n in ("data", *needs):
            one.add_argument(f"--{n}", required=True)
        for n, default in optional.items():
            one.add_argument(f"--{n.replace('_', '-')}", default=default, type=str if default is None else type(default))
        return one

    command(check)
    command(prepare, "out")
    command(popularity, "prepared", "out", k=10)
    command(select, "prepared", "out", "grid", pairs=100, weight=0.65, k=10).add_argument("--model", required=True, choices=("neighbours", "als", "biased", "graph"))
    tested = command(test, "prepared", "out", "settings", pairs=100, weight=0.65, k=10, counts="[]", resamples=10_000)
    tested.add_argument("--model", required=True, choices=("neighbours", "als", "biased", "graph"))
    tested.add_argument("--exploratory", action="store_true", help="the test period was looked at before")
    command(holdout_prepare, "out", prepared=None, evaluated=500, development=200, held_out=500)
    command(holdout_train, "out", settings="{}", width=50, shrinkage=10.0, k=10)
    command(holdout_evaluate, "out")
    command(recommend, "prepared", "items", "a", "b", "out", settings="{}", width=50, weight=0.0, k=10).add_argument("--model", default="vectors", choices=("vectors", "als", "neighbours"))
    return top


def main(words: list[str] | None = None) -> dict:
    args = parser().parse_args(words)
    spark = SparkSession.builder.appName(f"duolist {args.command}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    report = args.run(spark, args)
    print(json.dumps(report, indent=2, default=str))
    return report


if __name__ == "__main__":
    main()
