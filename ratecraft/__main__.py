"""Batch entry points, for ``spark-submit`` or ``python -m ratecraft``.

  prepare   --ratings TEXT --out TABLE                  parse once, write bucket-partitioned Parquet
  train     --table TABLE [--personal TEXT] --model DIR [--search [--ranks-out OUT]] [--metrics OUT]
  recommend --model DIR --items TEXT --table TABLE [--personal TEXT] [--users IDS] --out OUT [--n 10] [--min-ratings 25]
  score     --model DIR --requests CSV --items TEXT --table TABLE --out OUT
  refresh   --table TABLE (--new TEXT | --posted TABLE) --items TEXT --model DIR --out OUT [--n 10] [--fold-in OLD]
  ingest    --posted DIR --out TABLE --checkpoint DIR [--replay-hours H]   add posted ratings (availableNow)

``--users`` is a text path with a user id a line, ``--requests`` one with a
``user,item`` pair a line. ``refresh --posted`` reads the table that ``ingest``
writes; ``--fold-in`` names a saved model whose item vectors are kept, so that
only the vectors of the new ratings' users are solved.
``--blocks`` (train, refresh) sets the ALS block count.
Paths are any Hadoop-readable location. Outputs are written by executors;
the driver only ever holds single-row results.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("ratecraft").getOrCreate()
    from .session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return spark


def _training(spark, table, personal):
    from .operators.sets import training_union
    from .plans.prepare import read_split
    from .sources import text
    tr = read_split(spark, table, "train")
    if personal:
        tr = training_union(tr, text.require_nonempty(
            text.load_positive_ratings(text.read_lines(spark, personal)), "personal ratings"))
    return tr


def _ints(lines, *names):
    """Comma-separated int columns of text lines; a bad one fails the job."""
    from .functions.parsing import int_field, py_strip
    f = F.split(py_strip("value"), ",")
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
    return lines.select(*[F.coalesce(int_field(f, k + 1), bad).alias(c)
                          for k, c in enumerate(names)])


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="ratecraft")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("--ratings", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--mode", default="failfast", choices=["failfast", "quarantine"])
    a = sub.add_parser("train")
    a.add_argument("--table", required=True)
    a.add_argument("--personal")
    a.add_argument("--model", required=True)
    a.add_argument("--search", action="store_true")
    a.add_argument("--ranks-out")
    a.add_argument("--blocks", type=int)
    a.add_argument("--metrics")
    a = sub.add_parser("recommend")
    a.add_argument("--model", required=True)
    a.add_argument("--items", required=True)
    a.add_argument("--table", required=True)
    a.add_argument("--personal")
    a.add_argument("--users")
    a.add_argument("--out", required=True)
    a.add_argument("--n", type=int, default=10)
    a.add_argument("--min-ratings", type=int, default=25)
    a = sub.add_parser("score")
    for name in ("--model", "--requests", "--items", "--table", "--out"):
        a.add_argument(name, required=True)
    a = sub.add_parser("refresh")
    a.add_argument("--table", required=True)
    g = a.add_mutually_exclusive_group(required=True)
    g.add_argument("--new")
    g.add_argument("--posted")
    a.add_argument("--blocks", type=int)
    a.add_argument("--fold-in")
    a.add_argument("--items", required=True)
    a.add_argument("--model", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--n", type=int, default=10)
    a = sub.add_parser("ingest")
    a.add_argument("--posted", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--replay-hours", type=float)
    a.add_argument("--mode", default="failfast", choices=["failfast", "quarantine"])
    args = p.parse_args(argv)

    spark = _session()
    from . import api
    from .plans import prepare, train
    from .sources import sinks, text

    if args.cmd == "prepare":
        prepare.write_ratings_table(text.read_lines(spark, args.ratings), args.out, args.mode)
    elif args.cmd == "train":
        training = _training(spark, args.table, args.personal)
        heldout = prepare.read_ratings_table(spark, args.table).where(F.col("bucket") >= 6)
        from .functions.splits import split_label
        heldout = heldout.withColumn("split", split_label("bucket"))
        blocks = args.blocks or train.BLOCKS
        if args.search:
            results, _, model = train.rank_search(
                training, heldout.where(F.col("split") == "validation"), blocks=blocks)
            if args.ranks_out:
                results.write.mode("overwrite").json(args.ranks_out)
            if model is None:
                raise SystemExit("no rank has a validation error: no held-out row has both its user"
                                 " and its item in training")
        else:
            model = train.fit(training, blocks=blocks)
        train.save(model, args.model)
        if args.metrics:
            train.heldout_rmse(model, heldout).write.mode("overwrite").json(args.metrics)
    elif args.cmd == "recommend":
        model = train.load(args.model)
        ratings = prepare.read_ratings_table(spark, args.table)
        items = api.load_items(spark, args.items)
        counts = api.item_stats(ratings).select("item_id", "n_ratings")
        users = (_ints(text.read_lines(spark, args.users), "user_id") if args.users
                 else train.factors(model)[0].select("user_id"))
        rated = ratings.select("user_id", "item_id")
        if args.personal:
            rated = rated.unionByName(text.load_positive_ratings(
                text.read_lines(spark, args.personal)).select("user_id", "item_id"))
        recs = api.top_ratings(model, users, items, counts, args.n, args.min_ratings,
                               rated=rated)
        sinks.write_report(recs, args.out)
    elif args.cmd == "score":
        ratings = prepare.read_ratings_table(spark, args.table)
        counts = api.item_stats(ratings).select("item_id", "n_ratings")
        requests = _ints(text.read_lines(spark, args.requests), "user_id", "item_id").distinct()
        scored = api.score_requests(train.load(args.model), requests,
                                    api.load_items(spark, args.items), counts)
        sinks.write_report(scored, args.out)
    elif args.cmd == "refresh":
        from .streaming.ingest import read_posted_table
        history = prepare.read_ratings_table(spark, args.table)
        new = (read_posted_table(spark, args.posted) if args.posted
               else text.parse_ratings(text.read_lines(spark, args.new)))
        items = api.load_items(spark, args.items)
        if args.fold_in:
            _, recs = api.fold_in_ratings(train.load(args.fold_in), history, new, items, args.n, path=args.model)
        else:
            model, recs = api.add_ratings(history, new, items, args.n, blocks=args.blocks or train.BLOCKS)
            train.save(model, args.model)
        sinks.write_report(recs, args.out)
    elif args.cmd == "ingest":
        from .streaming import ingest_posted
        ingest_posted(spark, args.posted, args.out, args.checkpoint, args.mode, replay_hours=args.replay_hours)
    return 0


if __name__ == "__main__":
    sys.exit(main())
