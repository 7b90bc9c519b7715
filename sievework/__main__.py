"""Batch jobs.

spark-submit -m sievework prepare --one-liners short.csv --posts posts.csv --out raw
spark-submit -m sievework clean --raw raw/one_liners raw/posts --out processed
"""

from __future__ import annotations

import argparse
import pkgutil

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from sievework.operators.reports import source_summary
from sievework.operators.select import top_n_by_score
from sievework.operators.split import stratified_split
from sievework.plans.clean import clean, write_report
from sievework.sources import readers, writers
from sievework.sources.schemas import ONE_LINERS
from sievework.storage import scratch

POSTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("subreddit.nsfw", T.BooleanType()),
    ]
)


def prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    """Bring the raw sources to one schema and store them."""
    tables = []
    if args.one_liners:

        def one_liners():
            raw = readers.read_corpus_csv(spark, args.one_liners, ONE_LINERS, not args.single_line)
            return readers.unify_single_field_source(raw, "one_liners")

        path = f"{args.out}/one_liners"
        tables.append(writers.write_raw_cached(spark, path, one_liners, args.force))
    if args.posts:

        def posts():
            raw = readers.read_corpus_csv(spark, args.posts, POSTS, not args.single_line)
            if args.top_rows:
                raw = top_n_by_score(raw, args.top_rows, key=("id",))
            return readers.unify_two_field_source(raw, "posts")

        path = f"{args.out}/posts"
        tables.append(writers.write_raw_cached(spark, path, posts, args.force))
    if not tables:
        raise SystemExit("name at least one source")
    source_summary(readers.union_sources(tables)).show(truncate=False)


def run_clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """Clean, tag, split and write; print the funnel."""
    encoder = None if args.no_embed else pkgutil.resolve_name(args.encoder)
    with scratch(spark):
        raw = readers.load_corpus(spark, args.raw, args.limit, readers.read_corpus_parquet)
        result = clean(raw, make_encoder=encoder)
        writers.write_training_jsonl(stratified_split(result.rows), f"{args.out}/training")
        write_report(result, f"{args.out}/clean_report")
        result.funnel().orderBy("step").show(truncate=False)


def main() -> None:
    parser = argparse.ArgumentParser(prog="sievework")
    jobs = parser.add_subparsers(required=True)
    job = jobs.add_parser("prepare")
    job.add_argument("--one-liners")
    job.add_argument("--posts")
    job.add_argument("--out", required=True)
    job.add_argument("--top-rows", type=int, help="keep only the best-scored posts")
    job.add_argument("--force", action="store_true", help="rebuild stored tables")
    job.add_argument("--single-line", action="store_true", help="no cell holds a line break; large files are split")
    job.set_defaults(run=prepare)
    job = jobs.add_parser("clean")
    job.add_argument("--raw", nargs="+", required=True)
    job.add_argument("--out", required=True)
    job.add_argument("--limit", type=int, help="only the first rows of each source")
    job.add_argument("--no-embed", action="store_true", help="tag by keywords only")
    job.add_argument("--encoder", help="module:function that makes an encoder, a function from texts to vectors")
    job.set_defaults(run=run_clean)
    args = parser.parse_args()
    if args.run is run_clean and not (args.no_embed or args.encoder):
        parser.error("give --encoder or --no-embed")
    args.run(SparkSession.builder.appName("sievework").getOrCreate(), args)


if __name__ == "__main__":
    main()
