"""Commands over tables of a folder: python -m loomwright crawl | recommend | annotate | consensus | query ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomwright")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("recommend", help="rank products for a search term")
    r.add_argument("--products", required=True, help="table with oid and metadata")
    r.add_argument("--history", required=True, help="table with oid, reference_order and trending_order")
    r.add_argument("--term", required=True)
    r.add_argument("--feedback", help="table with oid, rating and irrelevant: ranks are calculated anew with what it predicts")
    r.add_argument("--session", help="folder that keeps what feedback has taught; a new one for each call if not given")
    r.add_argument("--limit", type=int, help="results to keep; all with a positive score if left out")
    a = sub.add_parser("annotate", help="find labels of attributes in texts")
    a.add_argument("--products", required=True, help="table with oid, headline and metadata")
    a.add_argument("--labels", required=True, help="table with attr and label")
    c = sub.add_parser("consensus", help="group items by several clusterings")
    c.add_argument("--labels", required=True, help="table with item, algorithm and label")
    c.add_argument("--threshold", type=float, default=0.35)
    w = sub.add_parser("crawl", help="register the articles of a shop's search from its saved pages")
    w.add_argument("--adapter", required=True)
    w.add_argument("--trend", required=True, help="table with url and html: the search's pages by trend")
    w.add_argument("--reference", required=True, help="the same search's pages in the shop's own order")
    w.add_argument("--products", required=True, help="table with oid and url, which grows")
    w.add_argument("--history", required=True, help="table with oid, product, at, reference_order, trend_order and price, which grows")
    w.add_argument("--at", required=True, help="time of the crawl")
    w.add_argument("--limit", type=int, help="articles to register")
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("--name", required=True)
    q.add_argument("--tables", required=True)
    for s in (r, a, c, w, q):
        s.add_argument("--out", required=True, help="where the result goes, as Parquet")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    read = spark.read.parquet
    if args.command == "recommend":
        from pyspark.sql import functions as F

        from loomwright.functions import text as X
        from loomwright.operators.online import predict_feedback
        from loomwright.plans.recommend import feedback_score, final_score, recommend
        from loomwright.storage import scratch_path

        stop = X.stop_words(spark)
        term = spark.createDataFrame([(args.term,)], "t string").select(X.preprocess(F.col("t"), stop).alias("t")).first()["t"]
        products = read(args.products)
        out = recommend(products.withColumn("seq", F.lit(0)), read(args.history), "oid", term.split(), stop)
        if args.feedback:
            known = read(args.feedback).select("oid", "rating", "irrelevant")
            predicted = predict_feedback(products.select("oid", "metadata").join(known, "oid", "left"), "oid", "metadata", "rating", "irrelevant", args.session or scratch_path(spark, "feedback"))
            out = final_score(feedback_score(out.drop("final_score").join(predicted, "oid")))
        out = out.orderBy(F.desc("final_score"), "oid")
        out = out.limit(args.limit) if args.limit else out
    elif args.command == "annotate":
        from loomwright.plans.annotate import annotated

        out = annotated(read(args.products), read(args.labels), "oid", {"headline": 0, "metadata": 1})
    elif args.command == "crawl":
        from loomwright.plans.crawl import found_articles, register
        from loomwright.storage import replace_table, stored

        out = stored(found_articles(read(args.trend), read(args.reference), args.adapter, args.limit), "found")
        grown, ranks = register(out, read(args.products), read(args.history), args.at)
        replace_table(stored(grown, "products"), args.products)
        replace_table(ranks, args.history)
    elif args.command == "consensus":
        from loomwright.operators import clustering as C

        out = C.linked_items(read(args.labels), "item", "algorithm", "label", 0.2, args.threshold)
    else:
        import loomwright.plans.catalogue  # noqa: F401
        from loomwright.registry import QUERIES

        out = QUERIES[args.name](spark, args.tables)
    out.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    run(SparkSession.builder.appName("loomwright").getOrCreate(), parser().parse_args())
