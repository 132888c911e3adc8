"""python -m weftline COMMAND

list                                    all queries
run QUERY SF_DIR [OUT]                  one of them, shown or written as Parquet
explain QUERY SF_DIR                    its plan
predict PATCH_ID SF_DIR                 patches most likely linked with one
train SF_DIR OUT                        a boosted ranker from the links of a folder of tables, kept with what it was trained for
rank SF_DIR OUT [--model PATH]          the model's ranking, refined by retrieval, of every patch whose number is divisible by 50
compare RANKED RANKED                   how many rows (q, n) of each query two rankings share, both Parquet
diagnose SF_DIR                         what windows cover, pools recover, and which stage holds recall back
etl ROOT OUT                            a tree of change files to patches (CSV), links (CSV) and counters (JSON) in folders of OUT
hydrate HAND_OFF SF_DIR OUT             the texts that hand-off rows need, as JSON lines
rerank HAND_OFF TEXTS OUT --client M:F  orders by a function that answers prompts
evaluate RANKED TRUTH [OUT]             metrics of a ranking (q, n, rank), both Parquet, shown or written as JSON
"""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .config import Settings
from .operators import evaluation
from .operators.ranking import PLAIN
from .plans import registry
from .schema import embedded, ground_truth
from .session import session
from .sources import changes, files
from .sources.store import read_trees, write_trees


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine({"documents": embedded(spark, sf_dir)}, settings=Settings.from_environment(dict(os.environ)))


def etl(spark: SparkSession, root: str, out: str) -> None:
    found = changes.extracted(changes.read_tree(spark, root))
    links = changes.resolved(changes.links_of(found), found)
    files.write_csv(found.drop("linkages"), f"{out}/patches")
    files.write_csv(links.where("reason = 'ok'").select(F.col("patch_id").alias("source_patch_id"), F.col("target").alias("target_patch_id")).distinct(), f"{out}/links")
    files.write_json(changes.link_stats(links, found), f"{out}/counters")


def rerank(spark: SparkSession, args: argparse.Namespace) -> None:
    module, name = args.client.split(":")
    hand_off, texts = files.read_hand_off(spark, args.hand_off), files.read_texts(spark, args.texts)
    done = Engine({}).rerank(hand_off, texts, getattr(importlib.import_module(module), name), args.client)
    files.write_json(done, args.out)


def _shown(df: DataFrame) -> None:
    df.show(truncate=80)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *words: [p := sub.add_parser(name), *(p.add_argument(w) for w in words)][0]
    add("list")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("query", choices=sorted(registry.queries()))
        p.add_argument("sf_dir")
        if name == "run":
            p.add_argument("out", nargs="?")
    p = add("predict", "patch_id", "sf_dir")
    p.add_argument("--strategy", default="multi_query")
    p.add_argument("--top-k", type=int, default=None)
    p.add_argument("--window", type=float, default=None)
    add("train", "sf_dir", "out")
    add("rank", "sf_dir", "out").add_argument("--model", default=None)
    add("compare", "ranked", "other")
    add("diagnose", "sf_dir")
    add("etl", "root", "out")
    add("hydrate", "hand_off", "sf_dir", "out")
    add("rerank", "hand_off", "texts", "out").add_argument("--client", required=True)
    add("evaluate", "ranked", "truth").add_argument("out", nargs="?")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    spark = session()
    if args.command == "predict":
        _shown(_engine(spark, args.sf_dir).predict("documents", args.patch_id, args.top_k, args.window, args.strategy).orderBy("rank"))
    elif args.command == "rank":
        e = _engine(spark, args.sf_dir)
        ranker = read_trees(spark, args.model) if args.model else PLAIN
        e.rank_ml_to_rag("documents", e.tables["documents"].where("n % 50 = 0").withColumn("q", F.col("n")), ranker).write.parquet(args.out)
    elif args.command == "train":
        e = _engine(spark, args.sf_dir)
        write_trees(spark, e.train("documents", ground_truth(spark, args.sf_dir)), args.out, window_days=e.settings.window_days, top_k=e.settings.top_k)
    elif args.command == "compare":
        _shown(Engine({}).compare(spark.read.parquet(args.ranked), spark.read.parquet(args.other)).orderBy("q"))
    elif args.command == "diagnose":
        for name in ("window_coverage", "pool_recovery", "ml_vs_rag"):
            print(name)
            _shown(registry.queries()[name](spark, args.sf_dir))
    elif args.command == "etl":
        etl(spark, args.root, args.out)
    elif args.command == "hydrate":
        files.write_json(_engine(spark, args.sf_dir).hydrate("documents", files.read_hand_off(spark, args.hand_off)), args.out)
    elif args.command == "rerank":
        rerank(spark, args)
    elif args.command == "evaluate":
        ks = Settings.from_environment(dict(os.environ)).ks
        found = evaluation.aggregate(evaluation.per_query(spark.read.parquet(args.ranked), spark.read.parquet(args.truth), ks), ks)
        files.write_json(found, args.out) if args.out else _shown(found)
    else:
        df = registry.queries()[args.query](spark, args.sf_dir)
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            df.write.parquet(args.out)
        else:
            _shown(df)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
