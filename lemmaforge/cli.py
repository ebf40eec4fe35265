"""Command line: lemmatize words, sentences or a CSV with a bank in Parquet.

    python -m lemmaforge.cli --bank DIR [--csv IN OUT] [--no-router] [--cov-thresh X]
                             [--miss-log PATH] [TEXT ...]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.bank import bank_meta, load_bank
from .operators.encode import HashEncoder
from .operators.router import miss_worklist
from .plans.lemmatizer import Lemmatizer
from .sources.files import batch_csv, raw_docs, script_inventory, write_csv, write_worklist


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lemmaforge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("text", nargs="*")
    p.add_argument("--bank", required=True, help="folder written by save_bank, with embeddings")
    p.add_argument("--scripts", help="JSON list of edit scripts")
    p.add_argument("--csv", metavar=("IN", "OUT"), nargs=2)
    p.add_argument("--cov-thresh", default=0.6, type=float)
    p.add_argument("--no-router", help="always take the retrieved lemma", action="store_true")
    p.add_argument("--miss-log")
    a = p.parse_args(argv)
    if not a.text and not a.csv:
        p.error("give texts or --csv")
    spark = SparkSession.builder.appName("lemmaforge").getOrCreate()
    scripts = script_inventory(spark, a.scripts) if a.scripts else None
    bank = load_bank(spark, a.bank)
    lem = Lemmatizer(bank, HashEncoder(bank_meta(bank).first()["embedding_dim"], scripts.count() if scripts else None), scripts, use_router=not a.no_router, cov_thresh=a.cov_thresh)
    if a.csv:
        rows = batch_csv(spark, a.csv[0]).withColumn("row_id", F.monotonically_increasing_id())
        pred = lem.lemmatize(rows)
        write_csv(pred.drop("ret_lemma", "sim", "cov", "in_bank"), a.csv[1], "row_id")
    else:
        pred = lem.annotate(raw_docs(spark, *a.text)).withColumn("row_id", F.col("doc_id") * 1_000_000 + F.col("tok_idx"))
        for r in pred.orderBy("row_id").select("form", "lemma", "pos", "source").collect():
            print(f"{r.form:<20} {r.lemma:<20} {r.pos:<6} {r.source}")
    if a.miss_log:
        print(write_worklist(miss_worklist(lem.misses(pred)), a.miss_log), "misses")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
