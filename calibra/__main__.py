"""Command line: the study's batch steps as Spark jobs.

    python -m calibra audit --jsonl-dir RAW --stamp S --models m1 m2 m3 --out OUT
    python -m calibra audit --csv results.csv --models m1 m2 --out OUT
    python -m calibra dry-run --bank bank.json --models m1 m2 --trials 5
    python -m calibra remaining --bank bank.json --done RAW/*.jsonl --models m1 --trials 5 --out OUT
    python -m calibra supplement --pool pool.parquet --original bank.json --out OUT

Paths may be local or on shared storage.  Under spark-submit the session's
own settings (master, checkpoint folder, shuffle partitions) are used.
"""

from __future__ import annotations

import argparse
import json
import sys

from calibra.schemas import BANK_SCHEMA, RESPONSE_V1_SCHEMA, RESPONSE_V2_SCHEMA


def _spark():
    from pyspark.sql import SparkSession

    from calibra.session import ensure_checkpoint_dir, ship_package
    spark = SparkSession.builder.appName("calibra").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="calibra")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("audit", help="score once and write every calibration table")
    a.add_argument("--jsonl-dir")
    a.add_argument("--stamp")
    a.add_argument("--csv")
    a.add_argument("--parquet")
    a.add_argument("--models", nargs="+")
    a.add_argument("--n-bootstrap", type=int, default=2000)
    a.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    a.add_argument("--out", required=True)
    d = sub.add_parser("dry-run", help="calls, cost and hours per model for a bank")
    d.add_argument("--bank", required=True)
    d.add_argument("--models", nargs="+", required=True)
    d.add_argument("--trials", type=int, default=5)
    r = sub.add_parser("remaining", help="planned cells not yet collected")
    r.add_argument("--bank", required=True)
    r.add_argument("--done", nargs="+", required=True)
    r.add_argument("--models", nargs="+", required=True)
    r.add_argument("--trials", type=int, default=5)
    r.add_argument("--out", required=True)
    s = sub.add_parser("supplement", help="content-disjoint stratified supplement bank")
    s.add_argument("--pool", required=True)
    s.add_argument("--original", required=True)
    s.add_argument("--per-cell", type=int, default=40)
    s.add_argument("--seed", type=int, default=43)
    s.add_argument("--out", required=True)
    args = ap.parse_args(argv)
    spark = _spark()

    if args.cmd == "audit":
        from calibra.plans.audit import run_audit
        from calibra.sources import readers as RD
        if args.jsonl_dir:
            raw = RD.read_jsonl_dir(spark, args.jsonl_dir, args.stamp, args.models, RESPONSE_V2_SCHEMA)
        elif args.csv:
            raw = RD.read_results_csv(spark, args.csv, RESPONSE_V1_SCHEMA)
        else:
            raw = spark.read.parquet(args.parquet)
        meta = run_audit(spark, raw, args.out, models=args.models, n_boot=args.n_bootstrap, fmt=args.format)
        print(json.dumps(meta, default=str))
    elif args.cmd == "dry-run":
        from calibra.operators import ops as OPS
        from calibra.sources.readers import read_bank_json
        plan = OPS.collection_plan(read_bank_json(spark, args.bank, BANK_SCHEMA), args.models, args.trials)
        for row in OPS.dry_run_estimate(plan).collect():
            print(json.dumps(row.asDict()))
    elif args.cmd == "remaining":
        from calibra.operators import ops as OPS
        from calibra.sources.readers import read_bank_json
        plan = OPS.collection_plan(read_bank_json(spark, args.bank, BANK_SCHEMA), args.models, args.trials)
        # a line cut off by a crash counts as not done
        done = spark.read.schema(RESPONSE_V2_SCHEMA).option("mode", "DROPMALFORMED").json(args.done)
        OPS.remaining_work(plan, done).write.mode("overwrite").parquet(args.out)
    elif args.cmd == "supplement":
        from calibra.operators import bank as B
        from calibra.sources.readers import read_bank_json
        pool = spark.read.parquet(args.pool)
        B.require_columns(pool, ["question", "subject", "choices", "answer"])
        if "doc_id" not in pool.columns:
            from pyspark.sql import functions as F
            pool = pool.withColumn("doc_id", F.xxhash64("subject", "question"))
        sup = B.build_supplement(pool, read_bank_json(spark, args.original, BANK_SCHEMA), args.per_cell, args.seed)
        sup.select(*B.BANK_COLS).write.mode("overwrite").json(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
