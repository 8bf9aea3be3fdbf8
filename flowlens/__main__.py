"""Command line: list / run registered queries, train models, classify flow tables.

  python -m flowlens list
  python -m flowlens query <name> [--sf DIR] [--show N] [--out PATH]
  python -m flowlens train --csv FLOWS.csv --models DIR [--label Label] [--benign BENIGN]
  python -m flowlens classify --csv FLOWS.csv --models DIR --out PATH
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F


def _flows(spark, path: str, label: str = "label"):
    from flowlens.sources.schema import FLOW_COLUMNS, align_names, check_contract, read_flow_csv
    df = check_contract(read_flow_csv(spark, path, labels=(label, "Label")))
    # CSV rows have no key: a row id from the scan (stable for a given file and split)
    df = df.withColumn("flow_id", F.monotonically_increasing_id())
    keys = ["flow_id", *(c for c in df.columns if c in (label, "label") and c not in FLOW_COLUMNS)]
    return align_names(df, FLOW_COLUMNS, keys=keys), FLOW_COLUMNS


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="flowlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--sf", default="/root/testdata/sf0.01")
    q.add_argument("--show", type=int, default=20)
    q.add_argument("--out")
    t = sub.add_parser("train")
    t.add_argument("--csv", required=True)
    t.add_argument("--models", required=True)
    t.add_argument("--label", default="label")
    t.add_argument("--benign", default="BENIGN")
    t.add_argument("--metrics")
    t.add_argument("--small", action="store_true", help="few trees (tests, demos)")
    c = sub.add_parser("classify")
    c.add_argument("--csv", required=True)
    c.add_argument("--models", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--results-csv", help="also write the wide results table as CSV")
    args = ap.parse_args(argv)

    from flowlens.session import get_spark
    if args.cmd == "list":
        from flowlens.plans.registry import ORACLES, QUERIES, load_all
        load_all()
        for n in sorted(QUERIES):
            print(n, "(oracle)" if n in ORACLES else "(rows)")
        return 0
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession() or get_spark()
    if args.cmd == "query":
        from flowlens.plans.registry import QUERIES, load_all
        load_all()
        df = QUERIES[args.name](spark, args.sf)
        if args.out:
            from flowlens.sources.sinks import write_results
            write_results(df, args.out, fmt="parquet")
        else:
            df.show(args.show, truncate=False)
        return 0
    from flowlens import workflows as W
    from flowlens.functions.fixed import MODEL_NAMES
    from flowlens.sources.sinks import load_registry, write_results
    flows, feats = _flows(spark, args.csv, getattr(args, "label", "label"))
    if args.cmd == "train":
        _, metrics = W.train_models(flows, "flow_id", args.label, feats, benign=args.benign,
                                    save_root=args.models, small=args.small)
        metrics.show(truncate=False)
        if args.metrics:
            write_results(metrics, args.metrics)
        return 0
    models, reg = load_registry(spark, args.models, MODEL_NAMES)
    reg.show(truncate=False)
    votes, cons = W.classify_flows(flows, "flow_id", feats, models, MODEL_NAMES)
    write_results(cons, args.out, fmt="parquet")
    write_results(votes, args.out.rstrip("/") + "_votes", fmt="parquet")
    if args.results_csv:
        write_results(W.results_table(flows, "flow_id", feats, models, MODEL_NAMES),
                      args.results_csv)
    return 0


if __name__ == "__main__":
    sys.exit(main())
