"""Command-line runs of the two jobs (no scheduler, no server).

    python -m cadenza.cli ingest  --inbox DIR --out DIR --checkpoint DIR [--every "1 minute"]
    python -m cadenza.cli score   --good DIR --table DIR --ledger DIR --checkpoint DIR
                                  (--model PATH | --coefficients FILE.json) [--every "2 minutes"]
    python -m cadenza.cli rescore --good DIR --table DIR --ledger DIR
                                  (--model PATH | --coefficients FILE.json)

Without ``--every`` a stream processes what is there now and stops
(``availableNow``). ``--coefficients`` is a JSON object
``{"intercept": x, "features": {"energy": w, ...}, "category": ["genre", {"pop": w}]}``.
"""

from __future__ import annotations

import argparse
import json
import sys


def _scorer(args):
    if args.model:
        from pyspark.ml import PipelineModel

        from cadenza.operators.scoring import score
        model = PipelineModel.load(args.model)
        return lambda df: score(df, model, out="predicted_popularity")
    from cadenza.operators.scoring import linear_score
    with open(args.coefficients) as f:
        spec = json.load(f)
    cat = tuple(spec["category"]) if spec.get("category") else None
    expr = linear_score(spec["features"], spec.get("intercept", 0.0), cat)
    return lambda df: df.withColumn("predicted_popularity", expr)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="cadenza")
    sub = p.add_subparsers(dest="cmd", required=True)
    ing = sub.add_parser("ingest")
    ing.add_argument("--inbox", required=True)
    ing.add_argument("--out", required=True)
    ing.add_argument("--checkpoint", required=True)
    ing.add_argument("--max-files", type=int, default=1)
    ing.add_argument("--every")
    for name in ("score", "rescore"):
        s = sub.add_parser(name)
        s.add_argument("--good", required=True)
        s.add_argument("--table", required=True)
        s.add_argument("--ledger", required=True)
        g = s.add_mutually_exclusive_group(required=True)
        g.add_argument("--model")
        g.add_argument("--coefficients")
        if name == "score":
            s.add_argument("--checkpoint", required=True)
            s.add_argument("--max-files", type=int, default=10)
            s.add_argument("--every")
    args = p.parse_args(argv)

    from cadenza.session import get_session
    from cadenza.streaming import streams as ST
    spark = get_session()
    if args.cmd == "ingest":
        ST.start_ingest(spark, args.inbox, args.out, args.checkpoint, args.max_files, args.every).awaitTermination()
    elif args.cmd == "score":
        ST.start_scoring(spark, args.good, args.table, args.ledger, args.checkpoint, _scorer(args),
                         args.max_files, args.every).awaitTermination()
    else:
        n = ST.score_new_files(spark, args.good, args.table, args.ledger, _scorer(args))
        print(json.dumps({"files_scored": n, "skipped": n == 0}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
