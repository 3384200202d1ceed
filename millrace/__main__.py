"""Command line: ``python -m millrace PATH...`` prints the analysis as JSON; exit code 1 if the gate fails."""

from __future__ import annotations

import argparse

from millrace import api
from millrace.session import local_session


def main() -> int:
    parser = argparse.ArgumentParser(prog="millrace", description="Analyse source trees.")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--threshold", type=int, default=60, help="confidence from which dead code is reported")
    parser.add_argument("--strict", action="store_true", help="fail on any finding")
    parser.add_argument("--cores", type=int, default=4)
    args = parser.parse_args()
    spark = local_session(args.cores, args.cores)
    spark.sparkContext.setLogLevel("ERROR")
    found = api.analyze_path(spark, args.paths, args.threshold)
    print(api.report(found))
    verdict = api.gate(found, args.strict).first()
    return int(verdict is not None and not verdict["passed"])


if __name__ == "__main__":
    raise SystemExit(main())
