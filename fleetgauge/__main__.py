"""Run one report and write it: ``spark-submit`` or ``python -m fleetgauge``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from fleetgauge.params import ROLLING_CHOICE, SCOPES
from fleetgauge.plans.report import all_bands_report, disk_report
from fleetgauge.sources.tables import read_telemetry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fleetgauge", description=__doc__)
    p.add_argument("--tables", required=True, help="folder with the six parquet tables")
    p.add_argument("--out", required=True, help="folder for the report, as parquet")
    p.add_argument("--scope", choices=sorted(SCOPES), default="tbn")
    p.add_argument("--threshold", help="band label; all bands without it")
    p.add_argument("--time-range", default=ROLLING_CHOICE)
    p.add_argument("--year", type=int)
    p.add_argument("--month", type=int)
    p.add_argument("--as-of", type=int, help="epoch seconds; the present without it")
    p.add_argument("--tz", default="UTC")
    p.add_argument("--broadcast-bytes", type=int, help="most bytes of a lookup that is broadcast")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fleetgauge").getOrCreate()
    choice = {
        "time_range": args.time_range,
        "as_of": int(time.time()) if args.as_of is None else args.as_of,
        "year": args.year,
        "month": args.month,
        "tz": args.tz,
        "broadcast_bytes": args.broadcast_bytes,
    }
    tables, policy = read_telemetry(spark, args.tables), SCOPES[args.scope]
    if args.threshold is None:
        report = all_bands_report(tables, policy, **choice)
    else:
        report = disk_report(tables, policy, threshold=args.threshold, **choice)
    report.write.parquet(args.out)


if __name__ == "__main__":
    main()
