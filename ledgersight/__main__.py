"""Command line: python -m ledgersight JOB --data DIR --out DIR [options]."""

import argparse

from . import jobs
from .operators.lineage import discard_stored
from .plans import reports
from .session import build_session


def main(argv=None):
    parser = argparse.ArgumentParser(prog="ledgersight")
    parser.add_argument("job", choices=[*jobs.VELOCITY_RUNS, "single", "stacked", "full",
                                        "class-report", "report", "compare"])
    parser.add_argument("--data", default="data")
    parser.add_argument("--out", required=True)
    parser.add_argument("--scale", type=float, default=1.0, help="share of the preset iterations")
    parser.add_argument("--seeds", type=int, help="use only the first N seeds")
    parser.add_argument("--predictions", nargs="*", default=[], metavar="NAME=PATH")
    parser.add_argument("--master", help="Spark master, when not set by spark-submit")
    args = parser.parse_args(argv)
    spark = build_session(f"ledgersight {args.job}", args.master)
    files = dict(item.split("=", 1) for item in args.predictions)
    try:
        if args.job in jobs.VELOCITY_RUNS:
            jobs.velocity_run(spark, args.data, args.out, args.job, args.scale, args.seeds)
        elif args.job == "single":
            jobs.single_run(spark, args.data, args.out, args.scale)
        elif args.job == "stacked":
            jobs.stacked_run(spark, args.data, args.out, args.scale, args.seeds)
        elif args.job == "full":
            jobs.full_run(spark, args.data, args.out, scale=args.scale)
        elif args.job == "class-report":
            jobs.class_report_run(spark, args.data, args.out)
        elif args.job == "report":
            reports.write_prediction_report(spark, files, args.out)
        else:
            first, second = list(files.values())[:2]
            jobs.compare_run(spark, args.data, args.out, first, second).show()
    finally:
        discard_stored(spark)


if __name__ == "__main__":
    main()
