"""python -m ledgerloom.streaming.inspect OUTPUT_ROOT: what the lake holds, as one JSON object."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import metrics
from ledgerloom.streaming import lake, sinks


def summary(spark: SparkSession, output_root: str) -> str:
    """Rows and distinct ids of each table, rejections by code, and the totals of the metrics over all days."""
    frames: dict[str, DataFrame] = {}
    for name, ids in (("payments", ("event_id", "payment_id")), ("decisions", ("event_id", "decision_id"))):
        if (rows := lake.read_table(spark, output_root, name)) is not None:
            frames[name] = rows.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in ids])
    if (rejected := lake.read_table(spark, output_root, "quarantine")) is not None:
        frames["quarantine"] = rejected.select(F.explode("error_codes").alias("error_code")).groupBy("error_code").agg(F.count("*").alias("rows")).orderBy("error_code")
    if (deltas := lake.read_deltas(spark, output_root)) is not None:
        totals = metrics.inspection(deltas).filter(~F.col("section").endswith(".merchant"))
        frames["metrics"] = totals.orderBy("section", "member")
    return sinks.json_summary(frames)


def main(arguments: list[str]) -> int:
    if len(arguments) != 1:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("ledgerloom-inspect").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(summary(spark, arguments[0]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
