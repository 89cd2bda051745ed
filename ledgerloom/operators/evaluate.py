"""Scores against labels: confusion counts, ranking measures, cost and threshold search, histograms, percentiles.

Ranking measures work on one row per distinct score, in order within buckets of scores, so no task sees all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(scored: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1; ratios without cases are 0 and rounded half to even."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.agg(F.count_if(~said & ~true).alias("tn"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(said & true).alias("tp"))

    def ratio(over: Column, under: Column) -> Column:
        return F.bround(F.when(under > 0, over / under).otherwise(0.0), 6)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(tp * 2.0, tp * 2 + fp + fn)})


def ranking(scored: DataFrame, score: str = "score", label: str = "label", buckets: int = 10_000) -> DataFrame:
    """One row: roc_auc (ties count half) and average_precision, of probabilities as they are.

    Scores are counted, then put in order within buckets of their value; what lies above a bucket is a running sum over
    the buckets' totals, the only ordered pass in one task, over ``buckets`` + 1 rows at most.
    """
    counted = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).cast("double").alias("pos"), F.count_if(F.col(label) != 1).cast("double").alias("neg"))
    grouped = counted.withColumn("b", F.least(F.lit(buckets), F.greatest(F.lit(0), F.floor(F.col("s") * buckets))).cast("int"))
    above = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    totals = grouped.groupBy("b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    offsets = totals.select("b", F.coalesce(F.sum("p").over(above), F.lit(0.0)).alias("p_above"), F.coalesce(F.sum("n").over(above), F.lit(0.0)).alias("n_above"))
    down = Window.partitionBy("b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = grouped.withColumns({"pos_in": F.sum("pos").over(down), "neg_in": F.sum("neg").over(down)}).join(F.broadcast(offsets), "b")
    cum_pos, cum_neg = F.col("pos_in") + F.col("p_above"), F.col("neg_in") + F.col("n_above")
    area = F.sum(F.col("neg") * (cum_pos - F.col("pos") / 2))
    precision = F.sum(F.when(F.col("pos") > 0, F.col("pos") * cum_pos / (cum_pos + cum_neg)))
    whole = line.agg(area.alias("area"), precision.alias("ap"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return whole.select(F.when(F.col("p") * F.col("n") > 0, F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(F.col("p") > 0, F.col("ap") / F.col("p")).alias("average_precision"))


def costs(scored: DataFrame, missed: int, false_alarm: int, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold in hundredths, cost) for 0.01 to 0.99: one histogram of the scores, then running sums over 100 rows.

    A score is said to be at or above a threshold of k/100 if its bucket is k or more.
    """
    bucket = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.round(F.col(score) * 100, 9)))).cast("int")
    counted = scored.groupBy(bucket.alias("b")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    every = scored.sparkSession.range(0, 101).select(F.col("id").cast("int").alias("b")).join(F.broadcast(counted), "b", "left").na.fill(0, ["pos", "neg"])
    below, rest = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("b").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cost = F.coalesce(F.sum("pos").over(below), F.lit(0)) * missed + F.sum("neg").over(rest) * false_alarm
    return every.withColumn("cost", cost).filter("b between 1 and 99").select(F.col("b").alias("threshold"), "cost")


def best_threshold(scored: DataFrame, missed: int, false_alarm: int, score: str = "score", label: str = "label") -> DataFrame:
    """The least threshold of least cost, one row."""
    return costs(scored, missed, false_alarm, score, label).orderBy("cost", "threshold").limit(1)


def cumulative_histogram(df: DataFrame, value: str, edges: Sequence[float], by: str) -> DataFrame:
    """(by, edge, n): rows at most each edge, with one for all; one pass, no expansion of the rows."""
    counts = [F.count_if(F.col(value) <= e).alias(f"c{i}") for i, e in enumerate(edges)]
    found = df.groupBy(by).agg(*counts, F.count(value).alias("all"))
    cells = [F.struct(F.lit(str(e)).alias("edge"), F.col(f"c{i}").alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit("+Inf").alias("edge"), F.col("all").alias("n"))]
    return found.select(by, F.inline(F.array(*cells)))


def exact_percentiles(df: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """Interpolated and nearest-rank percentiles of small groups (a group's distinct values are counted, not listed)."""
    cells = []
    for p in shares:
        name = f"p{int(p * 100)}"
        cells += [F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {value})").alias(f"{name}_cont"), F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"{name}_disc")]
    return df.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("least"), *cells, F.max(value).alias("greatest"))


def outcome_shares(df: DataFrame, by: str) -> DataFrame:
    """(by, n, percent): whole percents, halves rounded up, 0 without rows."""
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    # over the few outcomes, not the rows
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counted.withColumn("total", total).select(by, "n", F.when(F.col("total") > 0, F.floor(F.col("n") * 100.0 / F.col("total") + 0.5)).otherwise(0).cast("int").alias("percent"))
