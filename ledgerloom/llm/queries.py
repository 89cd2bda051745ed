"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import encode, packing, quantiles, spans
from ledgerloom.session import materialize
from ledgerloom.tables import clean_id, day_text, table, utc_day

Query = Callable[[SparkSession, str], DataFrame]


#: Groups (100 bytes each) whose answers may be broadcast to their values; more are joined by shuffle.
MAX_GROUPS = 100_000
#: Group and day of every measured value: ``measure`` names table and column, ``member`` the model version or merchant.
_KEYS = ["measure", "member", "day"]


def _values(spark: SparkSession, d: str) -> DataFrame:
    """(measure, member, day, x) of all measures; each table is scanned once."""
    decisions = table(spark, d, "decision_events")
    cells = F.array(*[F.struct(F.lit(f"decision_events.{c}").alias("measure"), F.col(c).cast("double").alias("x")) for c in ("risk_score", "model_probability")])
    scores = decisions.select(F.explode(cells).alias("cell"), F.col("model_version").alias("member"), F.col("event_date").cast("string").alias("day"))
    scores = scores.select("cell.measure", "member", "day", "cell.x")
    amount = F.col("amount_minor").cast("double").alias("x")
    counts = table(spark, d, "payment_status_counts").select(F.lit("payment_status_counts.amount_minor").alias("measure"), clean_id("merchant_id").alias("member"), day_text(utc_day("snapshot_at")).alias("day"), amount)
    events = table(spark, d, "payment_events").select(F.lit("payment_events.amount_minor").alias("measure"), clean_id("merchant_id").alias("member"), F.col("event_date").cast("string").alias("day"), amount)
    return scores.unionByName(counts).unionByName(events)


def p4_daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.build_summaries(_values(spark, d), _KEYS, "x"), _KEYS)


def p4_period(spark: SparkSession, d: str) -> DataFrame:
    daily = materialize(quantiles.build_summaries(_values(spark, d), _KEYS, "x"), "daily")
    keys = ["measure", "member"]
    return quantiles.percentiles(quantiles.combine(daily, keys), keys)


#: Error bound of ``p4_rank_check``, so wide that summaries of the small test data are compressed at every level.
WIDE_ERROR = 0.02


def p4_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer for the whole period, from daily summaries with a wide error bound, keeps its promises.

    ``is_known``: its rank among all values is as near to the asked one as ``rank_error`` says; ``is_bounded``:
    ``rank_error`` is within the bound; ``is_compressed``: the summary kept fewer values than there are.
    """
    keys, values = ["measure", "member"], _values(spark, d)
    daily = materialize(quantiles.build_summaries(values, _KEYS, "x", WIDE_ERROR), "daily")
    period = materialize(quantiles.combine(daily, keys, WIDE_ERROR), "period")
    sized = period.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.size("value") < F.col("n")).alias("is_compressed"))
    answers = quantiles.percentiles(period, keys).join(sized, F.col("measure").eqNullSafe(F.col("_measure")) & F.col("member").eqNullSafe(F.col("_member"))).drop("_measure", "_member")
    asked = answers.groupBy(*keys, "n", "is_compressed").agg(F.collect_list(F.struct("permille", "percentile", "rank_error")).alias("asked"))
    asked = asked.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", "is_compressed", "asked")
    # a row of few answers per group meets the group's values, which are counted before anything is shuffled
    real = values.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    met = real.join(F.broadcast(asked) if asked.count() <= MAX_GROUPS else asked, F.col("measure").eqNullSafe(F.col("_measure")) & F.col("member").eqNullSafe(F.col("_member")))
    cells = met.select(*keys, "n", "is_compressed", "x", F.explode("asked").alias("a")).select(*keys, "n", "is_compressed", "x", "a.*")
    ranks = cells.groupBy(*keys, "n", "is_compressed", "permille", "rank_error").agg(F.count_if(F.col("x") < F.col("percentile")).alias("below"), F.count_if(F.col("x") <= F.col("percentile")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("permille") * F.col("n") / F.lit(1000)))
    off = F.greatest(F.lit(0), F.col("below") + 1 - rank, rank - F.col("upto"))
    return ranks.select(*keys, "n", "permille", (off <= F.col("rank_error")).alias("is_known"), (F.col("rank_error") <= F.greatest(F.lit(1.0), F.col("n") * WIDE_ERROR)).alias("is_bounded"), (F.col("is_compressed") | (F.col("n") < 2 / WIDE_ERROR)).alias("is_compressed"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def _containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(encode.token_counts(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _containers(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_containers(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents placed, containers over the capacity, pieces placed twice, pieces missing, documents cut though they fit."""
    sizes = materialize(encode.token_counts(table(spark, d, "documents")), "sizes")
    placed = materialize(packing.containers(sizes), "placed")
    report = packing.fill_report(placed).select("n_over", (F.col("n_containers") >= F.col("least_containers")).alias("is_possible"))
    twice = placed.groupBy("doc_id", "piece").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_twice"))
    docs = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("n_pieces"))
    checked = sizes.filter("n_tokens > 0").join(docs, "doc_id", "left").agg(
        F.count("placed").alias("n_documents"), F.count_if(~F.col("placed").eqNullSafe(F.col("n_tokens"))).alias("n_incomplete"),
        F.count_if((F.col("n_tokens") <= packing.CAPACITY) & (F.col("n_pieces") > 1)).alias("n_cut"),
    )
    one = F.lit(1).alias("_one")
    return report.select("*", one).join(twice.select("*", one), "_one").join(checked.select("*", one), "_one").drop("_one")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "documents"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return spans.longest_levels(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_daily, p4_period, p4_rank_check, p6_ids, p7_containers, p7_report, p7_invariants, p8_found, p8_shares, p8_levels)}

_VALUES_SQL = """v AS (
  SELECT 'decision_events.risk_score' measure, model_version member, CAST(event_date AS VARCHAR) AS day, CAST(risk_score AS DOUBLE) x FROM decision_events
  UNION ALL SELECT 'decision_events.model_probability', model_version, CAST(event_date AS VARCHAR), model_probability FROM decision_events
  UNION ALL SELECT 'payment_status_counts.amount_minor', nullif(lower(trim(merchant_id, ' ')), ''), strftime(snapshot_at AT TIME ZONE 'UTC', '%Y-%m-%d'), CAST(amount_minor AS DOUBLE) FROM payment_status_counts
  UNION ALL SELECT 'payment_events.amount_minor', nullif(lower(trim(merchant_id, ' ')), ''), CAST(event_date AS VARCHAR), CAST(amount_minor AS DOUBLE) FROM payment_events)"""
#: Daily groups of the small data keep every value, so there the answers are exact; see ``p4_rank_check`` for others.
_DAILY_SQL = f"""WITH {_VALUES_SQL},
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY measure, member, day) AS n FROM v WHERE x IS NOT NULL AND NOT isnan(x) WINDOW w AS (PARTITION BY measure, member, day ORDER BY x)),
p AS (SELECT unnest([500, 900, 990]) AS permille)
SELECT measure, member, day, n, CAST(permille AS INTEGER) AS permille, x AS percentile, CAST(0 AS BIGINT) AS rank_error
FROM r JOIN p ON rn = greatest(1, (permille * n + 999) // 1000)"""

#: All windows of 200 characters, compared as texts.
_SPANS_SQL = """WITH w AS (SELECT doc_id, i, substring(text, CAST(i + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
r AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER o <= 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN r USING (s) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
f AS (SELECT doc_id, CAST(min(i) AS INTEGER) AS span_start, CAST(max(i) + 200 AS INTEGER) AS span_end FROM g GROUP BY doc_id, run)
"""
_SHARES_SQL = """SELECT doc_id, length(text) AS n_chars, coalesce(k, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN coalesce(k, 0) / length(text) END AS share
FROM documents LEFT JOIN (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS k FROM f GROUP BY 1) USING (doc_id)"""



def _levels_sql(levels: int = 12) -> str:
    """Levels of 200 * 2**k: a window of twice the length is the pair of its halves, named by the first of their kind."""
    steps = ["""l0 AS (SELECT doc_id, i, min(doc_id * 100000000 + i) OVER (PARTITION BY s) AS g, min(doc_id) OVER (PARTITION BY s) <> max(doc_id) OVER (PARTITION BY s) AS shared
  FROM (SELECT doc_id, i, substring(text, CAST(i + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)))"""]
    for k in range(levels):
        steps.append(f"""l{k + 1} AS (SELECT doc_id, i, min(doc_id * 100000000 + i) OVER (PARTITION BY g, h) AS g, min(doc_id) OVER (PARTITION BY g, h) <> max(doc_id) OVER (PARTITION BY g, h) AS shared
  FROM (SELECT a.doc_id, a.i, a.g, b.g AS h FROM l{k} a JOIN l{k} b ON b.doc_id = a.doc_id AND b.i = a.i + {200 << k} WHERE a.shared AND b.shared))""")
    found = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {200 << k} AS level FROM l{k} WHERE shared" for k in range(levels + 1))
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, CAST(max(level) AS INTEGER) AS longest_level FROM ({found}) GROUP BY doc_id"


_RANK_SQL = f"""WITH {_VALUES_SQL} SELECT measure, member, n, CAST(unnest([500, 900, 990]) AS INTEGER) AS permille, true AS is_known, true AS is_bounded, true AS is_compressed
FROM (SELECT measure, member, count(*) AS n FROM v WHERE x IS NOT NULL AND NOT isnan(x) GROUP BY ALL)"""
#: Every text with a character has a token.
_INVARIANTS_SQL = "SELECT count(*) FILTER (length(text) > 0) AS n_documents, CAST(0 AS BIGINT) AS n_over, true AS is_possible, CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_cut FROM documents"

ORACLE: dict[str, str] = {"p4_daily": _DAILY_SQL, "p4_rank_check": _RANK_SQL, "p7_invariants": _INVARIANTS_SQL, "p8_found": _SPANS_SQL + "SELECT * FROM f", "p8_shares": _SPANS_SQL + _SHARES_SQL, "p8_levels": _levels_sql()}
