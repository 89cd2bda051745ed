"""A labelled synthetic dataset of any size, generated where it is used; the same seed gives the same rows.

Amounts come from three groups of payments (everyday, large, wholesale), each with amounts spread evenly over the orders
of magnitude of its range; most customers pay once in a window and a few in bursts of geometric length. Whether a payment
crosses a border depends on its device. The label is drawn from a logistic model of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Log-odds of the label.
WEIGHTS = {"constant": -4.6, "log_amount": 0.55, "high_amount": 0.85, "high_velocity": 1.15, "extra_velocity": 0.12, "new_device": 0.9, "cross_border": 1.45, "both": 0.9}
#: Own values: (share, least, greatest amount) of the groups; chances of a burst, of its going on, and of the flags.
AMOUNTS = ((0.72, 300, 20_000), (0.24, 20_000, 150_000), (0.04, 150_000, 1_500_000))
BURST, BURST_GOES_ON, LONGEST = 0.1, 0.65, 18
NEW_DEVICE, BORDER_ON_OLD, BORDER_ON_NEW = 0.2, 0.05, 0.2


def log_odds(amount: Column, velocity: Column, device: Column, border: Column) -> Column:
    """The log-odds of the label as a weighted sum of terms."""
    flag = lambda c: c.cast("double")
    terms = {
        "constant": F.lit(1.0), "log_amount": F.log1p(amount / 10_000), "high_amount": flag(amount >= 100_000), "high_velocity": flag(velocity >= 5),
        "extra_velocity": F.greatest(velocity - 4, F.lit(0)), "new_device": flag(device), "cross_border": flag(border), "both": flag(device & border),
    }
    return sum((F.lit(w) * terms[name] for name, w in WEIGHTS.items()), F.lit(0.0))


def _uniform(seed: int, draw: str) -> Column:
    """A number in [0, 1) from the row's id, so that a row is the same wherever it is generated."""
    return F.pmod(F.xxhash64("id", F.lit(draw), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def labelled_payments(spark: SparkSession, samples: int, seed: int = 42) -> DataFrame:
    """(id, amount_minor, velocity_5m, new_device, cross_border, label); too few samples to learn from are refused."""
    if samples < 1_000:
        raise ValueError(f"{samples} samples are too few, 1000 are needed")
    pick, upto, amount = _uniform(seed, "group"), 0.0, None
    for share, least, greatest in AMOUNTS:
        upto += share
        spread = F.lit(float(least)) * F.pow(F.lit(greatest / least), _uniform(seed, "amount"))
        amount = F.when(pick < upto, spread) if amount is None else amount.when(pick < upto, spread)
    amount = F.coalesce(amount, F.lit(float(AMOUNTS[-1][2])))
    extra = F.least(F.lit(LONGEST), F.floor(F.log(1 - _uniform(seed, "length")) / F.log(F.lit(BURST_GOES_ON))) + 2)
    velocity = F.when(_uniform(seed, "burst") < BURST, 1 + extra).otherwise(1 + (_uniform(seed, "second") < 0.3).cast("int"))
    made = spark.range(samples).select("id", F.round(amount).cast("bigint").alias("amount_minor"), velocity.cast("int").alias("velocity_5m"), (_uniform(seed, "device") < NEW_DEVICE).alias("new_device"))
    made = made.withColumn("cross_border", _uniform(seed, "border") < F.when(F.col("new_device"), BORDER_ON_NEW).otherwise(BORDER_ON_OLD))
    chance = 1 / (1 + F.exp(-log_odds(F.col("amount_minor"), F.col("velocity_5m"), F.col("new_device"), F.col("cross_border"))))
    return made.withColumn("label", (_uniform(seed, "label") < chance).cast("int"))
