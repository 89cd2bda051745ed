"""Scorers: a model is metadata that is checked before use, and a function from columns to a probability column."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate
from ledgerloom.session import materialize
from ledgerloom.sources.synthetic import labelled_payments, log_odds

Scorer = Callable[[DataFrame], DataFrame]
FEATURE_ORDER = ["log_amount", "velocity", "new_device", "cross_border"]


class Unavailable(RuntimeError):
    """The artifact can't be used; callers fall back."""


#: Versions of the metadata's form and of ``preprocess``; other ones are refused.
METADATA_FORM, PREPROCESSING = 1, "clipped-log-v1"


@dataclass(frozen=True)
class Metadata:
    """What is known of an artifact. ``rounds`` is the number of trees that are used."""

    version: str
    sha256: str
    features: list[str]
    threshold: float
    rounds: int
    form: int = METADATA_FORM
    preprocessing: str = PREPROCESSING
    report: dict | None = None


def digest_of(artifact: str) -> str:
    """SHA-256 of a file, or of all files of a folder with their names, in order."""
    root, found = Path(artifact), hashlib.sha256()
    if not root.is_dir():
        return hashlib.sha256(root.read_bytes()).hexdigest()
    for path in sorted(p for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")):
        found.update(f"{path.relative_to(root)}\n".encode())
        found.update(hashlib.sha256(path.read_bytes()).digest())
    return found.hexdigest()


def write_metadata(path: str, metadata: Metadata) -> None:
    Path(path).write_text(json.dumps(asdict(metadata), indent=2, sort_keys=True) + "\n")


def load_metadata(path: str, artifact: str) -> Metadata:
    """Metadata beside an artifact, if every gate is passed: form, digest, preprocessing, features, values in range."""
    try:
        found = Metadata(**json.loads(Path(path).read_text()))
        digest = digest_of(artifact)
    except (OSError, ValueError, TypeError) as e:
        raise Unavailable(f"no usable metadata: {e}") from e
    number = lambda v, kind: isinstance(v, kind) and not isinstance(v, bool)
    gates = {
        "form": found.form == METADATA_FORM, "digest": digest == found.sha256, "preprocessing": found.preprocessing == PREPROCESSING, "features": found.features == FEATURE_ORDER,
        "version": isinstance(found.version, str) and bool(found.version.strip()), "threshold": number(found.threshold, (int, float)) and 0 < found.threshold < 1, "rounds": number(found.rounds, int) and found.rounds >= 0,
    }
    if not all(gates.values()):
        raise Unavailable("refused for " + ", ".join(name for name, passed in gates.items() if not passed))
    return found


def preprocess(df: DataFrame) -> DataFrame:
    """The four features as 32-bit floats: log of the clipped amount, clipped velocity, flags."""
    amount = F.log1p(F.least(F.lit(2_000_000), F.greatest(F.lit(1), F.col("amount_minor"))))
    velocity = F.least(F.lit(20), F.greatest(F.lit(1), F.col("velocity_5m")))
    cells = {"log_amount": amount, "velocity": velocity, "new_device": F.col("new_device").cast("int"), "cross_border": F.col("cross_border").cast("int")}
    return df.withColumn("features", F.array(*[cells[n].cast("float") for n in FEATURE_ORDER]))


def closed_form() -> Scorer:
    """The generator's own probability: no artifact, all in generated code."""

    def score(df: DataFrame) -> DataFrame:
        odds = log_odds(F.col("amount_minor"), F.col("velocity_5m"), F.col("new_device"), F.col("cross_border"))
        return with_score(df.withColumn("probability", 1 / (1 + F.exp(-odds))))

    return score


def with_score(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Whole points of a probability, halves to even, 0 to 100."""
    points: Column = F.bround(F.col(probability) * 100, 0).cast("int")
    return df.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), points)))


def _pipeline_columns(df: DataFrame) -> DataFrame:
    cells = preprocess(df).withColumns({n: F.col("features")[k] for k, n in enumerate(FEATURE_ORDER)})
    return cells.drop("features")


def stratified_split(df: DataFrame, shares: Sequence[float] = (0.6, 0.2, 0.2), key: str = "id", label: str = "label", seed: int = 42) -> DataFrame:
    """``df`` with the column ``part``: 0, 1, ... by shares that hold within each label (to 1/100,000 of its rows).

    A row's place is a hash of its key; the cuts are quantiles of the places of each label, so nothing is sorted.
    """
    cuts = [sum(shares[: k + 1]) for k in range(len(shares) - 1)]
    placed = df.withColumn("_place", F.xxhash64(F.lit(seed), key))
    bounds = placed.groupBy(label).agg(F.percentile_approx("_place", cuts, 100_000).alias("_cuts"))
    joined = placed.join(F.broadcast(bounds), label)  # one row per label
    return joined.withColumn("part", F.size(F.filter("_cuts", lambda c: c < F.col("_place")))).drop("_place", "_cuts")


def train(df: DataFrame, label: str = "label", rounds: int = 30, seed: int = 42, tolerance: float = 0.0) -> PipelineModel:
    """Boosted trees of depth 4 by Spark ML, trained in parallel on all rows.

    With a column ``part``, 0 is trained on and 1 decides when to stop: once a round lowers its loss by no more than ``tolerance``.
    """
    stages = [VectorAssembler(inputCols=FEATURE_ORDER, outputCol="vector"), GBTClassifier(featuresCol="vector", labelCol=label, maxDepth=4, maxIter=rounds, stepSize=0.1, seed=seed)]
    if "part" in df.columns:
        df = df.filter("part < 2").withColumn("_held_out", F.col("part") == 1)
        stages[1].setParams(validationIndicatorCol="_held_out", validationTol=tolerance)
    return Pipeline(stages=stages).fit(_pipeline_columns(df))


def build(spark: SparkSession, folder: str, samples: int = 50_000, seed: int = 42, rounds: int = 300, missed: int = 500, false_alarm: int = 25, version: str = "gbt-synthetic-v1") -> Metadata:
    """Trains on synthetic rows, picks the threshold on the validation part, measures on the test part, writes both files.

    ``folder`` is local: the artifact and its metadata are small and are checked by digest before use.
    """
    rows = materialize(stratified_split(labelled_payments(spark, samples, seed), seed=seed), "samples")
    model = train(rows, rounds=rounds, seed=seed)
    scored = trained(model)(rows).select("part", "label", F.col("probability").alias("score"))
    chosen = evaluate.best_threshold(scored.filter("part = 1"), missed, false_alarm).first()
    threshold = chosen["threshold"] / 100
    measured = {name: evaluate.confusion(scored.filter(F.col("part") == k), threshold).first().asDict() for k, name in ((1, "validation"), (2, "test"))}
    measured["test"] |= evaluate.ranking(scored.filter("part = 2")).first().asDict()
    report = {"samples": samples, "seed": seed, "missed": missed, "false_alarm": false_alarm, "validation_cost": chosen["cost"], **measured, "rows": {str(r.part): r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}}
    model.write().overwrite().save(f"file://{folder}/model")
    found = Metadata(version, digest_of(f"{folder}/model"), FEATURE_ORDER, threshold, model.stages[-1].getNumTrees, report=report)
    write_metadata(f"{folder}/model.json", found)
    return found


def trained(model: PipelineModel) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        found = model.transform(_pipeline_columns(df)).withColumn("_p", vector_to_array("probability")[1])
        return with_score(found.drop("vector", "rawPrediction", "prediction", "probability").withColumnRenamed("_p", "probability"))

    return score
