"""The whole run as one call: read, name, split in time order, fit, save, score both parts, write their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from regimeflow.operators.filters import split_by_fraction
from regimeflow.plans.detector import ShockDetector, ShockModel
from regimeflow.plans.reports import write_report
from regimeflow.scratch import materialize
from regimeflow.sources import read_events
from regimeflow.sources.events import assign_names

TRAIN_SHARE = 0.95  # fixed value


@dataclass
class Run:
    model: ShockModel
    train: DataFrame
    later: DataFrame
    reports: dict[str, dict[str, str]]


def run_events(spark: SparkSession, path: str, out: str, detector: ShockDetector, fraction: float = TRAIN_SHARE,
               continued: bool = False, **report) -> Run:
    """Leaves ``out/model``, ``out/reports/train`` (with the silhouettes) and ``out/reports/val``.

    By default the later part starts from state zero, like any table that is scored; ``continued`` lets it go on from
    the state after the last row of the first part.  ``report`` goes to :func:`write_report`.
    """
    events = assign_names(read_events(spark, path))
    first, rest = split_by_fraction(events, detector.order_cols, fraction)
    model = detector.fit(first)
    model.save(f"{out}/model")
    train = materialize(model.transform(first), "run-train")
    later = materialize((model.continued() if continued else model).transform(rest), "run-later")
    reports = {"train": write_report(model, train, f"{out}/reports/train", include_silhouette=True, **report),
               "val": write_report(model, later, f"{out}/reports/val", **report)}
    return Run(model, train, later, reports)
