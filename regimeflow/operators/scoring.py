"""Shock score in [0, 1] from gate, state velocity and reconstruction error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeflow.functions.activations import sigmoid
from regimeflow.functions.vectors import distance
from regimeflow.operators.ordering import BLOCK_ROWS, previous_row
from regimeflow.operators.stats import zscore

# Weights of the three signals, and how far their sum may be from 1.
W_DELTA, W_VELOCITY, W_RECON = 0.4, 0.4, 0.2
WEIGHT_TOL = 1e-6

SIGNALS = {"delta": "delta_norm", "velocity": "velocity_norm", "recon_error": "recon_norm"}


def state_velocity(df: DataFrame, vec: str = "z", seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``velocity``, the length of the step from the previous state; 0 on the first row."""
    lagged = previous_row(df, vec, "_previous", seq, block_rows)
    step = F.coalesce(distance(F.col(vec), F.col("_previous")), F.lit(0.0))
    return lagged.withColumn("velocity", step).drop("_previous")


def signal_breakdown(df: DataFrame, weights: tuple[float, float, float] = (W_DELTA, W_VELOCITY, W_RECON),
                     stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Adds the three normalised signals and ``shock_score``.

    Scores are relative to the rows given; frozen ``stats`` make them comparable between tables.
    """
    if abs(sum(weights) - 1.0) >= WEIGHT_TOL:
        raise ValueError(f"weights must sum to 1, not {sum(weights)}")
    signals = df if "velocity" in df.columns else state_velocity(df)
    normed = zscore(signals, SIGNALS, stats)
    mixed = sum((F.lit(w) * F.col(c) for w, c in zip(weights, SIGNALS.values())), F.lit(0.0))
    return normed.withColumn("shock_score", sigmoid(mixed))


def score(df: DataFrame, weights: tuple[float, float, float] = (W_DELTA, W_VELOCITY, W_RECON),
          stats: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return signal_breakdown(df, weights, stats).drop(*SIGNALS.values())
