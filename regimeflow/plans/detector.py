"""Shock detection end to end: order, encode, train, choose regimes, score."""

from __future__ import annotations

import copy
import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regimeflow.operators import ssm as S
from regimeflow.operators import training as TR
from regimeflow.operators.encoder import MIN_ROWS_FOR_STRATEGY, OHE_THRESHOLD, SELECTIVE, ColumnEncoder, EncoderModel
from regimeflow.operators.filters import after_key
from regimeflow.operators.ordering import top_shocks
from regimeflow.operators.regimes import K_MAX, TEMPERATURE, Regimes, fit_regimes, select_k
from regimeflow.operators.scoring import SIGNALS, W_DELTA, W_RECON, W_VELOCITY, signal_breakdown
from regimeflow.operators.stats import CATEGORY_CAP, CATEGORY_FLOOR, loss_summary, regime_summary, window_losses
from regimeflow.scratch import materialize

CONFIG_FIELDS = ("order_cols", "time_col", "group_col", "weights", "best_k", "temperature", "batch_stats", "untrained_rows", "end_state", "end_key")


class ShockDetector(Estimator):
    """Fits a :class:`ShockModel`.

    order_cols:       columns that put rows in a total order, the time column first.
    time_col:         forced to be read as dates; carried to the output (default: first of ``order_cols``).
    group_col:        another column carried to the output.
    windowed:         train on row windows instead of the whole series (ignores ``patience``).
    windows_per_step: windows per optimizer step; 1 is the sequential order.
    text_strategy, category_floor, category_cap: as for :class:`ColumnEncoder`.
    warm_start:       start the regimes from the centroids of the K search instead of from K seeded rows.
    """

    def __init__(
        self,
        order_cols: list[str],
        time_col: str | None = None,
        group_col: str | None = None,
        latent_dim: int = S.D_STATE,
        d_inner: int | None = None,
        max_k: int = K_MAX,
        n_iter: int = 50,
        lr: float = TR.LEARNING_RATE,
        ohe_threshold: float = OHE_THRESHOLD,
        min_rows_for_strategy: int = MIN_ROWS_FOR_STRATEGY,
        exclude: tuple[str, ...] = (),
        patience: int | None = None,
        windowed: bool = False,
        window_size: int = TR.WINDOW_SIZE,
        stride: int | None = None,
        windows_per_step: int | None = None,
        weights: tuple[float, float, float] = (W_DELTA, W_VELOCITY, W_RECON),
        temperature: float = TEMPERATURE,
        exact_grad: bool = False,
        compat_dates: bool = False,
        batch_stats: bool = False,
        seed: int = 42,
        chunk_rows: int | None = None,
        warm_start: bool = True,
        text_strategy: str = SELECTIVE,
        category_floor: float = CATEGORY_FLOOR,
        category_cap: int = CATEGORY_CAP,
    ):
        super().__init__()
        self.order_cols = list(order_cols)
        self.time_col = time_col or self.order_cols[0]
        self.group_col = group_col
        self.latent_dim = latent_dim
        self.d_inner = d_inner
        self.max_k = max_k
        self.n_iter = n_iter
        self.lr = lr
        self.ohe_threshold = ohe_threshold
        self.min_rows_for_strategy = min_rows_for_strategy
        self.exclude = exclude
        self.patience = patience
        self.windowed = windowed
        self.window_size = window_size
        self.stride = stride
        self.windows_per_step = windows_per_step
        self.weights = weights
        self.temperature = temperature
        self.exact_grad = exact_grad
        self.compat_dates = compat_dates
        self.batch_stats = batch_stats
        self.seed = seed
        self.chunk_rows = chunk_rows
        self.warm_start = warm_start
        self.text_strategy = text_strategy
        self.category_floor, self.category_cap = category_floor, category_cap

    def encoder(self) -> ColumnEncoder:
        return ColumnEncoder(self.order_cols, self.time_col, self.ohe_threshold, self.min_rows_for_strategy,
                             self.exclude, self.compat_dates, self.batch_stats, self.text_strategy, self.category_floor, self.category_cap)

    def _fit(self, dataset: DataFrame) -> ShockModel:
        encoder = self.encoder().fit(dataset)
        encoded = encoder.transform(dataset).select(*self.order_cols, S.FEATURES)
        series = S.pack_features(encoded, self.order_cols, [], encoder.n_features, self.chunk_rows,
                                 encoder.fitted_rows)
        params = S.init_params(encoder.n_features, self.latent_dim, self.d_inner, self.seed)
        optimizer = TR.Adam(lr=self.lr)
        if self.windowed and series.n_rows > self.window_size:
            windows = TR.pack_windows(series, self.window_size, self.stride, self.windows_per_step)
            trained = TR.train_windowed(windows, params, self.n_iter, optimizer, self.exact_grad)
        else:
            trained = TR.train_full(series, params, self.n_iter, optimizer, self.patience, exact_grad=self.exact_grad)
        states = materialize(S.predict(series, trained.params).select("seq", "z"), "states")
        last = dataset.agg(F.max(F.struct(*self.order_cols)).alias("key")).select("key.*")
        end_key = [None if v is None else str(v) for v in last.select(*[F.col(c).cast("string") for c in last.columns]).first()]
        chosen = select_k(states, ["seq"], "z", self.max_k, self.seed)
        # The sample's centroids are a start close to the end: far fewer passes over all rows than from K random rows.
        regimes = fit_regimes(states, chosen.best_k, ["seq"], "z", seed=self.seed, temperature=self.temperature,
                              start=chosen.centroids if self.warm_start else None)
        return ShockModel(encoder, trained.params, regimes, chosen.table, trained.step_losses(dataset.sparkSession),
                          trained.norm_history(dataset.sparkSession), S.params_table(dataset.sparkSession, trained.params, optimizer.moments()),
                          dict(order_cols=self.order_cols, time_col=self.time_col, group_col=self.group_col,
                               weights=list(self.weights), best_k=chosen.best_k, temperature=self.temperature,
                               batch_stats=self.batch_stats, untrained_rows=trained.untrained_rows,
                               end_state=S.end_state(states, series.n_rows).tolist(), end_key=end_key))


class ShockModel(Model):
    """A fitted detector: four small tables and a few settings.  Only a fitted model can score."""

    def __init__(self, encoder: EncoderModel, params: S.Params, regimes: Regimes, silhouettes: DataFrame,
                 losses: DataFrame, norms: DataFrame, params_table: DataFrame, config: dict):
        super().__init__()
        self.encoder, self.ssm_params, self.regimes = encoder, params, regimes
        self.silhouettes, self.losses, self.norms, self.params_table = silhouettes, losses, norms, params_table
        self.config = config
        self.start: np.ndarray | None = None
        for name in CONFIG_FIELDS:
            setattr(self, name, config.get(name))

    @property
    def spark(self) -> SparkSession:
        return self.encoder.spark

    def _carried(self, df: DataFrame) -> list[str]:
        return [c for c in (self.time_col, self.group_col) if c and c in df.columns]

    def continued(self, state: np.ndarray | None = None) -> ShockModel:
        """This model, its recurrence going on from ``state`` (default: the state after the last fitted row).

        Its input should hold the rows that follow, as :meth:`rows_after` selects them from a longer table.
        """
        start = self.end_state if state is None else state
        if start is None:
            raise ValueError("the model was saved without its end state")
        out = copy.copy(self)
        out.start = np.asarray(start, dtype=np.float64)
        return out

    def rows_after(self, df: DataFrame) -> DataFrame:
        """The rows that come after the last fitted one in the order columns; a filter that reaches the scan."""
        return df.where(after_key(df, self.order_cols, self.end_key))

    def signals(self, df: DataFrame, z0: np.ndarray | None = None) -> DataFrame:
        """Latent state, gate, velocity and reconstruction error per row, written once.

        Scoring needs their statistics before it can score a row; the table keeps that second look cheap.
        """
        encoded = self.encoder.transform(df)
        keep = self._carried(df)
        columns = list(dict.fromkeys([*self.order_cols, *keep]))
        series = S.pack_features(encoded.select(S.FEATURES, *columns), self.order_cols, keep, self.encoder.n_features)
        if z0 is None and self.start is not None:
            return materialize(S.predict(series, self.ssm_params, keep, self.start, continued=True), "signals")
        return materialize(S.predict(series, self.ssm_params, keep, z0), "signals")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """z_*, shock_score, regime, delta, recon_error, regime_*_prob, time and group columns, in time order by ``seq``."""
        scored = signal_breakdown(self.signals(dataset), tuple(self.weights))
        probs = self.regimes.probabilities(scored)
        width, k = len(self.ssm_params["A_log"]), self.regimes.k
        best = F.array_position("probs", F.array_max("probs")) - 1
        return probs.select(
            "seq",
            *[F.col("z")[i].alias(f"z_{i}") for i in range(width)],
            "shock_score", best.cast("int").alias("regime"), "delta", "recon_error",
            *[F.col("probs")[i].alias(f"regime_{i}_prob") for i in range(k)],
            *self._carried(dataset),
        )

    def signal_breakdown(self, df: DataFrame) -> DataFrame:
        """The three normalised signals and the score, with time and group."""
        return signal_breakdown(self.signals(df), tuple(self.weights)).select(
            "seq", *SIGNALS.values(), "shock_score", *self._carried(df))

    def top_shocks(self, scored: DataFrame, n: int = 10) -> DataFrame:
        return top_shocks(scored, n, self.time_col, self.group_col)

    def regime_summary(self, scored: DataFrame) -> DataFrame:
        return regime_summary(scored)

    def encoder_summary(self) -> DataFrame:
        return self.encoder.summary()

    def loss_history(self) -> DataFrame:
        return window_losses(self.losses)

    def training_summary(self) -> DataFrame:
        return loss_summary(self.loss_history())

    # Persistence: parquet tables and one JSON line.

    def save(self, path: str) -> None:
        tables = {"encoder": self.encoder.metadata(), "parameters": self.params_table, "centroids": self.regimes.table(),
                  "silhouette": self.silhouettes, "losses": self.losses, "norms": self.norms}
        for name, table in tables.items():
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")  # model-sized
        line = self.spark.createDataFrame([(json.dumps(self.config),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ShockModel:
        config = json.loads(spark.read.text(f"{path}/config").first()[0])

        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{path}/{name}")

        encoder = EncoderModel.from_metadata(table("encoder"), config["order_cols"], config["batch_stats"])
        regimes = Regimes.from_table(table("centroids"), config["temperature"])
        return cls(encoder, S.params_from_table(table("parameters")), regimes, table("silhouette"), table("losses"),
                   table("norms"), table("parameters"), config)


def fit_transform(detector: ShockDetector, df: DataFrame) -> DataFrame:
    return detector.fit(df).transform(df)
