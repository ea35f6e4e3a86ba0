"""Automatic column encoding: any table to one ``features ARRAY<FLOAT>`` column.

Per column, in this order: date -> five cyclical features, boolean -> 0/1, number -> z-score, text -> one-hot
over its frequent values, or dropped when no value is frequent enough.  Every decision is a row of a metadata
table, so scoring data gets the encoding that was fitted.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimeflow.functions import dates as D
from regimeflow.functions.vectors import none_if_nan
from regimeflow.operators.ordering import assign_seq, forward_fill
from regimeflow.operators.stats import CATEGORY_CAP, CATEGORY_FLOOR, as_category, frequent_values, medians, moment_aggregates, scalers_from, top_categories

# The share that must parse, and the two text thresholds.
PARSE_SHARE = 0.8
OHE_THRESHOLD, MIN_ROWS_FOR_STRATEGY = 0.20, 2000
SELECTIVE, ALL, BY_ROWS = "selective", "all", "by_rows"

METADATA_SCHEMA = (
    "column string, position int, decision string, date_format string, mean double, scale double, fill double, "
    "year_min double, year_max double, categories array<string>"
)


@dataclass
class ColumnPlan:
    column: str
    position: int
    decision: str
    date_format: str | None = None
    mean: float | None = None
    scale: float | None = None
    fill: float | None = None
    year_min: float | None = None
    year_max: float | None = None
    categories: list[str] = field(default_factory=list)

    def feature_names(self) -> list[str]:
        if self.decision == "datetime":
            return [f"{self.column}_{s}" for s in D.CYCLICAL_SUFFIXES]
        if self.decision == "ohe":
            return [f"{self.column}__{c}" for c in self.categories]
        return [] if self.decision == "drop" else [self.column]


# ---------------------------------------------------------------------------------------------- date detection

def detect_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the share of all its values that reads as ``yyyyMMdd``, as a generic date, and as a bare year.

    One aggregate over the table answers for all columns.
    """
    def present(c: str) -> Column:
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        return (none_if_nan(F.col(c)) if floating else F.col(c)).cast("string")

    def share(c: str, test: Column) -> Column:
        return F.avg(F.when(present(c).isNotNull(), test.cast("double")))

    rates = [F.struct(F.lit(c).alias("column"), share(c, D.parse_compact(present(c)).isNotNull()).alias("compact_rate"),
                      share(c, D.parse_generic(present(c)).isNotNull()).alias("generic_rate"),
                      share(c, present(c).rlike(r"^(\d{4}(\.\d+)?|\d{14})$")).alias("year_rate")) for c in columns]
    return df.agg(F.array(*rates).alias("r")).select(F.explode("r").alias("r")).select("r.*").where("compact_rate is not null")


# --------------------------------------------------------------------------------------------- feature columns

def encode_numeric(c: Column, mean, scale, fill) -> Column:
    return (F.coalesce(none_if_nan(c.cast("double")), F.lit(fill)) - F.lit(mean)) / F.lit(scale)


def encode_bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def encode_onehot(c: Column, categories: list[str]) -> list[Column]:
    value = as_category(c)
    return [(value == F.lit(cat)).cast("double") for cat in categories]


def as_feature(c: Column) -> Column:
    """Single precision, with anything that is not a finite number set to 0."""
    x = c.cast("double")
    return F.when(F.abs(none_if_nan(x)) < F.lit(float("inf")), x).otherwise(F.lit(0.0)).cast("float")


# ----------------------------------------------------------------------------------------------------- encoder

class ColumnEncoder:
    """``fit`` decides, ``EncoderModel.transform`` applies.

    exclude:       columns kept out of the features (row ids).
    text_strategy: ``selective`` drops text columns without a value above ``ohe_threshold``, ``all`` keeps them, ``by_rows`` is
                   selective for tables of more than ``min_rows_for_strategy`` rows only.
    category_floor, category_cap: share a value must exceed to get a feature of its own, and how many can.
    compat_dates:  also treat bare years and 14-digit numbers as dates.
    batch_stats:   at transform, take the median fill, the year range and the date format from the table given
                   instead of the fitted ones.
    """

    def __init__(
        self,
        order_cols: list[str],
        time_col: str | None = None,
        ohe_threshold: float = OHE_THRESHOLD,
        min_rows_for_strategy: int = MIN_ROWS_FOR_STRATEGY,
        exclude: tuple[str, ...] = (),
        compat_dates: bool = False,
        batch_stats: bool = False,
        text_strategy: str = SELECTIVE,
        category_floor: float = CATEGORY_FLOOR,
        category_cap: int = CATEGORY_CAP,
    ):
        if text_strategy not in (SELECTIVE, ALL, BY_ROWS):
            raise ValueError(f"unknown text strategy {text_strategy!r}")
        self.text_strategy = text_strategy
        self.category_floor, self.category_cap = category_floor, category_cap
        self.order_cols = order_cols
        self.time_col = time_col
        self.ohe_threshold = ohe_threshold
        self.min_rows_for_strategy = min_rows_for_strategy
        self.exclude = set(exclude)
        self.compat_dates = compat_dates
        self.batch_stats = batch_stats

    def fit(self, df: DataFrame) -> EncoderModel:
        fields = [f for f in df.schema.fields if f.name not in self.exclude]
        for f in fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DayTimeIntervalType,
                                       T.YearMonthIntervalType, T.BinaryType)):
                raise ValueError(f"column {f.name!r} is {f.dataType.simpleString()}: project it to plain columns first")
        plans = {f.name: self._kind(f, i) for i, f in enumerate(fields)}
        self._recognise_dates(df, fields, plans)
        numeric = [p.column for p in plans.values() if p.decision == "numeric"]
        dated = [p for p in plans.values() if p.decision == "datetime"]
        # One pass gives the row count, the moments of every number and the years of every date.
        profile = df.agg(F.count("*").alias("n_rows"), *moment_aggregates(numeric), *_year_aggregates(dated, self.order_cols)).first()
        for c, s in scalers_from(df, numeric, profile["n_rows"], profile).items():
            plans[c].mean, plans[c].scale, plans[c].fill = s["mean"], s["scale"], s["fill"]
        for p in dated:
            p.year_min, p.year_max = _year_range(profile[f"years_{p.column}"])
        self._fit_text(df, plans, profile["n_rows"])
        return EncoderModel(df.sparkSession, list(plans.values()), self.order_cols, self.batch_stats, profile["n_rows"])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _kind(self, f: T.StructField, position: int) -> ColumnPlan:
        if D.is_native_date(f.dataType):
            return ColumnPlan(f.name, position, "datetime", D.NATIVE)
        if isinstance(f.dataType, T.BooleanType):
            return ColumnPlan(f.name, position, "bool")
        if isinstance(f.dataType, T.NumericType):
            return ColumnPlan(f.name, position, "numeric")
        return ColumnPlan(f.name, position, "ohe")

    def _recognise_dates(self, df: DataFrame, fields: list[T.StructField], plans: dict[str, ColumnPlan]) -> None:
        def may_hold_dates(f: T.StructField) -> bool:
            return f.name == self.time_col or self.compat_dates or isinstance(f.dataType, (T.StringType, T.IntegralType))

        open_ = [f for f in fields if plans[f.name].decision in ("numeric", "ohe") and may_hold_dates(f)]
        if not open_:
            return
        rates = {r["column"]: r for r in detect_dates(df, [f.name for f in open_]).collect()}
        for f in open_:
            plan, r = plans[f.name], rates.get(f.name)
            is_text = isinstance(f.dataType, T.StringType)
            if r and r["compact_rate"] > PARSE_SHARE:
                plan.date_format = D.COMPACT
            elif r and is_text and r["generic_rate"] > PARSE_SHARE:
                plan.date_format = D.GENERIC
            elif r and self.compat_dates and not is_text and r["year_rate"] > PARSE_SHARE:
                plan.date_format = D.EPOCH_NANOS
            elif f.name == self.time_col:
                plan.date_format = D.GENERIC if is_text else D.EPOCH_NANOS
            if plan.date_format:
                plan.decision = "datetime"
        self._check_whole_columns(df, plans)

    def _check_whole_columns(self, df: DataFrame, plans: dict[str, ColumnPlan]) -> None:
        """A column only sniffed as ``yyyyMMdd`` must also parse as a whole, else it falls back to generic dates."""
        compact = [p for p in plans.values() if p.date_format == D.COMPACT]
        if compact:
            for p, rate in zip(compact, df.agg(*_compact_rates(compact)).first()):
                if not rate or rate <= PARSE_SHARE:
                    p.date_format = _fallback_format(df, p.column)

    def _fit_text(self, df: DataFrame, plans: dict[str, ColumnPlan], n_rows: int) -> None:
        text = [p.column for p in plans.values() if p.decision == "ohe"]
        if not text:
            return
        kept = top_categories(frequent_values(df, text, n_rows, self.category_floor), self.category_floor, self.category_cap).orderBy("column", "rank").collect()
        selective = self.text_strategy == SELECTIVE or self.text_strategy == BY_ROWS and n_rows > self.min_rows_for_strategy
        for c in text:
            rows = [r for r in kept if r["column"] == c]
            plans[c].categories = [r["value"] for r in rows]
            if selective and not (rows and rows[0]["frequency"] > self.ohe_threshold):
                plans[c].decision, plans[c].categories = "drop", []


def _compact_rates(plans: list[ColumnPlan]) -> list[Column]:
    return [F.avg(D.parse_compact(F.col(p.column)).isNotNull().cast("double")).alias(p.column) for p in plans]


def _fallback_format(df: DataFrame, column: str) -> str:
    return D.GENERIC if isinstance(df.schema[column].dataType, T.StringType) else D.EPOCH_NANOS


def _year_aggregates(plans: list[ColumnPlan], order_cols: list[str]) -> list[Column]:
    aggs = []
    for p in plans:
        date = D.parse_date(F.col(p.column), p.date_format)
        aggs.append(F.struct(
            F.min(F.year(date)).alias("lo"), F.max(F.year(date)).alias("hi"),
            F.min_by(date.isNull(), F.struct(*order_cols)).alias("leading_gap"),
        ).alias(f"years_{p.column}"))
    return aggs


def _year_range(stats) -> tuple[float, float]:
    """Lowest and highest year.  A leading gap takes the fallback date, so its year counts too."""
    years = [y for y in (stats["lo"], stats["hi"]) if y is not None]
    if stats["leading_gap"] or not years:
        years.append(int(D.FALLBACK_DATE[:4]))
    return float(min(years)), float(max(years))


class EncoderModel:
    def __init__(self, spark: SparkSession, plans: list[ColumnPlan], order_cols: list[str], batch_stats: bool = False,
                 fitted_rows: int | None = None):
        self.spark = spark
        self.plans = sorted(plans, key=lambda p: p.position)
        self.order_cols = order_cols
        self.batch_stats = batch_stats
        self.fitted_rows = fitted_rows

    @property
    def feature_names(self) -> list[str]:
        return [n for p in self.plans for n in p.feature_names()]

    @property
    def n_features(self) -> int:
        return len(self.feature_names)

    def metadata(self) -> DataFrame:
        rows = [tuple(asdict(p).values()) for p in self.plans]
        return self.spark.createDataFrame(rows, METADATA_SCHEMA)

    @classmethod
    def from_metadata(cls, table: DataFrame, order_cols: list[str], batch_stats: bool = False) -> EncoderModel:
        plans = [ColumnPlan(**r.asDict()) for r in table.collect()]  # one row per input column
        return cls(table.sparkSession, plans, order_cols, batch_stats)

    def summary(self) -> DataFrame:
        rows = [(p.column, p.decision, len(p.feature_names())) for p in self.plans]
        return self.spark.createDataFrame(rows, "column string, decision string, output_features int")

    def transform(self, df: DataFrame, into: str = "features") -> DataFrame:
        """Adds the feature vector; columns unseen at fit are left alone, a missing fitted one is an error."""
        used = [p for p in self.plans if p.decision != "drop"]
        missing = [p.column for p in used if p.column not in df.columns]
        if missing:
            raise ValueError(f"columns fitted but not given: {missing}")
        if not self.n_features:
            raise ValueError("no encodable columns")
        plans = self._from_batch(df, used) if self.batch_stats else used
        df, dates = self._filled_dates(df, [p for p in plans if p.decision == "datetime"])
        features = [as_feature(c) for p in plans for c in self._columns(p, dates)]
        return df.withColumn(into, F.array(*features)).drop(*dates.values())

    def _columns(self, p: ColumnPlan, dates: dict[str, str]) -> list[Column]:
        if p.decision == "datetime":
            return D.cyclical_features(F.col(dates[p.column]), F.lit(p.year_min), F.lit(p.year_max))
        if p.decision == "bool":
            return [encode_bool(F.col(p.column))]
        if p.decision == "numeric":
            return [encode_numeric(F.col(p.column), p.mean, p.scale, p.fill)]
        return encode_onehot(F.col(p.column), p.categories)

    def _filled_dates(self, df: DataFrame, plans: list[ColumnPlan]) -> tuple[DataFrame, dict[str, str]]:
        """Parsed dates with gaps filled forward.  Ordering the rows is only paid for when a gap exists."""
        dates = {p.column: f"_date_{p.position}" for p in plans}
        if not plans:
            return df, dates
        parsed = df.withColumns({dates[p.column]: D.parse_date(F.col(p.column), p.date_format) for p in plans})
        gaps = parsed.agg(*[F.count_if(F.col(d).isNull()).alias(d) for d in dates.values()]).first()
        with_gaps = [d for d in dates.values() if gaps[d]]
        if with_gaps:
            had_seq = "seq" in df.columns
            parsed = parsed if had_seq else assign_seq(parsed, self.order_cols)
            parsed = forward_fill(parsed, with_gaps, F.lit(D.FALLBACK_DATE).cast("date"))
            parsed = parsed if had_seq else parsed.drop("seq")
        return parsed, dates

    def _from_batch(self, df: DataFrame, plans: list[ColumnPlan]) -> list[ColumnPlan]:
        plans = [ColumnPlan(**asdict(p)) for p in plans]
        numeric = [p.column for p in plans if p.decision == "numeric"]
        fills = medians(df, numeric) if numeric else {}
        dated = [p for p in plans if p.decision == "datetime"]
        loose = [p for p in dated if p.date_format != D.NATIVE]
        if loose:
            for p, rate in zip(loose, df.agg(*_compact_rates(loose)).first()):
                p.date_format = D.COMPACT if rate and rate > PARSE_SHARE else _fallback_format(df, p.column)
        years = df.agg(*_year_aggregates(dated, self.order_cols)).first() if dated else {}
        for p in plans:
            if p.decision == "numeric":
                p.fill = fills[p.column]
            elif p.decision == "datetime":
                p.year_min, p.year_max = _year_range(years[f"years_{p.column}"])
        return plans
