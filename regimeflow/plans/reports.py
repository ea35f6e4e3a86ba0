"""Report tables of one scored split."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimeflow.operators.filters import is_high
from regimeflow.operators.timeline import timeline
from regimeflow.plans.detector import ShockModel
from regimeflow.sources import write_delimited

MAX_COMPONENTS, TOP_N = 10, 20  # fixed values


def state_columns(scored: DataFrame) -> list[str]:
    return sorted((c for c in scored.columns if c.startswith("z_")), key=lambda c: int(c[2:]))


def cluster_projection(scored: DataFrame, components: int = 2) -> DataFrame:
    """Rows of ``scored`` in their leading principal components, with regime and high-shock flag.

    All rows take part.  The means come off first, because the PCA model does not centre what it projects.
    """
    z = state_columns(scored)
    k = min(components, MAX_COMPONENTS, len(z))
    means = scored.agg(F.array(*[F.avg(c) for c in z]).alias("m")).scalar()
    centred = scored.withColumn("_z", array_to_vector(F.array(*[F.col(c) - means[i] for i, c in enumerate(z)])))
    projected = PCA(k=k, inputCol="_z", outputCol="_pc").fit(centred).transform(centred)
    return projected.withColumn("_pc", vector_to_array("_pc")).select(
        "seq", "regime", is_high(F.col("shock_score")).alias("high_shock"),
        *[F.col("_pc")[i].alias(f"pc_{i + 1}") for i in range(k)])


def cluster_centres(projection: DataFrame) -> DataFrame:
    components = [c for c in projection.columns if c.startswith("pc_")]
    return projection.groupBy("regime").agg(
        F.count("*").alias("count"), F.count_if("high_shock").alias("n_high"),
        *[F.avg(c).alias(c) for c in components]).orderBy("regime")


def silhouette_table(model: ShockModel) -> DataFrame:
    return model.silhouettes.select(F.col("k").alias("K"), F.col("score").alias("silhouette_score"), "best").orderBy("K")


def write_report(model: ShockModel, scored: DataFrame, out: str, include_silhouette: bool = False,
                 top_n: int = TOP_N, components: int = 2) -> dict[str, str]:
    """Writes the report tables under ``out`` as CSV folders with a header; returns their paths.

    ``top_n`` shocks are listed; the layout has ``components`` dimensions (at most ``MAX_COMPONENTS``).

    The full result and the projection are written by all tasks; the rest is report-sized and goes to one file.
    """
    paths = {}

    def write(name: str, table: DataFrame, single: bool = True) -> None:
        paths[name] = f"{out}/{name}"
        write_delimited(table.coalesce(1) if single else table, paths[name])

    write("report", scored, single=False)
    write("top_shocks", model.top_shocks(scored, top_n))
    write("regime_summary", model.regime_summary(scored))
    if include_silhouette:
        write("silhouette_scores", silhouette_table(model))
    if len(state_columns(scored)) >= 2:
        projection = cluster_projection(scored, components)
        write("clusters", projection, single=False)
        write("cluster_centres", cluster_centres(projection))
    if model.time_col in scored.columns:
        write("shock_timeline", timeline(scored, model.time_col))
    return paths
