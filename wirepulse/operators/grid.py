"""Marker aggregation on latitude/longitude grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepulse.functions.geo import cell

LEVELS = (8, 4, 2)


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fold partial markers: strongest point, counts and sums. All parts combine map-side."""
    strongest = F.struct("intensity", (-F.col("id")).alias("_tie"))
    return df.groupBy(*keys).agg(
        F.max_by(F.struct("id", "lat", "lon", "intensity"), strongest).alias("rep"),
        F.sum("members").alias("members"),
        F.sum("articles").alias("articles"),
        F.sum("sources").alias("sources"),
    )


def zoom_grid(points: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Markers for every zoom level in one pass.

    The finest grid is aggregated first; coarser levels fold its cells instead of the points,
    since each coarse cell is a union of finest cells. A cell with one point passes that point
    through unchanged: no ``cluster_size`` and its own, possibly NULL, counts.
    ``points`` has id, lat, lon, intensity, num_articles, num_sources.
    """
    finest = min(levels)
    if any(level % finest for level in levels):
        raise ValueError("every level must be a multiple of the finest one")
    base = _merge(
        points.select(
            "id", "lat", "lon", "intensity",
            F.lit(1).cast("bigint").alias("members"),
            F.col("num_articles").cast("bigint").alias("articles"),
            F.col("num_sources").cast("bigint").alias("sources"),
            cell(F.col("lat"), finest).alias("_flat"),
            cell(F.col("lon"), finest).alias("_flon"),
        ),
        ["_flat", "_flon"],
    )
    spread = base.select(
        "rep.*", "members", "articles", "sources", "_flat", "_flon",
        F.explode(F.array(*map(F.lit, levels))).alias("cell_deg"),
    )
    step = F.col("cell_deg") / finest
    cells = spread.withColumns(
        {
            "cell_lat": F.floor(F.col("_flat") / step).cast("int"),
            "cell_lon": F.floor(F.col("_flon") / step).cast("int"),
        }
    )
    merged = _merge(cells, ["cell_deg", "cell_lat", "cell_lon"])
    several = F.col("members") > 1
    whole = lambda c: F.when(several, F.coalesce(c, F.lit(0))).otherwise(F.col(c))
    return merged.select(
        "cell_deg", "cell_lat", "cell_lon",
        F.col("rep.id").alias("id"), F.col("rep.lat").alias("lat"), F.col("rep.lon").alias("lon"),
        F.col("rep.intensity").alias("intensity"),
        whole("articles").alias("num_articles"),
        whole("sources").alias("num_sources"),
        F.when(several, F.col("members")).alias("cluster_size"),
    )


def cell_size(altitude: float) -> int:
    return 8 if altitude >= 2.0 else 4 if altitude >= 1.2 else 2 if altitude >= 0.7 else 0


def markers_at(points: DataFrame, altitude: float) -> DataFrame:
    """Markers for one camera altitude; close in, the points themselves."""
    size = cell_size(altitude)
    columns = ["id", "lat", "lon", "intensity", "num_articles", "num_sources", "cluster_size"]
    if size == 0:
        return points.withColumn("cluster_size", F.lit(None).cast("bigint")).select(*columns)
    return zoom_grid(points, (size,)).select(*columns)
