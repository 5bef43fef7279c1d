"""Red and near-infrared reflectance of a plot before and after an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.numeric import clamp, half_up


def ndvi(red: Column, nir: Column) -> Column:
    return (nir - red) / F.greatest(nir + red, F.lit(1e-6))


def reflectance_windows(plots: DataFrame, reflectance: DataFrame) -> DataFrame:
    """Mean red and nir of each (tile, event day), before and after.

    ``plots`` has tile_id and event_date.  Observations are first summed per
    tile and day; each wanted event day is then laid out over the days of its
    window and joined on (tile, day).  A busy tile is spread over its days, and
    claims that share a plot and a day are computed once.  The event day counts
    on both sides.
    """
    daily = reflectance.groupBy("tile_id", F.col("obs_date").alias("day")).agg(
        *[
            agg(F.when(F.col("band") == band, F.col("value"))).alias(f"{name}_{band}")
            for band in ("red", "nir")
            for name, agg in (("sum", F.sum), ("n", F.count))
        ]
    )
    wanted = (
        plots.select("tile_id", "event_date")
        .distinct()
        .withColumn("step", F.explode(F.sequence(F.lit(-C.WINDOW_BEFORE_DAYS), F.lit(C.WINDOW_AFTER_DAYS))))
        .withColumn("day", F.date_add("event_date", F.col("step")))
    )

    def mean(band: str, inside: Column) -> Column:
        n = F.sum(F.when(inside, F.col(f"n_{band}")))
        return F.when(n > 0, F.sum(F.when(inside, F.col(f"sum_{band}"))) / n)

    before, after = F.col("step") <= 0, F.col("step") >= 0
    return (
        wanted.join(daily, ["tile_id", "day"])
        .groupBy("tile_id", "event_date")
        .agg(
            mean("red", before).alias("red_pre"),
            mean("nir", before).alias("nir_pre"),
            mean("red", after).alias("red_post"),
            mean("nir", after).alias("nir_post"),
        )
    )


def ndvi_drop(windows: DataFrame) -> DataFrame:
    """Destruction percent and rung from the fall in vegetation index."""
    pre = ndvi(F.col("red_pre"), F.col("nir_pre"))
    post = ndvi(F.col("red_post"), F.col("nir_post"))
    pct = clamp(half_up(F.greatest(pre - post, F.lit(0.0)) / C.NDVI_DROP * 100), 0, 100).cast("long")
    out = (
        windows.where(F.col("red_pre").isNotNull() & F.col("nir_pre").isNotNull())
        .where(F.col("red_post").isNotNull() & F.col("nir_post").isNotNull())
        .withColumn("ndvi_pre", pre)
        .withColumn("ndvi_post", post)
        .withColumn("destruction_pct", pct)
    )
    rung = F.when(F.col("destruction_pct") >= C.NDVI_RUNGS[0][0], C.NDVI_RUNGS[0][1])
    for least, name in C.NDVI_RUNGS[1:]:
        rung = rung.when(F.col("destruction_pct") >= least, name)
    return out.withColumn("rung", rung)


def claim_plots(claims: DataFrame, points: DataFrame) -> DataFrame:
    """Plot cell and event day of every claim with a geotagged photo."""
    when = claims.select(
        F.col("id").alias("claim_id"), F.to_date("submitted_at").alias("event_date"), "loss_type"
    )
    return when.join(points, "claim_id")


def plot_damage(claims: DataFrame, points: DataFrame, reflectance: DataFrame) -> DataFrame:
    plots = claim_plots(claims, points)
    return plots.join(ndvi_drop(reflectance_windows(plots, reflectance)), ["tile_id", "event_date"])
