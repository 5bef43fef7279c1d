"""Where a point lies: nearest district, service area, plot cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallygrain import constants as C
from tallygrain.functions.numeric import half_up, haversine_km, tile_id


def with_district(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """nearest, nearest_km, resolved, out_of_area of a point.

    The centroids are a handful of fixed values, so they are part of the
    expression and need no join.  Ties go to table order.  Distances are plain
    columns, so the whole stays inside generated code.
    """
    names = [f"_km{i}" for i in range(len(C.DISTRICTS))]
    rows = df.withColumns({"_lat": lat, "_lon": lon})
    known = F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    rows = rows.withColumns(
        {n: haversine_km(F.col("_lat"), F.col("_lon"), F.lit(a), F.lit(b)) for n, (_, a, b) in zip(names, C.DISTRICTS)}
    ).withColumn("_km", F.when(known, F.least(*names)))
    nearest = F.lit(None).cast("string")
    for n, (name, _, _) in reversed(list(zip(names, C.DISTRICTS))):
        nearest = F.when(F.col(n) == F.col("_km"), name).otherwise(nearest)
    km = F.col("_km")
    return (
        rows.withColumn("nearest", nearest)
        .withColumn("nearest_km", half_up(km).cast("long"))
        .withColumn("resolved", F.when(km <= C.NEAR_KM, F.col("nearest")))
        .withColumn("out_of_area", km > C.SERVICE_KM)
        .drop("_lat", "_lon", "_km", *names)
    )


def plot_points(evidence: DataFrame) -> DataFrame:
    """First geotagged photo of each claim and its grid cell."""
    gps = F.col("exif.gps")
    return (
        evidence.where((F.col("kind") == "photo") & gps.isNotNull())
        .groupBy("claim_id")
        .agg(F.min_by(gps, F.struct("seq", "file_id")).alias("gps"))
        .select("claim_id", F.col("gps.lat").alias("lat"), F.col("gps.lon").alias("lon"))
        .withColumn("tile_id", tile_id(F.col("lat"), F.col("lon")))
    )


def covered(district: Column, loss_type: Column) -> Column:
    """Is a district in the list of a loss type?"""
    out = F.lit(False)
    for loss, meta in C.LOSS_META.items():
        out = out | ((loss_type == loss) & district.isin(*meta["districts"]))
    return out


def geo_reasons(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per geotagged photo or satellite file that gives a reason."""
    pointed = evidence.where(F.col("kind").isin(*C.IMAGE_KINDS) & F.col("exif.gps").isNotNull()).select(
        "claim_id", "file_id", "seq", F.col("exif.gps.lat").alias("lat"), F.col("exif.gps.lon").alias("lon")
    )
    placed = with_district(pointed, F.col("lat"), F.col("lon"))
    losses = claims.select(F.col("id").alias("claim_id"), "loss_type")
    label = F.col("loss_type")
    reason = (
        F.when(
            F.col("out_of_area"),
            F.format_string(
                "R4 gps-out-of-area: %s is %dkm from %s (outside the %s service area)",
                "file_id", "nearest_km", "nearest", label,
            ),
        )
        .when(
            F.col("resolved").isNotNull() & ~covered(F.col("resolved"), label),
            F.format_string(
                "R4 district-mismatch: %s geotagged in %s — not a covered district for %s claims",
                "file_id", "resolved", label,
            ),
        )
        .when(
            F.col("resolved").isNull() & (F.col("nearest_km") > C.UNRESOLVED_KM),
            F.format_string(
                "R4 gps-unresolved: %s is %dkm from the nearest covered district (%s)", "file_id", "nearest_km", "nearest"
            ),
        )
    )
    return (
        placed.join(losses, "claim_id")
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("claim_id", "file_id", "seq", "reason")
    )
