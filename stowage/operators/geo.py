"""Nearest city of a point (JN14, SF19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RADIUS_KM, DEGREE_KM = 6371.0, 111.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def nearest_city(points: DataFrame, cities: DataFrame, city_km: float = 50, country_km: float = 300, slack_km: float = 10) -> DataFrame:
    """``id, city, country, km``: of the cities within ``slack_km`` of the nearest the largest; beyond ``city_km`` the country only, beyond ``country_km`` nothing.

    Points meet cities by bands of latitude as wide as ``country_km``: each
    point looks at its band and the two beside it.
    """
    wide = country_km / DEGREE_KM
    p = points.withColumn("band", F.explode(F.array(*(F.floor(F.col("lat") / wide).cast("long") + i for i in (-1, 0, 1)))))
    c = cities.select("city", "country", "population", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.floor(F.col("lat") / wide).cast("long").alias("band"))
    near = p.join(c, "band").withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).where(F.col("km") <= country_km)
    least = near.groupBy("id").agg(F.min("km").alias("d0"))
    some = near.join(least, "id").where((F.col("km") <= F.col("d0") + slack_km) & (F.col("km") <= F.greatest(F.lit(city_km), F.col("d0"))))
    best = some.groupBy("id").agg(F.max_by(F.struct("city", "country", "km"), F.struct("population", -F.col("km"), "city")).alias("b"))
    out = points.select("id").join(best, "id", "left")
    return out.select("id", F.when(F.col("b.km") <= city_km, F.col("b.city")).alias("city"), F.col("b.country").alias("country"), F.round("b.km", 6).alias("km"))
