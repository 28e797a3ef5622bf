"""City metrics: per type figures, domains, scaled sizes, districts, shelf layout."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up, scale_value


def buildings(entities: DataFrame, coupled: DataFrame) -> DataFrame:
    """(id, district, members, fan_in, fan_out, degree) of types that are no stubs."""
    types = entities.filter(F.array_contains("traits", "TType") & ~F.coalesce("is_stub", F.lit(False)))
    members = entities.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("members"))
    out = types.select("id", F.col("parent").alias("district")).join(members, F.col("id") == F.col("p"), "left").join(coupled.select("id", "fan_in", "fan_out"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("id", "district", zero("members"), zero("fan_in"), zero("fan_out")).withColumn("degree", F.col("fan_in") + F.col("fan_out"))


def sized(built: DataFrame, metric: str, to: tuple[float, float] = (1.0, 10.0), scale: str = "sqrt") -> DataFrame:
    """built with size: metric scaled by its measured domain."""
    domain = built.agg(F.min(metric).cast("double").alias("lo"), F.max(metric).cast("double").alias("hi")).withColumn("_k", F.lit(1))  # one row
    out = built.withColumn("_k", F.lit(1)).join(F.broadcast(domain), "_k")
    return out.withColumn("size", round_half_up(scale_value(F.col(metric).cast("double"), F.col("lo"), F.col("hi"), to, scale))).drop("_k", "lo", "hi")


def districts(sized_buildings: DataFrame) -> DataFrame:
    return sized_buildings.groupBy("district").agg(F.count("*").alias("buildings"), F.round(F.sum(F.col("size") * F.col("size")), 3).alias("footprint"))


def layout(sized_buildings: DataFrame, gap: float = 1.0) -> DataFrame:
    """(id, district, x, y, size): shelves in each district, largest first; districts are packed in parallel."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "id"], ascending=[False, True])
        width = max(g["size"].max(), math.sqrt((g["size"] + gap).pow(2).sum()))
        x = y = shelf = 0.0
        at = []
        for s in g["size"]:
            if x and x + s > width:
                x, y, shelf = 0.0, y + shelf + gap, 0.0
            at.append((x, y))
            x, shelf = x + s + gap, max(shelf, s)
        return pd.DataFrame({"id": g["id"], "district": g["district"], "x": [p[0] for p in at], "y": [p[1] for p in at], "size": g["size"]})

    return sized_buildings.select("id", "district", "size").groupBy("district").applyInPandas(pack, "id string, district string, x double, y double, size double")
