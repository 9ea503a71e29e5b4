"""Comparison of a cavity's centre lines with published ones, as a range lookup between neighbouring samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ghia, Ghia and Shin (1982), tables I and II; positions, then velocities by Reynolds number.
Y_POSITIONS = (0.0, 0.0547, 0.0625, 0.0703, 0.1016, 0.1719, 0.2813, 0.4531, 0.5, 0.6172, 0.7344, 0.8516, 0.9531, 0.9609, 0.9688, 0.9766, 1.0)
X_POSITIONS = (0.0, 0.0625, 0.0703, 0.0781, 0.0938, 0.1563, 0.2266, 0.2344, 0.5, 0.8047, 0.8594, 0.9063, 0.9453, 0.9531, 0.9609, 0.9688, 1.0)
U_ALONG_Y = {
    100: (0.0, -0.03717, -0.04192, -0.04775, -0.06434, -0.1015, -0.15662, -0.2109, -0.20581, -0.13641, 0.00332, 0.23151, 0.68717, 0.73722, 0.78871, 0.84123, 1.0),
    1000: (0.0, -0.18109, -0.20196, -0.2222, -0.2973, -0.38289, -0.27805, -0.10648, -0.0608, 0.05702, 0.18719, 0.33304, 0.46604, 0.51117, 0.57492, 0.65928, 1.0),
    5000: (0.0, -0.41165, -0.42901, -0.43643, -0.40435, -0.3305, -0.22855, -0.07404, -0.03039, 0.08183, 0.20087, 0.33556, 0.46036, 0.45992, 0.4612, 0.48223, 1.0),
}
V_ALONG_X = {
    100: (0.0, 0.09233, 0.10091, 0.1089, 0.12317, 0.16077, 0.17507, 0.17527, 0.05454, -0.24533, -0.22445, -0.16914, -0.10313, -0.08864, -0.07391, -0.05906, 0.0),
    1000: (0.0, 0.27485, 0.29012, 0.30353, 0.32627, 0.37095, 0.33075, 0.32235, 0.02426, -0.31966, -0.42665, -0.5155, -0.39188, -0.33714, -0.27669, -0.21388, 0.0),
    5000: (0.0, 0.42447, 0.43329, 0.43648, 0.42951, 0.35368, 0.28066, 0.2728, 0.00945, -0.30018, -0.36214, -0.41442, -0.52876, -0.55408, -0.55069, -0.49774, 0.0),
}


def interpolated(profile: DataFrame, points: DataFrame) -> DataFrame:
    """points(pos, expected) with value: the profile's, linear between the samples around pos, constant beyond its ends.

    Each sample is held against the points, a published table of 17; the nearest sample on either side of each is found by one grouping, which sums up
    before its shuffle. Samples that are null take no part; with samples at one place, the largest value counts; without any there are no rows.
    """
    known = profile.filter("pos IS NOT NULL AND value IS NOT NULL").select(F.col("pos").alias("p"), F.col("value").alias("v"))
    near = known.join(F.broadcast(points), F.lit(True))  # 17 points
    low = F.max(F.when(F.col("p") <= F.col("pos"), F.struct("p", "v")))
    high = F.min(F.when(F.col("p") > F.col("pos"), F.struct("p", (-F.col("v")).alias("w"))))
    found = near.groupBy("pos", "expected").agg(low.alias("a"), high.alias("b"))
    between = F.col("a.v") + (-F.col("b.w") - F.col("a.v")) * (F.col("pos") - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))
    value = F.when(F.col("a").isNull(), -F.col("b.w")).when(F.col("b").isNull(), F.col("a.v")).otherwise(between)
    return found.select("pos", "expected", value.alias("value"))


def worst_error(profile: DataFrame, reynolds: int, along: str = "y") -> DataFrame:
    """One row: the largest |value - expected| / |expected| (absolute where 0 is expected)."""
    where, what = (Y_POSITIONS, U_ALONG_Y) if along == "y" else (X_POSITIONS, V_ALONG_X)
    points = profile.sparkSession.createDataFrame(list(zip(where, what[reynolds], strict=True)), "pos double, expected double")
    error = F.abs(F.col("value") - F.col("expected")) / F.when(F.col("expected") == 0, 1.0).otherwise(F.abs("expected"))
    return interpolated(profile, points).agg(F.max(error).alias("error"))
