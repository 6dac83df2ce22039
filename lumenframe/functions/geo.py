"""Geography on a sphere as column expressions, grids, hot spots and autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, km: Column) -> tuple[Column, Column]:
    r, h, a = km / EARTH_KM, F.radians(heading), F.radians(lat)
    b = F.asin(F.sin(a) * F.cos(r) + F.cos(a) * F.sin(r) * F.cos(h))
    o = F.radians(lon) + F.atan2(F.sin(h) * F.sin(r) * F.cos(a), F.cos(r) - F.sin(a) * F.sin(b))
    return F.degrees(b), F.degrees(o)


def cell(lat: Column, lon: Column, resolution: int = 9) -> Column:
    """A square grid cell ``g{resolution}_{row}_{column}`` of 0.1 degrees at resolution 9, halved with each further one."""
    size = 0.1 / 2 ** (resolution - 9)
    return F.concat(F.lit(f"g{resolution}_"), F.floor(lat / size).cast("string"), F.lit("_"), F.floor(lon / size).cast("string"))


def by_cell(df: DataFrame, lat: str, lon: str, value: str | None = None, resolution: int = 9) -> DataFrame:
    figures = [F.count("*").alias("count"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon")] + ([F.avg(value).alias("mean")] if value else [])
    return df.groupBy(cell(F.col(lat), F.col(lon), resolution).alias("cell")).agg(*figures)


def hotspots(df: DataFrame, lat: str, lon: str, resolution: int = 9, z: float = 2.0) -> DataFrame:
    counts = by_cell(df, lat, lon, resolution=resolution)
    stats = counts.agg(F.avg("count").alias("m"), F.stddev_samp("count").alias("s"))
    scored = counts.crossJoin(F.broadcast(stats)).withColumn("z", F.try_divide(F.col("count") - F.col("m"), F.col("s")))
    return scored.where(F.abs("z") > z).select("cell", "count", "z", F.when(F.col("z") > 0, "hot").otherwise("cold").alias("kind"))


def distance_matrix(points: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """All pairs of a bounded set of points, given once as a < b."""
    a = points.select(F.col(key).alias("a"), F.col(lat).alias("la"), F.col(lon).alias("oa"))
    b = points.select(F.col(key).alias("b"), F.col(lat).alias("lb"), F.col(lon).alias("ob"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", haversine(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")).alias("km"))


def morans_i(points: DataFrame, key: str, lat: str, lon: str, value: str) -> DataFrame:
    """Spatial autocorrelation with row-standardised inverse distances, over a bounded set of points."""
    m = points.agg(F.avg(value).alias("m"))
    x = points.crossJoin(F.broadcast(m)).select(F.col(key).alias("k"), F.col(lat).alias("la"), F.col(lon).alias("lo"), (F.col(value) - F.col("m")).alias("z"))
    pairs = x.alias("a").join(x.alias("b"), F.col("a.k") != F.col("b.k")).select(F.col("a.k").alias("k"), F.col("a.z").alias("za"), F.col("b.z").alias("zb"), (1 / F.greatest(haversine(F.col("a.la"), F.col("a.lo"), F.col("b.la"), F.col("b.lo")), F.lit(1e-6))).alias("w"))
    rows = pairs.groupBy("k").agg((F.first("za") * F.sum(F.col("w") * F.col("zb")) / F.sum("w")).alias("s"))
    top = rows.agg(F.sum("s").alias("num"), F.count("*").alias("n"))
    return top.crossJoin(x.agg(F.sum(F.col("z") * F.col("z")).alias("den"))).select(F.try_divide("num", "den").alias("morans_i"), "n")


def spread(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Centroid, bounding box and the mean distance to the centroid."""
    box = df.agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))
    far = df.select(F.col(lat).alias("_a"), F.col(lon).alias("_o")).crossJoin(F.broadcast(box)).agg(F.avg(haversine(F.col("_a"), F.col("_o"), F.col("lat"), F.col("lon"))).alias("mean_km"))
    return box.crossJoin(far)


def nearest(df: DataFrame, key: str, lat: str, lon: str, at: tuple[float, float], top: int = 5) -> DataFrame:
    return df.select(key, haversine(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1])).alias("km")).orderBy("km", key).limit(top)


def rank_by_distance(df: DataFrame, group: str, key: str, lat: str, lon: str, at: tuple[float, float]) -> DataFrame:
    km = haversine(F.col(lat), F.col(lon), F.lit(at[0]), F.lit(at[1]))
    return df.select(group, key, km.alias("km")).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("km", key)))


def _settled(df: DataFrame) -> DataFrame:
    """Without the lineage so far: a checkpoint where the session names a shared folder for them, else kept in the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def dbscan(points: DataFrame, key: str, lat: str, lon: str, km: float = 1.0, least: int = 5, rounds: int = 60) -> DataFrame:
    """key, cluster (-1: noise). Points at one place share their neighbours and cluster, so places stand for them, with the smallest
    key and the number of keys there. Places meet only those of their own and the adjacent grid cells of side ``km``, on both
    sides of the antimeridian. Clusters are the smallest key that linked core places pass on; each round passes it to the
    neighbours and to the places that have the same label, until nothing changes."""
    import math

    step = math.degrees(km / EARTH_KM)
    row = F.floor(F.col(lat) / step)
    placed = points.select(F.col(key).alias("k"), F.col(lat).alias("la"), (F.pmod(F.col(lon) + 180, F.lit(360.0)) - 180).alias("lo"), row.alias("r"))
    base = placed.where(F.col("la").isNotNull() & F.col("lo").isNotNull()).groupBy("la", "lo", "r").agg(F.min("k").alias("k"), F.count_distinct("k").alias("n"))
    width = lambda r: F.greatest(F.cos(F.radians((r + 0.5) * step)), F.lit(0.01))
    spread = base.select("k", "la", "lo", F.explode(F.array(*[F.col("r") + d for d in (-1, 0, 1)])).alias("r")).withColumn("w", width(F.col("r")))
    edge = 3 * step / F.col("w")
    seen = F.array(F.col("lo"), F.when(F.col("lo") > 180 - edge, F.col("lo") - 360), F.when(F.col("lo") < edge - 180, F.col("lo") + 360))
    shown = spread.withColumn("x", F.explode(F.filter(seen, lambda x: x.isNotNull())))
    around = shown.select("k", "la", "lo", "r", F.explode(F.array(*[F.floor(F.col("x") * F.col("w") / step) + d for d in (-2, -1, 0, 1, 2)])).alias("c")).distinct()
    own = base.select(F.col("k").alias("k2"), F.col("la").alias("la2"), F.col("lo").alias("lo2"), F.col("n").alias("n2"), "r", F.floor(F.col("lo") * width(F.col("r")) / step).alias("c"))
    near = _settled(around.join(own, ["r", "c"]).where(haversine(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2")) <= km).select("k", "k2", "n2").distinct())
    core = near.groupBy("k").agg(F.sum("n2").alias("n")).where(F.col("n") >= least).select("k")
    links = _settled(near.select("k", "k2").join(core, "k").join(core.select(F.col("k").alias("k2")), "k2"))
    labels = core.withColumn("cluster", F.col("k"))
    for _ in range(rounds):
        passed = links.join(labels.select(F.col("k").alias("k2"), F.col("cluster").alias("c2")), "k2").groupBy("k").agg(F.min("c2").alias("m"))
        lower = labels.join(passed, "k", "left").select("k", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        hooks = lower.groupBy(F.col("old").alias("cluster")).agg(F.min("cluster").alias("to"))
        new = _settled(lower.join(hooks, "cluster", "left").select("k", "old", F.least("cluster", F.coalesce("to", "cluster")).alias("cluster")))
        labels = new.select("k", "cluster")
        if new.where("old != cluster").isEmpty():
            break
    else:
        raise RuntimeError(f"clusters didn't settle in {rounds} rounds")
    reached = near.join(labels.select(F.col("k").alias("k2"), F.col("cluster")), "k2").groupBy("k").agg(F.min("cluster").alias("cluster"))
    reached = base.select("la", "lo", "k").join(reached, "k").select("la", "lo", "cluster")
    return placed.join(reached, ["la", "lo"], "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
