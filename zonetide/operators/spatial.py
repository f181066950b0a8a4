"""Nearest-zone assignment.

Planar distance on degrees, ties to the lower zone id. The zones are filed in an index of quadtree cells: a cell lists the
zones that are the nearest one for some spot inside it. A cell with more than a few candidates is cut into sixteen, so cells are
small only where zones are dense. A point finds its cell by an equality join and compares the few candidates there;
points are never paired with all zones, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonetide import settings as S
from zonetide.session import written

#: Candidates up to which a cell stays whole. Around a corner of several zones' areas, cells of any size have as many.
LEAF = 16
#: Cuts of the whole box at most; each divides both sides by four.
DEPTH = 12
#: Cuts down to the cells that tell a point which depths to look at: at most 4 ** (2 * COARSE) of them.
COARSE = 3


def in_box(df: DataFrame, lat: str = "lat", lon: str = "lon",
           lat_range=S.LATITUDE_RANGE, lon_range=S.LONGITUDE_RANGE) -> DataFrame:
    """Keep points inside the bounding box, edges included; missing coordinates fail."""
    return df.filter(F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range))


def _gap2(lat: str, lon: str, zlat: Column, zlon: Column) -> Column:
    dy, dx = F.col(lat) - zlat, F.col(lon) - zlon
    return dy * dy + dx * dx


def _known(lat: str, lon: str) -> Column:
    """Both coordinates are there and finite."""
    finite = lambda c: F.abs(F.col(c).cast("double")) < F.lit(float("inf"))  # noqa: E731  (NaN is above all)
    return F.coalesce(finite(lat) & finite(lon), F.lit(False))


def _cut(cells: DataFrame, depth: int, box: Column) -> DataFrame:
    """Each cell's candidates for its sixteen children.

    A zone stays if it is no further than the child's first choice, the zone nearest to its centre, from some corner of the child:
    where the first choice is nearer is a half plane, and a half plane that holds all corners holds the child.
    """
    kids = (cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumns({
        "cy": F.col("cy") * 4 + F.floor(F.col("_k") / 4), "cx": F.col("cx") * 4 + F.col("_k") % 4, "_box": box})
        .withColumn("_s", F.col("_box.side") / F.lit(4.0 ** depth))
        .withColumns({"_y": F.col("_box.y") + F.col("cy") * F.col("_s"), "_x": F.col("_box.x") + F.col("cx") * F.col("_s")}))
    half = F.col("_s") / 2
    me = F.struct(_gap2("_y", "_x", F.col("_zlat") - half, F.col("_zlon") - half).alias("d2"), "_zlat", "_zlon")
    first = kids.withColumn("_first", F.min(me).over(W.partitionBy("cy", "cx")))
    # A hair of slack keeps rounding from losing a tie or a point at the cell's edge.
    edges = [(F.col("_s") * F.lit(y), F.col("_s") * F.lit(x)) for y in (-1e-6, 1.000001) for x in (-1e-6, 1.000001)]
    near = reduce(Column.__or__, [
        _gap2("_y", "_x", F.col("_zlat") - y, F.col("_zlon") - x)
        <= _gap2("_y", "_x", F.col("_first._zlat") - y, F.col("_first._zlon") - x) * F.lit(1.000000001) for y, x in edges])
    return first.filter(near).select("cy", "cx", "_zlat", "_zlon", "z")


def cell_index(zones: DataFrame, box: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(depth, cy, cx, near): the cells and their candidate zones as structs of _zlat, _zlon, z.

    ``zones``: _zlat, _zlon and the zone ``z``, one row a spot. ``box``: one row (y, x, side). More than ``leaf`` candidates
    are left only where that many zones are equally near to one spot, or closer together than the smallest cell.
    """
    spot = box.select(F.struct("y", "x", "side")).scalar()
    zero = F.lit(0).cast("long")
    here = written(zones.select(zero.alias("cy"), zero.alias("cx"), "_zlat", "_zlon", "z"), "cells")
    done = []
    for depth in range(DEPTH + 1):
        gathered = here.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n"))
        full = gathered.filter(F.col("n") > leaf).select("cy", "cx")
        last = depth == DEPTH or full.isEmpty()
        whole = here if last else here.join(full, ["cy", "cx"], "left_anti")
        done.append(whole.groupBy("cy", "cx").agg(F.collect_list(F.struct("_zlat", "_zlon", "z")).alias("near"))
                    .select(F.lit(depth).alias("depth"), "cy", "cx", "near"))
        if last:
            break
        here = written(_cut(here.join(full, ["cy", "cx"], "left_semi"), depth + 1, spot), "cells")
    return written(reduce(DataFrame.unionByName, done), "index")


def _at_depth(place: Column, depth: Column | int) -> Column:
    """A place counted in smallest cells, as one of ``depth``."""
    return F.floor(place / F.pow(F.lit(4.0), F.lit(DEPTH) - depth)).cast("long")


def nearest_zone(points: DataFrame, zones: DataFrame, lat: str = "lat", lon: str = "lon",
                 attributes: list[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """Add the nearest zone's attributes (``zone_id`` first) to every point.

    Rows without finite coordinates get no zone; zones without are ignored. The points are read once for their box and
    once for the join; whether they are shuffled is up to the measured size of the index.
    """
    attributes = attributes or [c for c in ("zone_id", "zone_name", "region", "zone_type") if c in zones.columns]
    spots = (zones.filter(_known("lat", "lon")).groupBy(F.col("lat").cast("double").alias("_zlat"), F.col("lon").cast("double").alias("_zlon"))
             .agg(F.min(F.struct(*attributes)).alias("z")))
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    known = _known(lat, lon)
    box = written(points.filter(known).agg(F.min(y).alias("y"), F.min(x).alias("x"), F.greatest(
        F.max(y) - F.min(y), F.max(x) - F.min(x), F.lit(1e-9)).alias("side")), "box")
    index = cell_index(spots, box, leaf)
    # Which depths occur below each coarse cell: cells above are spread over the coarse ones they hold, cells below lie in one.
    span = F.pow(F.lit(4.0), F.greatest(F.lit(COARSE) - F.col("depth"), F.lit(0))).cast("long")
    up = F.pow(F.lit(4.0), F.greatest(F.col("depth") - F.lit(COARSE), F.lit(0)))
    spread = lambda c: F.explode(F.sequence(F.floor(F.col(c) / up) * span, F.floor(F.col(c) / up) * span + span - 1))
    depths = (index.select("depth", "cy", "cx").withColumn("_gy", spread("cy")).withColumn("_gx", spread("cx"))
              .groupBy("_gy", "_gx").agg(F.collect_set("depth").alias("_depths")))
    placed = points.withColumn("_box", box.select(F.struct("y", "x", "side")).scalar())
    most = F.lit(4 ** DEPTH - 1).cast("double")
    smallest = lambda v, edge: F.when(known, F.least(F.floor((v - F.col(f"_box.{edge}")) / F.col("_box.side") * F.lit(4.0 ** DEPTH)), most))
    placed = placed.withColumns({"_py": smallest(y, "y"), "_px": smallest(x, "x")})
    placed = placed.withColumns({"_gy": _at_depth(F.col("_py"), COARSE), "_gx": _at_depth(F.col("_px"), COARSE)})
    asked = placed.join(depths, ["_gy", "_gx"], "left").withColumn("_depth", F.explode_outer("_depths"))
    asked = asked.withColumns({"_cy": _at_depth(F.col("_py"), F.col("_depth")), "_cx": _at_depth(F.col("_px"), F.col("_depth"))})
    # A point is in exactly one cell; of the depths below its coarse cell the others find nothing.
    cells = index.toDF("_depth", "_cy", "_cx", "_near")
    met = asked.join(cells, ["_depth", "_cy", "_cx"], "left").filter(F.col("_near").isNotNull() | F.col("_depth").isNull())
    hit = F.array_min(F.transform("_near", lambda e: F.struct(_gap2(lat, lon, e["_zlat"], e["_zlon"]).alias("d2"), e["z"].alias("z"))))
    found = met.withColumn("_hit", hit)
    return found.select(*[F.col(c) for c in points.columns], *[F.col(f"_hit.z.{a}").alias(a) for a in attributes])


def segments_to_zones(segments: DataFrame, places: DataFrame, zones: DataFrame, **kw) -> DataFrame:
    """Road segments to zones by their start point, else their end point; others are dropped.

    ``places`` has one row per point name: (place, lat, lon).
    """
    spot = places.select("place", F.struct("lat", "lon").alias("at"))
    start = spot.select(F.col("place").alias("start_point"), F.col("at").alias("_start"))
    end = spot.select(F.col("place").alias("end_point"), F.col("at").alias("_end"))
    located = (segments.join(start, "start_point", "left").join(end, "end_point", "left")
               .withColumn("_at", F.coalesce("_start", "_end")).filter(F.col("_at").isNotNull())
               .withColumns({"_lat": F.col("_at.lat"), "_lon": F.col("_at.lon")}).drop("_start", "_end", "_at"))
    placed = nearest_zone(located, zones, "_lat", "_lon", **{"attributes": ["zone_id", "zone_name"], **kw})
    return placed.select(*segments.columns, "zone_id", "zone_name")
