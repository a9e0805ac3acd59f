"""Geographic column functions (I1-I6). Angles in degrees, results as stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s1 = F.sin(F.radians(lat2 - lat1) / 2.0)
    s2 = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    # greatest/least would turn a missing coordinate into a distance
    a = F.when(a > 1.0, 1.0).when(a < 0.0, 0.0).otherwise(a)
    return F.lit(2.0 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def point_segment_km(plat, plon, alat, alon, blat, blon, *, mean_of_three: bool = True) -> Column:
    """Distance of a point to a straight leg on a local equirectangular plane.

    The reference latitude is the mean of all three points, or only of the leg's
    ends for corridor selection.
    """
    plat, plon, alat, alon, blat, blon = map(_c, (plat, plon, alat, alon, blat, blon))
    lat0 = (alat + blat + plat) / 3.0 if mean_of_three else (alat + blat) / 2.0
    kx = F.cos(F.radians(lat0)) * KM_PER_DEGREE
    px, py = plon * kx, plat * KM_PER_DEGREE
    ax, ay = alon * kx, alat * KM_PER_DEGREE
    dx, dy = blon * kx - ax, blat * KM_PER_DEGREE - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))
    )
    return hypot(px - (ax + t * dx), py - (ay + t * dy))


def lon_scale(lat, floor: float = 0.2) -> Column:
    """Shrink factor of a degree of longitude, floored near the poles."""
    return F.greatest(F.cos(F.radians(_c(lat))), F.lit(floor))


def buffered_bbox(min_lat, max_lat, min_lon, max_lon, mean_lat, buffer_km) -> Column:
    """Struct (north, south, east, west) grown by a buffer in km."""
    min_lat, max_lat, min_lon, max_lon, mean_lat, buffer_km = map(
        _c, (min_lat, max_lat, min_lon, max_lon, mean_lat, buffer_km)
    )
    dlat = buffer_km / KM_PER_DEGREE
    dlon = buffer_km / (F.lit(KM_PER_DEGREE) * lon_scale(mean_lat))
    return F.struct(
        (max_lat + dlat).alias("north"),
        (min_lat - dlat).alias("south"),
        (max_lon + dlon).alias("east"),
        (min_lon - dlon).alias("west"),
    )


def bbox_area_km2(north, south, east, west) -> Column:
    north, south, east, west = map(_c, (north, south, east, west))
    return (
        F.abs(north - south) * KM_PER_DEGREE
        * (F.abs(east - west) * KM_PER_DEGREE * lon_scale((north + south) / 2.0))
    )


def bbox_is_valid(north, south, east, west) -> Column:
    north, south, east, west = map(_c, (north, south, east, west))
    return F.coalesce(
        (south >= -90) & (south < north) & (north <= 90)
        & (west >= -180) & (west < east) & (east <= 180),
        F.lit(False),
    )


def bbox_covers(north, south, east, west, lat, lon, mean_lat, margin_km: float) -> Column:
    north, south, east, west, lat, lon = map(_c, (north, south, east, west, lat, lon))
    dlat = margin_km / KM_PER_DEGREE
    dlon = F.lit(margin_km) / (F.lit(KM_PER_DEGREE) * lon_scale(mean_lat))
    return lat.between(south - dlat, north + dlat) & lon.between(west - dlon, east + dlon)


def interpolate_leg(alat, alon, blat, blon, steps: int = 12) -> Column:
    """Array of (lat, lon) structs at equal parameter steps, both ends included."""
    alat, alon, blat, blon = map(_c, (alat, alon, blat, blon))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(
            (alat + (blat - alat) * i / float(steps)).alias("lat"),
            (alon + (blon - alon) * i / float(steps)).alias("lon"),
        ),
    )


def two_leg_polyline(olat, olon, mlat, mlon, dlat, dlon, steps: int = 12) -> Column:
    first = interpolate_leg(olat, olon, mlat, mlon, steps)
    second = interpolate_leg(mlat, mlon, dlat, dlon, steps)
    return F.concat(first, F.slice(second, 2, steps))


def metric_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the sphere, or plain planar length when values are projected."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    geographic = (
        lat1.between(-90, 90) & lat2.between(-90, 90)
        & lon1.between(-180, 180) & lon2.between(-180, 180)
    )
    return F.when(geographic, haversine_km(lat1, lon1, lat2, lon2) * 1000.0).otherwise(
        hypot(lat2 - lat1, lon2 - lon1)
    )


def format_distance(km) -> Column:
    """Readable distance: metres below one km, otherwise km with 1-2 decimals
    and a decimal comma with dot groups."""
    km = _c(km)
    cents = F.round(km * 100.0).cast("long")
    whole = F.reverse(
        F.regexp_replace(F.reverse(F.floor(cents / 100).cast("string")), r"(\d{3})(?=\d)", "$1.")
    )
    decimals = F.lpad((cents % 100).cast("string"), 2, "0")
    decimals = F.when(F.substring(decimals, 2, 1) == "0", F.substring(decimals, 1, 1)).otherwise(decimals)
    return (
        F.when(km.isNull() | F.isnan(km), "N/A")
        .when(km < 1.0, F.concat(F.floor(km * 1000.0 + 0.5).cast("long").cast("string"), F.lit(" m")))
        .otherwise(F.concat(whole, F.lit(","), decimals, F.lit(" km")))
    )
