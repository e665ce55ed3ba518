"""Square lattice in local metres, distances, rings.

Everything is multiply/floor arithmetic on columns, so Spark generates code for it and a cell id can
be recomputed from coordinates anywhere. Replace the functions of the first section to move to
another grid; nothing else knows how an id is built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Origin, degree length, cosine of the reference latitude, earth radii, city box.
ORIGIN_LON = -74.30
ORIGIN_LAT = 40.45
METRES_PER_DEGREE = 111320.0
COS_LAT = 0.7580107
EARTH_RADIUS_M = 6371000.0
EARTH_RADIUS_LOCAL_M = 6371008.8
FINE_CELL_M = 300.0
PARENT_FACTOR = 3
CITY_BOX = (40.45, 40.95, -74.30, -73.65)
CITY_BOX_WIDE = (40.4, 41.0, -74.3, -73.6)

_HALF = 1 << 20
_SPAN = 1 << 21


def metres_x(lon: Column) -> Column:
    return (lon - F.lit(ORIGIN_LON)) * F.lit(METRES_PER_DEGREE) * F.lit(COS_LAT)


def metres_y(lat: Column) -> Column:
    return (lat - F.lit(ORIGIN_LAT)) * F.lit(METRES_PER_DEGREE)


def lon_of(x: Column) -> Column:
    return x / F.lit(METRES_PER_DEGREE) / F.lit(COS_LAT) + F.lit(ORIGIN_LON)


def lat_of(y: Column) -> Column:
    return y / F.lit(METRES_PER_DEGREE) + F.lit(ORIGIN_LAT)


def pack(ix: Column, iy: Column) -> Column:
    """Lattice indexes to one BIGINT id."""
    return (ix.cast("bigint") + F.lit(_HALF)) * F.lit(_SPAN) + (iy.cast("bigint") + F.lit(_HALF))


def cell_ix(cell: Column) -> Column:
    return F.floor(cell / F.lit(_SPAN)).cast("bigint") - F.lit(_HALF)


def cell_iy(cell: Column) -> Column:
    return F.pmod(cell, F.lit(_SPAN)).cast("bigint") - F.lit(_HALF)


def cell_at(x: Column, y: Column, size: float = FINE_CELL_M) -> Column:
    return pack(F.floor(x / F.lit(size)), F.floor(y / F.lit(size)))


def cell(lat: Column, lon: Column) -> Column:
    """Fine cell of a point; NULL when a coordinate is NULL."""
    return cell_at(metres_x(lon), metres_y(lat))


def parent(fine: Column) -> Column:
    """Coarse cell holding a fine cell."""
    return pack(
        F.floor(cell_ix(fine) / F.lit(PARENT_FACTOR)), F.floor(cell_iy(fine) / F.lit(PARENT_FACTOR))
    )


def centre_x(cell_id: Column, size: float = FINE_CELL_M) -> Column:
    return (cell_ix(cell_id) + F.lit(0.5)) * F.lit(size)


def centre_y(cell_id: Column, size: float = FINE_CELL_M) -> Column:
    return (cell_iy(cell_id) + F.lit(0.5)) * F.lit(size)


def centre_lat(cell_id: Column, size: float = FINE_CELL_M) -> Column:
    return lat_of(centre_y(cell_id, size))


def centre_lon(cell_id: Column, size: float = FINE_CELL_M) -> Column:
    return lon_of(centre_x(cell_id, size))


def ring(cell_id: Column, size: float = FINE_CELL_M) -> Column:
    """Closed boundary ring of a cell: five (lon, lat) vertices, counter-clockwise."""
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return F.array(
        *[
            F.struct(
                lon_of((cell_ix(cell_id) + F.lit(dx)) * F.lit(size)).alias("lon"),
                lat_of((cell_iy(cell_id) + F.lit(dy)) * F.lit(size)).alias("lat"),
            )
            for dx, dy in corners
        ]
    )


def square(c: Column) -> Column:
    return c * c


def fast_distance_sq_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Flat-earth squared metres, the predicate of every radius rule."""
    dy = (lat_a - lat_b) * F.lit(METRES_PER_DEGREE)
    dx = (lon_a - lon_b) * F.lit(METRES_PER_DEGREE) * F.lit(COS_LAT)
    return square(dx) + square(dy)


def fast_distance_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    return F.sqrt(fast_distance_sq_m(lat_a, lon_a, lat_b, lon_b))


def haversine_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half_lat = F.sin(F.radians(lat_b - lat_a) / 2)
    half_lon = F.sin(F.radians(lon_b - lon_a) / 2)
    h = square(half_lat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * square(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bbox(lat: Column, lon: Column, radius_m: Column | float) -> Column:
    """Degree box around a point; the cosine never falls below 0.1."""
    r = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    d_lat = r / F.lit(METRES_PER_DEGREE)
    d_lon = r / (F.lit(METRES_PER_DEGREE) * F.greatest(F.lit(0.1), F.cos(F.radians(lat))))
    return F.struct(
        (lat - d_lat).alias("lat_min"),
        (lat + d_lat).alias("lat_max"),
        (lon - d_lon).alias("lon_min"),
        (lon + d_lon).alias("lon_max"),
    )


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float] = CITY_BOX) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def valid_coord(lat: Column, lon: Column) -> Column:
    """Finite and on the globe."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok, F.lit(False))


def project_local(lat: Column, lon: Column, mean_lat: Column, mean_lon: Column) -> Column:
    """Metres east and north of a mean point."""
    return F.struct(
        (
            F.radians(lon - mean_lon) * F.lit(EARTH_RADIUS_LOCAL_M) * F.cos(F.radians(mean_lat))
        ).alias("x_m"),
        (F.radians(lat - mean_lat) * F.lit(EARTH_RADIUS_LOCAL_M)).alias("y_m"),
    )


def circle_ring(lat: Column, lon: Column, radius_m: float, n: int = 64) -> Column:
    """Closed geodesic circle: n vertices plus the first again, 7 decimals."""
    angular = radius_m / EARTH_RADIUS_M
    lat_r, lon_r = F.radians(lat), F.radians(lon)

    def vertex(i: Column) -> Column:
        bearing = F.pmod(i, F.lit(n)) * F.lit(2.0 * 3.141592653589793 / n)
        out_lat = F.asin(
            F.sin(lat_r) * F.cos(F.lit(angular))
            + F.cos(lat_r) * F.sin(F.lit(angular)) * F.cos(bearing)
        )
        out_lon = lon_r + F.atan2(
            F.sin(bearing) * F.sin(F.lit(angular)) * F.cos(lat_r),
            F.cos(F.lit(angular)) - F.sin(lat_r) * F.sin(out_lat),
        )
        return F.struct(
            F.round(F.degrees(out_lon), 7).alias("lon"), F.round(F.degrees(out_lat), 7).alias("lat")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(n)), vertex)


def wkt_vertices(wkt: Column) -> Column:
    """(lon, lat) pairs of a WKT text; a pair of bare integers is skipped."""
    # taken from the text once; possessive, so a run of digits is never tried again
    pairs = F.regexp_extract_all(wkt, F.lit(r"-?\d++\.\d++\s++-?\d++\.\d++"), F.lit(0))
    return F.transform(
        F.transform(pairs, lambda p: F.split(p, r"\s+")),
        lambda p: F.struct(F.get(p, 0).cast("double").alias("lon"), F.get(p, 1).cast("double").alias("lat")),
    )


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, as the variable of a one-element transform."""
    return F.get(F.transform(F.array(value), body), 0)


def polygon_centroid(wkt: Column) -> Column:
    """Area centroid of the outer ring of a WKT polygon; NULL when empty or invalid."""
    outer = F.regexp_extract(wkt, r"(?i)POLYGON\s*\(+\s*([^()]*)\)", 1)

    def of_ring(v: Column) -> Column:
        n = F.size(v)
        base_lon, base_lat = v[0]["lon"], v[0]["lat"]
        edges = F.zip_with(
            F.slice(v, F.lit(1), n - 1),
            F.slice(v, F.lit(2), n - 1),
            lambda p, q: F.struct(
                (p["lon"] - base_lon).alias("x0"),
                (p["lat"] - base_lat).alias("y0"),
                (q["lon"] - base_lon).alias("x1"),
                (q["lat"] - base_lat).alias("y1"),
            ),
        )

        def step(acc: Column, e: Column) -> Column:
            cross = e["x0"] * e["y1"] - e["x1"] * e["y0"]
            return F.struct(
                (acc["a"] + cross).alias("a"),
                (acc["x"] + (e["x0"] + e["x1"]) * cross).alias("x"),
                (acc["y"] + (e["y0"] + e["y1"]) * cross).alias("y"),
            )

        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        total = F.aggregate(edges, zero, step)
        return F.when(
            n >= 4,
            let(
                total,
                lambda t: F.when(
                    t["a"] != 0,
                    F.struct(
                        (base_lon + t["x"] / (t["a"] * 3)).alias("lon"),
                        (base_lat + t["y"] / (t["a"] * 3)).alias("lat"),
                    ),
                ),
            ),
        )

    return let(outer, lambda o: F.when(F.length(o) > 0, let(wkt_vertices(o), of_ring)))


def from_web_mercator(x: Column, y: Column) -> Column:
    """EPSG:3857 metres to (lon, lat)."""
    r = 6378137.0
    return F.struct(
        F.degrees(x / F.lit(r)).alias("lon"),
        F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(r))) - F.lit(1.5707963267948966)).alias("lat"),
    )


def from_state_plane_li(x: Column, y: Column) -> Column:
    """EPSG:2263 (US survey feet, Lambert conformal conic, two parallels) to (lon, lat)."""
    from math import cos, pi, radians, sin, sqrt, tan, log

    # Fixed values of the projection: GRS80 axis and flattening, parallels, origin, false easting.
    a, f = 6378137.0, 1 / 298.257222101
    lat1, lat2 = radians(41 + 2 / 60), radians(40 + 40 / 60)
    lat0, lon0 = radians(40 + 10 / 60), radians(-74.0)
    false_easting_m, foot = 300000.0, 1200.0 / 3937.0
    e = sqrt(2 * f - f * f)

    def m(p: float) -> float:
        return cos(p) / sqrt(1 - (e * sin(p)) ** 2)

    def t(p: float) -> float:
        return tan(pi / 4 - p / 2) / ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2)

    n = (log(m(lat1)) - log(m(lat2))) / (log(t(lat1)) - log(t(lat2)))
    big_f = m(lat1) / (n * t(lat1) ** n)
    rho0 = a * big_f * t(lat0) ** n
    dx = x * F.lit(foot) - F.lit(false_easting_m)
    dy = F.lit(rho0) - y * F.lit(foot)
    rho = F.sqrt(dx * dx + dy * dy)
    tt = F.pow(rho / F.lit(a * big_f), F.lit(1.0 / n))
    theta = F.atan2(dx, dy)
    phi = F.lit(pi / 2) - 2 * F.atan(tt)
    for _ in range(5):
        s = F.lit(e) * F.sin(phi)
        phi = F.lit(pi / 2) - 2 * F.atan(tt * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
    return F.struct(
        F.degrees(theta / F.lit(n) + F.lit(lon0)).alias("lon"), F.degrees(phi).alias("lat")
    )


def transform_coords(x: Column, y: Column, crs: str) -> Column:
    """Projected metres or feet to (lon, lat); anything not finite becomes NULL."""
    known = {
        "EPSG:3857": from_web_mercator,
        "EPSG:2263": from_state_plane_li,
        "EPSG:4326": lambda a, b: F.struct(a.alias("lon"), b.alias("lat")),
    }
    if crs not in known:
        raise ValueError(f"unsupported reference system: {crs}")
    out = known[crs](x.try_cast("double"), y.try_cast("double"))
    big = F.lit(1e300)
    finite = (F.abs(out["lon"]) < big) & (F.abs(out["lat"]) < big)
    return F.when(F.coalesce(finite, F.lit(False)), out)
