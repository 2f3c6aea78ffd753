"""Great-circle membership as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the sphere's radius in metres.
RADIUS = 6371007.180918475


def metres(point: Column, lat: float, lng: float) -> Column:
    """Haversine distance of a GeoPoint column from a fixed point."""
    a, b = F.radians(point["lat_deg"]), math.radians(lat)
    dlat, dlng = F.radians(point["lat_deg"] - lat), F.radians(point["lng_deg"] - lng)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(a) * math.cos(b) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * RADIUS) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def within(point: Column, lat: float, lng: float, meters: float) -> Column:
    """Whether a point is at most ``meters`` away, by bounds that scans can prune with first."""
    near = metres(point, lat, lng) <= meters
    reach = math.degrees(meters / RADIUS) * (1 + 1e-9) + 1e-9
    box = (point["lat_deg"] >= lat - reach) & (point["lat_deg"] <= lat + reach)
    if abs(lat) + reach < 89.9:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(90.0, reach))) / math.cos(math.radians(lat))))) * (1 + 1e-9) + 1e-9
        if lng - wide >= -180 and lng + wide < 180:
            box = box & (point["lng_deg"] >= lng - wide) & (point["lng_deg"] <= lng + wide)
    return point.isNotNull() & box & near
