"""The plane and height predicates as SQL functions of a session, for use in ``spark.sql``. Catalyst inlines them: no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geometry import POINT_SQ

_POINT = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
_DX, _DY = "(b.x - a.x)", "(b.y - a.y)"
_LEN_SQ = f"({_DX} * {_DX} + {_DY} * {_DY})"
_TO_A = "sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y))"
_T = f"CASE WHEN {_LEN_SQ} <= {POINT_SQ}D THEN 0D ELSE try_divide((p.x - a.x) * {_DX} + (p.y - a.y) * {_DY}, {_LEN_SQ}) END"
_ON = f"greatest(0D, least(1D, {_T}))"
_TO_SEGMENT = f"CASE WHEN {_LEN_SQ} <= {POINT_SQ}D THEN {_TO_A} ELSE sqrt(pow(p.x - (a.x + {_ON} * {_DX}), 2) + pow(p.y - (a.y + {_ON} * {_DY}), 2)) END"
_TO_LINE = f"CASE WHEN {_LEN_SQ} <= {POINT_SQ}D THEN {_TO_A} ELSE try_divide(abs({_DX} * (p.y - a.y) - {_DY} * (p.x - a.x)), sqrt({_LEN_SQ})) END"

#: Name to parameters, type and body. Points are structs of x, y and z; a null point or threshold gives null.
FUNCTIONS = {
    "centroid_distance": (f"a {_POINT}, b {_POINT}", "DOUBLE", "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"),
    "segment_position_xy": (f"p {_POINT}, a {_POINT}, b {_POINT}", "DOUBLE", _T),
    "segment_distance_xy": (f"p {_POINT}, a {_POINT}, b {_POINT}", "DOUBLE", f"CASE WHEN p IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN {_TO_SEGMENT} END"),
    "line_distance_xy": (f"p {_POINT}, a {_POINT}, b {_POINT}", "DOUBLE", _TO_LINE),
    "between_xy": (f"p {_POINT}, a {_POINT}, b {_POINT}, tau DOUBLE", "BOOLEAN", f"CASE WHEN p IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND tau IS NOT NULL THEN ({_T}) BETWEEN 0 AND 1 AND ({_TO_SEGMENT}) <= tau END"),
    "aligned_xy": (f"a {_POINT}, b {_POINT}, p {_POINT}, tau DOUBLE", "BOOLEAN", f"({_TO_LINE}) <= tau"),
    "above": ("min_z DOUBLE, max_z DOUBLE, tau DOUBLE", "BOOLEAN", "min_z >= max_z - tau"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes FUNCTIONS temporary functions of the session; the names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
