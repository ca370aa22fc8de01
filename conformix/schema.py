"""Types, status words and unit tables."""

from __future__ import annotations

from pyspark.sql import types as T

STATUSES = ("FAIL", "WARNING", "PASS", "UNKNOWN")

# Millimetres of a length unit.
UNIT_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "ft": 304.8}

EPS = 1e-6  # in rule units, for comparisons
CIRCLE_VERTICES = 180
GEOMETRIC = ("polyline", "circle")

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

ENTITY = T.StructType(
    [
        T.StructField("drawing_key", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("eid", T.StringType()),
        T.StructField("handle", T.StringType()),
        T.StructField("layer", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("points", T.ArrayType(POINT)),
        T.StructField("closed", T.BooleanType()),
        T.StructField("cx", T.DoubleType()),
        T.StructField("cy", T.DoubleType()),
        T.StructField("radius", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_height", T.DoubleType()),
        T.StructField("z_known", T.BooleanType()),
        T.StructField("z_min", T.DoubleType()),
        T.StructField("z_max", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("minx", T.DoubleType()),
        T.StructField("miny", T.DoubleType()),
        T.StructField("maxx", T.DoubleType()),
        T.StructField("maxy", T.DoubleType()),
    ]
)
