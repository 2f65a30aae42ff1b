"""The engine's relations."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("dir", T.StringType(), False), T.StructField("stem", T.StringType(), False), T.StructField("suffix", T.StringType(), False), T.StructField("length", T.LongType(), False)])
ANNOTATIONS = T.StructType([T.StructField("path", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("class_id", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("xc", "yc", "w", "h"))])
POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
POLYGONS = T.StructType([T.StructField("path", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("class_id", T.IntegerType()), T.StructField("points", POINTS)])
IMAGES = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("height", "width", "channels")), T.StructField("data", T.BinaryType())])
DETECTIONS = T.StructType([T.StructField("path", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("model", T.IntegerType()), T.StructField("det_no", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")), T.StructField("class_id", T.IntegerType()), T.StructField("conf", T.DoubleType())])
PLAN = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("action", T.StringType())])
CLASSES = T.StructType([T.StructField("class_id", T.IntegerType()), T.StructField("name", T.StringType())])
