"""Every query over the driver's tables, with the SQL that checks it.

The tables hold no annotations, so a view derives them from ``lineitem``: an
image is an order, a line an object.  ``detections`` adds a confidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import formats, geometry, names, pixels
from lumenframe.operators import aggregates, augment, filters, joins, splits
from lumenframe.sources import files, labels, sinks
from lumenframe.sources.labels import Hyperparameters
from lumenframe.streaming import live

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ANN = """SELECT l_orderkey AS image_id, l_linenumber - 1 AS class_id, (l_partkey % 1000) / 1e3 AS xc, (l_suppkey % 97) / 97e0 AS yc,
 l_quantity / 1e2 AS w, (l_discount * 5e0 + 1e-2) AS h, CAST(480 + (l_orderkey % 5) * 160 AS INT) AS img_h, CAST(640 + (l_orderkey % 7) * 128 AS INT) AS img_w,
 l_tax * 12e0 AS conf, l_partkey, l_suppkey, l_linenumber FROM lineitem"""
CORNERS = ("x1", "y1", "x2", "y2")
CENTRES = ("xc", "yc", "w", "h")
CLASS_NAMES = ("car", "taxi", "pickup", "bus", "truck", "motor", "bike")
_CLASSES_SQL = "(VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(CLASS_NAMES)) + ") c(class_id, name)"
#: Corners of the annotation view in pixels, in SQL.
_PX = "img_w * (xc - w / 2) AS x1, img_h * (yc - h / 2) AS y1, img_w * (xc + w / 2) AS x2, img_h * (yc + h / 2) AS y2"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH ann AS ({ANN}) {sql}" if " ann" in sql else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("image_id"), (c("l_linenumber") - 1).alias("class_id"), ((c("l_partkey") % 1000) / 1e3).alias("xc"), ((c("l_suppkey") % 97) / 97.0).alias("yc"),
        (c("l_quantity") / 1e2).alias("w"), (c("l_discount") * 5.0 + 1e-2).alias("h"), (480 + (c("l_orderkey") % 5) * 160).cast("int").alias("img_h"), (640 + (c("l_orderkey") % 7) * 128).cast("int").alias("img_w"),
        (c("l_tax") * 12.0).alias("conf"), "l_partkey", "l_suppkey", "l_linenumber",
    )


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, name string")


def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geometry.xywhn_to_xyxy(*CENTRES, "img_w", "img_h")
    return ann(spark, sf_dir).withColumns(dict(zip(CORNERS, box, strict=True)))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and its vector as points, half each way, scaled to 640 pixels about the middle."""
    v = F.col("embedding")
    n = (F.size(v) / 2).cast("int")
    pair = lambda k: F.struct((F.get(v, k * 2).cast("double") * 640 + 320).alias("x"), (F.get(v, k * 2 + 1).cast("double") * 640 + 320).alias("y"))
    return table(spark, sf_dir, "embeddings").where(F.size(v) > 1).select("vec_id", F.transform(F.sequence(F.lit(0), n - 1), pair).alias("points"))


_POINTS = "p AS (SELECT vec_id, list_transform(generate_series(1, CAST(len(embedding) // 2 AS BIGINT)), lambda k: {'x': CAST(embedding[2 * k - 1] AS DOUBLE) * 640 + 320, 'y': CAST(embedding[2 * k] AS DOUBLE) * 640 + 320}) AS points FROM embeddings WHERE len(embedding) > 1)"


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda v: F.pmod(F.floor(F.abs(v.cast("double")) * 1000), F.lit(256)).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", byte).alias("px"))


_VALUES = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256 AS INT)) AS px FROM embeddings)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the manner of a dataset tree, from pages and documents."""
    return files.with_parts(table(spark, sf_dir, "pages").select(F.concat(F.lit("data/d"), (F.col("page_id") % 7).cast("string"), F.lit("/img-"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % len(_ENDS) + 1).cast("int"))).alias("path"), F.length("html").cast("long").alias("length")))


_ENDS = (".jpg", ".PNG", ".jpeg", ".mp4", ".txt", ".bmp", ".JPEG", ".mkv", ".jng", "")
_PATHS = "f AS (SELECT page_id, 'data/d' || CAST(page_id % 7 AS VARCHAR) || '/img-' || CAST(page_id AS VARCHAR) || [" + ", ".join(f"'{e}'" for e in _ENDS) + "][CAST(page_id % 10 + 1 AS INTEGER)] AS path, CAST(length(html) AS BIGINT) AS length FROM pages)"
_SUFFIX = "regexp_extract(path, '[^/]\\.([^./]+)$', 1)"


# Geometry


@query("xywh_to_xyxy", "SELECT image_id, xc - w / 2 AS x1, yc - h / 2 AS y1, xc + w / 2 AS x2, yc + h / 2 AS y2 FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", *(v.alias(k) for k, v in zip(CORNERS, geometry.xywh_to_xyxy(*CENTRES), strict=True)))


@query("xywhn_to_xyxy", "SELECT image_id, img_w * (xc - w / 2) + 8 AS x1, img_h * (yc - h / 2) + 4 AS y1, img_w * (xc + w / 2) + 8 AS x2, img_h * (yc + h / 2) + 4 AS y2 FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", *(v.alias(k) for k, v in zip(CORNERS, geometry.xywhn_to_xyxy(*CENTRES, "img_w", "img_h", 8, 4), strict=True)))


@query("xyxy_to_xywh", "SELECT image_id, (xc + (xc + w)) / 2 AS xc, (yc + (yc + h)) / 2 AS yc, (xc + w) - xc AS w, (yc + h) - yc AS h FROM ann")
def _(spark, sf):
    box = geometry.xyxy_to_xywh("xc", "yc", F.col("xc") + F.col("w"), F.col("yc") + F.col("h"))
    return ann(spark, sf).select("image_id", *(v.alias(k) for k, v in zip(CENTRES, box, strict=True)))


@query("normalise_boxes", "SELECT image_id, xc * 100 / img_w AS xc, yc * 100 / img_h AS yc, w * 100 / img_w AS w, h * 100 / img_h AS h FROM ann")
def _(spark, sf):
    box = geometry.normalise([F.col(c) * 100 for c in CENTRES], "img_w", "img_h")
    return ann(spark, sf).select("image_id", *(v.alias(k) for k, v in zip(CENTRES, box, strict=True)))


def _rounded(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INT)"


@query("denorm_round", "SELECT image_id, " + ", ".join(f"{_rounded(f'{c} * {s} {o} ({d} * {s}) / 2')} AS {n}" for c, d, s, o, n in (("xc", "w", "img_w", "-", "x1"), ("yc", "h", "img_h", "-", "y1"), ("xc", "w", "img_w", "+", "x2"), ("yc", "h", "img_h", "+", "y2"))) + " FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", *(v.alias(k) for k, v in zip(CORNERS, geometry.pixel_corners(*CENTRES, "img_w", "img_h"), strict=True)))


@query("denorm_trunc", "SELECT image_id, CAST(trunc((xc - w / 2) * img_w) AS INT) AS x1, CAST(trunc((yc - h / 2) * img_h) AS INT) AS y1, CAST(trunc((xc + w / 2) * img_w) AS INT) AS x2, CAST(trunc((yc + h / 2) * img_h) AS INT) AS y2 FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", *(v.alias(k) for k, v in zip(CORNERS, geometry.truncated_corners(*CENTRES, "img_w", "img_h"), strict=True)))


_LETTER = f"""a AS (SELECT *, least(640e0 / img_h, 640e0 / img_w) AS ratio FROM ann),
b AS (SELECT *, {_rounded('img_w * ratio')} AS inner_w, {_rounded('img_h * ratio')} AS inner_h FROM a),
c AS (SELECT *, ((640 - inner_w) % 32) / 2e0 AS dw, ((640 - inner_h) % 32) / 2e0 AS dh FROM b)"""


@query("letterbox_params", f", {_LETTER} SELECT image_id, ratio, inner_w, inner_h, dw, dh, {_rounded('dh - 1e-1')} AS \"top\", {_rounded('dh + 1e-1')} AS bottom, {_rounded('dw - 1e-1')} AS \"left\", {_rounded('dw + 1e-1')} AS \"right\" FROM c")
def _(spark, sf):
    box = geometry.letterbox("img_w", "img_h")
    return ann(spark, sf).select("image_id", *(getattr(box, c).alias(c) for c in ("ratio", "inner_w", "inner_h", "dw", "dh", "top", "bottom", "left", "right")))


@query("unletterbox", f", {_LETTER}, d AS (SELECT *, {_PX} FROM c) SELECT image_id, " + ", ".join(f"{_rounded(f'(({c} * ratio + {d}) - {d}) / ratio')} AS {c}" for c, d in (("x1", "dw"), ("y1", "dh"), ("x2", "dw"), ("y2", "dh"))) + " FROM d")
def _(spark, sf):
    box = geometry.letterbox("img_w", "img_h")
    rows = pixel_boxes(spark, sf).withColumns({"ratio": box.ratio, "dw": box.dw, "dh": box.dh})
    inside = [F.col(c) * F.col("ratio") + F.col(d) for c, d in zip(CORNERS, ("dw", "dh", "dw", "dh"), strict=True)]
    return rows.select("image_id", *(v.alias(k) for k, v in zip(CORNERS, geometry.unletterbox(inside, "ratio", "dw", "dh"), strict=True)))


@query("voc_to_yolo", """, o AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 300 AS DOUBLE) AS xmin, CAST(l_suppkey % 200 AS DOUBLE) AS ymin, CAST(l_partkey % 300 + l_linenumber * 10 AS DOUBLE) AS xmax, CAST(l_suppkey % 200 + l_linenumber * 7 AS DOUBLE) AS ymax,
 CAST(640 + (l_orderkey % 7) * 128 AS DOUBLE) AS iw, CAST(480 + (l_orderkey % 5) * 160 AS DOUBLE) AS ih, l_linenumber - 1 AS class_id FROM lineitem)
SELECT image_id, class_id, (xmin + xmax) / (2 * iw) AS xc, (ymin + ymax) / (2 * ih) AS yc, (xmax - xmin) / iw AS w, (ymax - ymin) / ih AS h FROM o, (SELECT 1 FROM ann LIMIT 1)""")
def _(spark, sf):
    a = ann(spark, sf)
    at = {"xmin": F.col("l_partkey") % 300, "ymin": F.col("l_suppkey") % 200, "xmax": F.col("l_partkey") % 300 + F.col("l_linenumber") * 10, "ymax": F.col("l_suppkey") % 200 + F.col("l_linenumber") * 7}
    box = F.concat(*(F.concat(F.lit(f"<{k}>"), v.cast("string"), F.lit(f"</{k}>")) for k, v in at.items()))
    name = F.element_at(F.array(*map(F.lit, CLASS_NAMES)), F.col("class_id") + 1)
    xml = F.concat(F.lit("<annotation><size><width>"), F.col("img_w").cast("string"), F.lit("</width><height>"), F.col("img_h").cast("string"), F.lit("</height></size><object><name>"), name, F.lit("</name><bndbox>"), box, F.lit("</bndbox></object></annotation>"))
    objects = joins.class_ids(labels.parse_voc(a.select("image_id", xml.alias("text"))), classes(spark))
    return objects.select("image_id", "class_id", *(v.alias(k) for k, v in zip(CENTRES, geometry.voc_to_yolo("xmin", "ymin", "xmax", "ymax", "width", "height"), strict=True)))


@query("box_candidates", f""", b AS (SELECT *, {_PX} FROM ann), c AS (SELECT *, x1 AS a1, y1 AS b1, x1 + (x2 - x1) * conf AS a2, y1 + (y2 - y1) * 5e-1 AS b2 FROM b)
SELECT image_id, (a2 - a1 > 2) AND (b2 - b1 > 2) AND ((a2 - a1) * (b2 - b1) / ((x2 - x1) * (y2 - y1) + 1e-16) > 1e-1) AND (greatest((a2 - a1) / ((b2 - b1) + 1e-16), (b2 - b1) / ((a2 - a1) + 1e-16)) < 20) AS candidate FROM c""")
def _(spark, sf):
    after = ("x1", "y1", F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("conf"), F.col("y1") + (F.col("y2") - F.col("y1")) * 0.5)
    return pixel_boxes(spark, sf).select("image_id", geometry.box_candidates(CORNERS, after).alias("candidate"))


@query("clip_and_center_filter", f", b AS (SELECT *, {_PX} FROM ann) SELECT image_id, " + ", ".join(f"least(greatest({c}, 0e0), CAST({s} AS DOUBLE)) AS {c}" for c, s in zip(CORNERS, ("img_w", "img_h") * 2, strict=True)) + " FROM b WHERE (x1 + x2) / 2 > 0 AND (x1 + x2) / 2 < img_w AND (y1 + y2) / 2 > 0 AND (y1 + y2) / 2 < img_h")
def _(spark, sf):
    return filters.centred(pixel_boxes(spark, sf), size=("img_w", "img_h")).select("image_id", *CORNERS)


@query("point_outside", "SELECT image_id, NOT (xc * 900 >= 0 AND xc * 900 <= img_w - 1 AND yc * 700 >= 0 AND yc * 700 <= img_h - 1) AS outside FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", geometry.point_outside(F.col("xc") * 900, F.col("yc") * 700, "img_w", "img_h").alias("outside"))


@query("segment_to_box", f"WITH {_POINTS}, q AS (SELECT vec_id, list_filter(points, lambda p: p.x >= 0 AND p.y >= 0 AND p.x <= 400 AND p.y <= 400) AS s FROM p), r AS (SELECT vec_id, list_transform(s, lambda p: p.x) AS xs, list_transform(s, lambda p: p.y) AS ys FROM q), t AS (SELECT *, len(list_filter(xs, lambda x: x <> 0)) > 0 AS has FROM r) SELECT vec_id, CASE WHEN has THEN list_min(xs) ELSE 0e0 END AS x1, CASE WHEN has THEN list_min(ys) ELSE 0e0 END AS y1, CASE WHEN has THEN list_max(xs) ELSE 0e0 END AS x2, CASE WHEN has THEN list_max(ys) ELSE 0e0 END AS y2 FROM t")
def _(spark, sf):
    return points(spark, sf).select("vec_id", geometry.segment_to_box("points", 400, 400).alias("b")).select("vec_id", "b.*")


@query("resample_segments", f"""WITH {_POINTS}, c AS (SELECT vec_id, len(points) AS n, list_concat(points, [points[1]]) AS closed FROM p), k AS (SELECT *, unnest(generate_series(0, 99)) AS k FROM c),
w AS (SELECT *, least(k * (n / CAST(99 AS DOUBLE)), CAST(n AS DOUBLE)) AS pos FROM k), l AS (SELECT *, least(CAST(floor(pos) AS INTEGER), n - 1) AS lo FROM w)
SELECT vec_id, CAST(k AS INTEGER) AS k, closed[lo + 1].x + (closed[lo + 2].x - closed[lo + 1].x) * (pos - lo) AS x, closed[lo + 1].y + (closed[lo + 2].y - closed[lo + 1].y) * (pos - lo) AS y FROM l""")
def _(spark, sf):
    return points(spark, sf).select("vec_id", F.posexplode(geometry.resample_polygon("points", 100)).alias("k", "p")).select("vec_id", "k", "p.x", "p.y")


@query("boundary_correct", f"""WITH {_POINTS}, e AS (SELECT vec_id, unnest(generate_series(1, len(points))) AS k, points FROM p), q AS (SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, points[k].x AS x, points[k].y AS y, 160e0 AS cx, 120e0 AS cy FROM e),
d AS (SELECT *, x - cx AS dx, y - cy AS dy, NOT (x >= 0 AND x <= 319 AND y >= 0 AND y <= 239) AS o FROM q),
h AS (SELECT *, -cx / nullif(dx, 0) AS lt, (319e0 - cx) / nullif(dx, 0) AS rt, -cy / nullif(dy, 0) AS tt, (239e0 - cy) / nullif(dy, 0) AS bt FROM d),
c AS (SELECT *, list_sort(list_filter([CASE WHEN lt >= 0 AND cy + lt * dy BETWEEN 0 AND 239 THEN [(0e0 - cx) * (0e0 - cx) + ((cy + lt * dy) - cy) * ((cy + lt * dy) - cy), 0e0, 0e0, cy + lt * dy] END,
 CASE WHEN rt >= 0 AND cy + rt * dy BETWEEN 0 AND 239 THEN [(319e0 - cx) * (319e0 - cx) + ((cy + rt * dy) - cy) * ((cy + rt * dy) - cy), 1e0, 319e0, cy + rt * dy] END,
 CASE WHEN tt >= 0 AND cx + tt * dx BETWEEN 0 AND 319 THEN [((cx + tt * dx) - cx) * ((cx + tt * dx) - cx) + (0e0 - cy) * (0e0 - cy), 2e0, cx + tt * dx, 0e0] END,
 CASE WHEN bt >= 0 AND cx + bt * dx BETWEEN 0 AND 319 THEN [((cx + bt * dx) - cx) * ((cx + bt * dx) - cx) + (239e0 - cy) * (239e0 - cy), 3e0, cx + bt * dx, 239e0] END], lambda z: z IS NOT NULL)) AS hits FROM h)
SELECT vec_id, k, (CASE WHEN o THEN coalesce(hits[1][3], cx) ELSE x END) / 320e0 AS x, (CASE WHEN o THEN coalesce(hits[1][4], cy) ELSE y END) / 240e0 AS y FROM c""")
def _(spark, sf):
    unit = geometry.scale_polygon("points", 1.0, 1.0)
    fixed = F.transform(unit, lambda p: F.struct((F.when(geometry.point_outside(p["x"], p["y"], 320, 240), geometry.to_boundary(160.0, 120.0, p["x"], p["y"], 320.0, 240.0)["x"]).otherwise(p["x"]) / 320.0).alias("x"), (F.when(geometry.point_outside(p["x"], p["y"], 320, 240), geometry.to_boundary(160.0, 120.0, p["x"], p["y"], 320.0, 240.0)["y"]).otherwise(p["y"]) / 240.0).alias("y")))
    return points(spark, sf).select("vec_id", F.posexplode(fixed).alias("k", "p")).select("vec_id", "k", "p.x", "p.y")


@query("polygon_scale", f"WITH {_POINTS}, e AS (SELECT vec_id, points, unnest(generate_series(1, len(points))) AS k FROM p) SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, points[k].x * 2e0 AS x, points[k].y * 3e0 AS y FROM e")
def _(spark, sf):
    return points(spark, sf).select("vec_id", F.posexplode(geometry.scale_polygon("points", 2.0, 3.0)).alias("k", "p")).select("vec_id", "k", "p.x", "p.y")


@query("line_thickness", f"SELECT image_id, CAST(round_even(2e-3 * (img_h + img_w) / 2, 0) + 1 AS INT) AS thickness FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", geometry.line_thickness("img_w", "img_h").alias("thickness"))


@query("playback_delay", "SELECT event_id, CASE WHEN value > 0 THEN CAST(trunc(1000e0 / nullif(value, 0)) AS INT) ELSE 33 END AS delay_ms FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", geometry.playback_delay("value").alias("delay_ms"))


# Labels


@query("count_objects", "SELECT count(*) AS n_objects FROM lineitem")
def _(spark, sf):
    return aggregates.count_objects(table(spark, sf, "lineitem"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return ann(spark, sf).select("image_id", F.concat(F.col("class_id").cast("string"), F.lit(" 0."), F.col("l_partkey").cast("string"), F.lit(" 0.5")).alias("line"))


_LINES = "t AS (SELECT image_id, CAST(class_id AS VARCHAR) || ' 0.' || CAST(l_partkey AS VARCHAR) || ' 0.5' AS line FROM ann)"


@query("class_remap_drop", f", {_LINES} SELECT image_id, CASE substring(line, 1, 1) WHEN '0' THEN '0' WHEN '1' THEN '0' WHEN '2' THEN '0' WHEN '3' THEN '1' WHEN '4' THEN '1' ELSE '2' END || substring(line, 2) AS line FROM t WHERE substring(line, 1, 1) < '6'")
def _(spark, sf):
    return filters.remap_classes(_lines(spark, sf))


@query("leading_digit_remap", f", {_LINES} SELECT image_id, CASE substring(line, 1, 1) WHEN '3' THEN '0' WHEN '4' THEN '1' WHEN '5' THEN '2' WHEN '2' THEN '3' ELSE substring(line, 1, 1) END || substring(line, 2) AS line FROM t")
def _(spark, sf):
    return _lines(spark, sf).withColumn("line", filters.remap_leading("line"))


@query("parse_box_lines", ", b AS (SELECT image_id, class_id, l_partkey FROM ann) SELECT image_id, class_id, CAST(l_partkey AS DOUBLE) AS xc, 5e-1 AS yc, CAST(NULL AS DOUBLE) AS w, 25e-2 AS h FROM b")
def _(spark, sf):
    text = F.concat(F.lit(" "), F.col("class_id").cast("string"), F.lit("\t"), F.col("l_partkey").cast("string"), F.lit("  0.5 x 0.25 "))
    return labels.parse_boxes(ann(spark, sf).select("image_id", text.alias("line"))).drop("line")


@query("parse_polygon_lines", f"WITH {_POINTS}, e AS (SELECT vec_id, points, unnest(generate_series(1, len(points))) AS k FROM p) SELECT vec_id, 3 AS class_id, CAST(k - 1 AS INTEGER) AS k, points[k].x AS x, points[k].y AS y FROM e")
def _(spark, sf):
    text = F.concat(F.lit("3 "), F.array_join(F.transform("points", lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), " "))
    parsed = labels.parse_polygons(points(spark, sf).select("vec_id", text.alias("line")))
    return parsed.select("vec_id", "class_id", F.posexplode("points").alias("k", "p")).select("vec_id", "class_id", "k", "p.x", "p.y")


@query("box_label_lines", "SELECT image_id, CAST(class_id AS VARCHAR) || printf(' %.6f %.6f %.6f %.6f', xc, yc, w, h) AS line FROM ann")
def _(spark, sf):
    return sinks.box_lines(ann(spark, sf)).select("image_id", "line")


@query("polygon_label_lines", f"WITH {_POINTS} SELECT vec_id, '1 ' || array_to_string(list_transform(points, lambda p: printf('%.6f %.6f', p.x, p.y)), ' ') AS line FROM p")
def _(spark, sf):
    return sinks.polygon_lines(points(spark, sf).withColumn("class_id", F.lit(1)))


@query("detection_label_lines", "SELECT image_id, printf('%g %g %g', CAST(class_id AS DOUBLE), xc, conf) AS line FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", F.concat_ws(" ", *(formats.general(F.col(c).cast("double")) for c in ("class_id", "xc", "conf"))).alias("line"))


@query("converted_label_lines", "SELECT image_id, CAST(class_id AS VARCHAR) || ' ' || CAST(xc + 1 AS VARCHAR) || ' ' || CAST(conf + 1 AS VARCHAR) AS line FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("image_id", F.concat_ws(" ", F.col("class_id").cast("string"), formats.shortest(F.col("xc") + 1), formats.shortest(F.col("conf") + 1)).alias("line"))


@query("captions", f"SELECT image_id, name || ' ' || printf('%.2f', conf) AS caption FROM ann JOIN {_CLASSES_SQL} USING (class_id)")
def _(spark, sf):
    return joins.class_names(ann(spark, sf), classes(spark)).select("image_id", F.concat_ws(" ", "name", formats.fixed2(F.col("conf"))).alias("caption"))


@query("class_list", "WITH t AS (SELECT item_id, regexp_split_to_array(text, ' |\n') AS w FROM benchmark) SELECT item_id, CAST(unnest(generate_series(0, len(w) - 1)) AS INTEGER) AS class_id, unnest(w) AS name FROM t")
def _(spark, sf):
    return labels.class_list(table(spark, sf, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("text")))


@query("class_list_outer", "WITH t AS (SELECT item_id, string_split(trim(replace(text, ' ', chr(10)), chr(10)), chr(10)) AS w FROM benchmark) SELECT item_id, CAST(unnest(generate_series(0, len(w) - 1)) AS INTEGER) AS class_id, unnest(w) AS name FROM t")
def _(spark, sf):
    text = F.concat(F.lit("\n"), F.replace("text", F.lit(" "), F.lit("\n")), F.lit("\n\n"))
    return labels.class_list(table(spark, sf, "benchmark").select("item_id", text.alias("text")), outer=True)


@query("coco_boxes", "SELECT image_id, class_id, xc, yc, w, h, '{\"' || CAST(class_id AS VARCHAR) AS name FROM ann")
def _(spark, sf):
    number = lambda c: F.col(c).cast("string")
    box = F.concat_ws(",", *(number(c) for c in CENTRES))
    text = F.concat(
        F.lit('{"images":[{"id":'), number("image_id"), F.lit(',"file_name":"a.png","width":'), number("img_w"), F.lit(',"height":'), number("img_h"), F.lit('}],"annotations":[{"id":1,"image_id":'), number("image_id"), F.lit(',"category_id":'), number("class_id"),
        F.lit(',"bbox":['), box, F.lit(']}],"categories":[{"id":'), number("class_id"), F.lit(',"name":"{\\"'), number("class_id"), F.lit('"}]}'),
    )
    parsed = labels.parse_coco(ann(spark, sf).select(text.alias("text")))
    each = parsed.select(F.col("coco.categories")[0]["name"].alias("name"), F.explode("coco.annotations").alias("a"))
    return each.select("a.image_id", F.col("a.category_id").alias("class_id"), *(F.col("a.bbox")[k].alias(c) for k, c in enumerate(CENTRES)), "name").withColumn("class_id", F.col("class_id").cast("int"))


@query("label_lines", r"WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(\r\n|\r|\n)\z', '') AS body, coalesce(text, '') AS text FROM documents), s AS (SELECT doc_id, regexp_split_to_array(body, '\r\n|\r|\n') AS w FROM t WHERE text <> '') SELECT doc_id, CAST(sum(len(w)) AS BIGINT) AS n_lines FROM s GROUP BY doc_id")
def _(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return labels.exploded(texts).groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("n_lines"))


# Joins


@query("files_with_class", "SELECT o_orderkey AS path FROM orders WHERE EXISTS (SELECT 1 FROM ann WHERE image_id = o_orderkey AND class_id IN (0, 1) AND conf > 3e-1)")
def _(spark, sf):
    lines = ann(spark, sf).where("conf > 3e-1").select(F.col("image_id").alias("path"), F.concat(F.lit(" "), F.col("class_id").cast("string"), F.lit(" 0.5")).alias("line"))
    return joins.files_with(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path")), lines, filters.starts_with_class("line"))


def _doc_files(spark: SparkSession, sf: str, name: str, end: str) -> DataFrame:
    path = F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(end))
    return files.with_parts(table(spark, sf, name).select(path.alias("path"), F.lit(0).cast("long").alias("length")))


@query("images_without_labels", "SELECT DISTINCT 'data/' || CAST(doc_id AS VARCHAR) AS \"key\" FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    return joins.images_without_labels(_doc_files(spark, sf, "documents", ".jpg"), _doc_files(spark, sf, "labels", ".txt"))


@query("optional_label_lookup", "SELECT 'data/' || CAST(d.doc_id AS VARCHAR) || '.jpg' AS path, 'data/' || CAST(l.doc_id AS VARCHAR) || '.txt' AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    return joins.optional_labels(_doc_files(spark, sf, "documents", ".jpg"), _doc_files(spark, sf, "labels", ".txt")).select("path", "label")


@query("required_label_lookup", "SELECT 'data/' || CAST(d.doc_id AS VARCHAR) || '.jpg' AS path, 'data/' || CAST(l.doc_id AS VARCHAR) || '.txt' AS label FROM documents d JOIN labels l USING (doc_id)")
def _(spark, sf):
    return joins.optional_labels(_doc_files(spark, sf, "documents", ".jpg"), _doc_files(spark, sf, "labels", ".txt"), required=True).select("path", "label")


@query("matched_pairs", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS images_alone, count(*) FILTER (WHERE d.doc_id IS NULL) AS labels_alone FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, sf):
    return aggregates.mismatches(_doc_files(spark, sf, "documents", ".jpg"), _doc_files(spark, sf, "labels", ".txt"))


@query("label_image_priority", "SELECT 'data/' || CAST(l.doc_id AS VARCHAR) || '.txt' AS path, CASE WHEN l.toxic = 1 THEN 'data/' || CAST(l.doc_id AS VARCHAR) || '.png' WHEN d.doc_id IS NOT NULL THEN 'data/' || CAST(l.doc_id AS VARCHAR) || '.jpg' END AS image FROM labels l LEFT JOIN documents d USING (doc_id)")
def _(spark, sf):
    png = files.with_parts(table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.lit(0).cast("long").alias("length")))
    return joins.label_images(_doc_files(spark, sf, "labels", ".txt"), png.unionByName(_doc_files(spark, sf, "documents", ".jpg"))).select("path", "image")


@query("class_lookup", f"SELECT image_id, class_id, name FROM ann JOIN {_CLASSES_SQL} USING (class_id)")
def _(spark, sf):
    return joins.class_names(ann(spark, sf), classes(spark)).select("image_id", "class_id", "name")


@query("frames_by_models", "SELECT event_id, model, threshold FROM events, (VALUES (1, 5e-1), (2, 25e-2)) m(model, threshold)")
def _(spark, sf):
    return joins.frames_by_models(table(spark, sf, "events").select("event_id"), [0.5, 0.25])


@query("boxes_with_shapes", "SELECT a.image_id AS path, class_id, CAST(o_custkey % 1000 AS INT) AS width, CAST(o_custkey % 700 AS INT) AS height FROM ann a JOIN orders ON o_orderkey = a.image_id")
def _(spark, sf):
    shapes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 1000).cast("int").alias("width"), (F.col("o_custkey") % 700).cast("int").alias("height"))
    return joins.with_shapes(ann(spark, sf).select(F.col("image_id").alias("path"), "class_id"), shapes)


# Aggregates


@query("class_histogram_zero", f", i AS (SELECT o_orderkey AS path FROM orders), n AS (SELECT image_id, class_id, count(*) AS n FROM ann GROUP BY ALL) SELECT path, name, coalesce(n, 0) AS n_objects FROM i CROSS JOIN {_CLASSES_SQL} LEFT JOIN n ON n.image_id = path AND n.class_id = c.class_id")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"))
    return aggregates.class_histogram(orders, ann(spark, sf).withColumnRenamed("image_id", "path"), classes(spark))


@query("boxes_per_image", "SELECT o_orderkey AS path, count(image_id) AS n_boxes FROM orders LEFT JOIN ann ON image_id = o_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    return aggregates.boxes_per_image(table(spark, sf, "orders").select(F.col("o_orderkey").alias("path")), ann(spark, sf).withColumnRenamed("image_id", "path"))


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    return ann(spark, sf).select(F.col("image_id").alias("path"), F.lit(1).alias("frame"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("model"), "class_id", "conf")


@query("conf_filter_counts", "SELECT image_id AS path, 1 AS frame, CAST(l_suppkey % 2 + 1 AS INT) AS model, class_id, count(*) AS n FROM ann WHERE conf > 5e-1 GROUP BY ALL")
def _(spark, sf):
    return aggregates.detections_by_class(_detections(spark, sf))


@query("conf_filter_by_model", "SELECT image_id AS path, 1 AS frame, CAST(l_suppkey % 2 + 1 AS INT) AS model, class_id, conf FROM ann WHERE conf > CASE WHEN l_suppkey % 2 = 0 THEN 3e-1 ELSE 7e-1 END")
def _(spark, sf):
    return filters.confident(_detections(spark, sf), {1: 0.3, 2: 0.7})


@query("detection_summary", f", n AS (SELECT image_id AS path, 1 AS frame, CAST(l_suppkey % 2 + 1 AS INT) AS model, class_id, count(*) AS n FROM ann WHERE conf > 5e-1 GROUP BY ALL) SELECT path, frame, model, string_agg(CAST(n AS VARCHAR) || ' ' || name || CASE WHEN n > 1 THEN 's' ELSE '' END || ', ', '' ORDER BY class_id) AS summary FROM n JOIN {_CLASSES_SQL} USING (class_id) GROUP BY path, frame, model")
def _(spark, sf):
    return aggregates.summaries(aggregates.detections_by_class(_detections(spark, sf)), classes(spark))


@query("unique_classes", "SELECT DISTINCT class_id FROM ann")
def _(spark, sf):
    return splits.unique_classes(ann(spark, sf))


@query("media_counts", f"WITH {_PATHS}, s AS (SELECT lower({_SUFFIX}) AS e FROM f) SELECT count(*) FILTER (WHERE e IN ('jpg', 'png', 'jpeg', 'bmp')) AS images, count(*) FILTER (WHERE e IN ('mp4', 'mkv')) AS videos FROM s")
def _(spark, sf):
    return aggregates.media_counts(paths(spark, sf).withColumn("kind", files.media_kind("suffix")))


@query("total_frames", f"WITH {_PATHS}, s AS (SELECT lower({_SUFFIX}) AS e, length FROM f) SELECT CAST(sum(CASE WHEN e IN ('mp4', 'mkv') THEN length WHEN e IN ('jpg', 'png', 'jpeg', 'bmp') THEN 1 END) AS BIGINT) AS frames FROM s")
def _(spark, sf):
    kinds = paths(spark, sf).withColumn("kind", files.media_kind("suffix")).where("kind IS NOT NULL")
    return aggregates.total_frames(kinds.withColumn("frames", F.when(F.col("kind") == "video", F.col("length")).otherwise(1)))


# Paths and names


@query("suffix_classify", f"WITH {_PATHS}, s AS (SELECT path, {_SUFFIX} AS suffix FROM f) SELECT path, suffix, CASE WHEN lower(suffix) IN ('jpg', 'png', 'jpeg', 'bmp') THEN 'image' WHEN lower(suffix) IN ('mp4', 'mkv') THEN 'video' END AS kind FROM s")
def _(spark, sf):
    return paths(spark, sf).select("path", "suffix", files.media_kind("suffix").alias("kind"))


@query("image_scan", f"WITH {_PATHS}, s AS (SELECT path, {_SUFFIX} AS suffix FROM f) SELECT path FROM s WHERE suffix IN ('jpeg', 'jpg', 'JPG', 'png', 'PNG', 'bmp', 'BMP')")
def _(spark, sf):
    return files.scan_images(paths(spark, sf)).select("path")


@query("image_scan_by_letters", f"WITH {_PATHS} SELECT path FROM f WHERE regexp_matches(path, '\\.[jJpP][pPnN][gG]$')")
def _(spark, sf):
    return files.scan_images_by_letters(paths(spark, sf)).select("path")


_FLAT = "p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN path ELSE replace(replace(path, '/', '_'), 'data', 'x') END AS path FROM f), s AS (SELECT path, regexp_extract(path, '\\.([^./]*)$', 1) AS suffix, strpos(path, '/') = 0 AS flat FROM p)"


def flat_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the paths in the root folder."""
    found = paths(spark, sf).withColumn("page_id", F.regexp_extract("path", r"img-(\d+)", 1).cast("long"))
    flat = F.regexp_replace(F.regexp_replace("path", "/", "_"), "data", "x")
    return files.with_parts(found.select(F.when(F.col("page_id") % 3 == 0, F.col("path")).otherwise(flat).alias("path"), "length"))


@query("image_scan_flat", f"WITH {_PATHS}, {_FLAT} SELECT path FROM s WHERE flat AND regexp_matches(path, '\\.[jJpP][pPnN][gG]$')")
def _(spark, sf):
    return files.scan_images_by_letters(flat_paths(spark, sf), flat=True).select("path")


@query("flip_scan", f"WITH {_PATHS}, {_FLAT} SELECT path FROM s WHERE flat AND lower(suffix) IN ('png', 'jpg', 'jpeg', 'bmp', 'gif')")
def _(spark, sf):
    return files.scan_flip_images(flat_paths(spark, sf)).select("path")


@query("resize_scan", f"WITH {_PATHS}, {_FLAT} SELECT path FROM s WHERE flat AND suffix IN ('png', 'jpg', 'jpeg', 'bmp', 'PNG', 'JPG', 'JPEG')")
def _(spark, sf):
    return files.scan_resize_images(flat_paths(spark, sf)).select("path")


@query("segment_scan", f"WITH {_PATHS}, {_FLAT} SELECT path FROM s WHERE flat AND lower(suffix) IN ('jpg', 'jpeg', 'png')")
def _(spark, sf):
    return files.scan_segment_images(flat_paths(spark, sf)).select("path")


@query("video_scan", f"WITH {_PATHS}, {_FLAT} SELECT path FROM s WHERE lower(suffix) IN ('mov', 'avi', 'mp4', 'mpg', 'mpeg', 'm4v', 'wmv', 'mkv')")
def _(spark, sf):
    return files.scan_videos(flat_paths(spark, sf)).select("path")


@query("label_scan", "WITH l AS (SELECT 'd' || CAST(doc_id % 5 AS VARCHAR) || '/' || CASE WHEN doc_id % 4 = 0 THEN 'classes' ELSE CAST(doc_id AS VARCHAR) END || CASE WHEN doc_id % 7 = 0 THEN '.xml' ELSE '.txt' END AS path FROM labels) SELECT path FROM l WHERE path LIKE '%.txt' AND path NOT LIKE '%/classes.txt'")
def _(spark, sf):
    name = F.when(F.col("doc_id") % 4 == 0, "classes").otherwise(F.col("doc_id").cast("string"))
    path = F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string"), F.lit("/"), name, F.when(F.col("doc_id") % 7 == 0, ".xml").otherwise(".txt"))
    return files.scan_labels(files.with_parts(table(spark, sf, "labels").select(path.alias("path"), F.lit(0).cast("long").alias("length"))), skip_classes=True).select("path")


@query("media_scan", f"WITH {_PATHS}, s AS (SELECT path, CASE WHEN lower({_SUFFIX}) IN ('jpg', 'png', 'jpeg', 'bmp') THEN 'image' WHEN lower({_SUFFIX}) IN ('mp4', 'mkv') THEN 'video' END AS kind FROM f) SELECT path, kind FROM s WHERE kind IS NOT NULL")
def _(spark, sf):
    return files.scan_media(paths(spark, sf)).select("path", "kind")


@query("path_sort_limit", "SELECT page_id, url AS path FROM pages ORDER BY string_split(url, '/'), page_id LIMIT 20")
def _(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return found.orderBy(names.path_order("path"), "page_id").limit(20)


@query("path_parts", f"WITH {_PATHS} SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, {_SUFFIX} AS suffix, regexp_replace(path, '\\.[^./]*$', '') || '.txt' AS label FROM f")
def _(spark, sf):
    return paths(spark, sf).select("path", "dir", "stem", "suffix", names.with_suffix("path", ".txt").alias("label"))


@query("clean_names", f"SELECT page_id, regexp_replace(url, '[{names.SPECIAL}]', '_', 'g') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.clean("url").alias("name"))


@query("frame_names", f"WITH {_PATHS} SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '_frame' || printf('%05d', page_id) || '.jpg' AS name FROM f")
def _(spark, sf):
    found = paths(spark, sf)
    return found.select("path", names.frame_name("path", F.regexp_extract("path", r"img-(\d+)", 1).cast("int")).alias("name"))


@query("split_paths", f"WITH {_PATHS}, s AS (SELECT path, regexp_extract(path, '/(d[0-9])/', 1) AS d, regexp_extract(path, '([^/]*)$', 1) AS n FROM f) SELECT path, 'out/images/train/' || d || '/' || n AS image, 'out/labels/train/' || d || '/' || regexp_replace(n, '\\.[^.]*$', '') || '.txt' AS label, 'out/images/labels/' || d || '/' || regexp_replace(n, '\\.[^.]*$', '') || '.txt' AS compat FROM s")
def _(spark, sf):
    dest = F.lit("out/images/train")
    return paths(spark, sf).select("path", names.split_path("path", dest).alias("image"), names.split_label_path("path", dest).alias("label"), names.split_label_path("path", dest, compat=True).alias("compat"))


@query("variant_label_plan", "SELECT 'data/' || CAST(doc_id AS VARCHAR) || '.txt' AS src, 'data/' || CAST(doc_id AS VARCHAR) || tag || '.txt' AS dst, 'copy' AS action FROM labels, (VALUES ('_brt'), ('_sat'), ('_cot'), ('_ivt')) t(tag)")
def _(spark, sf):
    return sinks.plan_variant_labels(_doc_files(spark, sf, "labels", ".txt"), splits.COLOUR_TAGS)


@query("empty_label_plan", "SELECT DISTINCT CAST(NULL AS VARCHAR) AS src, 'data/' || CAST(doc_id AS VARCHAR) || '.txt' AS dst, 'touch' AS action FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, sf):
    return sinks.plan_empty_labels(_doc_files(spark, sf, "documents", ".jpg"), _doc_files(spark, sf, "labels", ".txt"))


@query("move_plan", "WITH p AS (SELECT 'd' || CAST(doc_id % 3 AS VARCHAR) || '/' || CAST(doc_id % 40 AS VARCHAR) || '-' || CAST(doc_id % 2 AS VARCHAR) || '.txt' AS src, doc_id FROM labels), u AS (SELECT DISTINCT src FROM p), d AS (SELECT src, 'other/' || string_split(src, '/')[2] AS dst FROM u) SELECT src, dst, CASE WHEN src = max(src) OVER (PARTITION BY dst) THEN 'move' ELSE 'remove' END AS action FROM d")
def _(spark, sf):
    part = lambda n: (F.col("doc_id") % n).cast("string")
    path = F.concat(F.lit("d"), part(3), F.lit("/"), part(40), F.lit("-"), part(2), F.lit(".txt"))
    return sinks.plan_moves(table(spark, sf, "labels").select(path.alias("path")).distinct(), "other")


@query("augmented_names", f"WITH {_PATHS} SELECT path, CAST(version AS INTEGER) AS version, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '_aug_' || CAST(version AS VARCHAR) || '.txt' AS name FROM f, (VALUES (1), (2)) v(version)")
def _(spark, sf):
    each = splits.replicate(paths(spark, sf).select("path"), 2)
    return each.select("path", "version", names.augmented_name("path", F.col("version"), ".txt").alias("name"))


@query("frame_rates", "SELECT event_id, CASE WHEN value > 0 THEN CAST(trunc(1e0 / nullif(value, 0)) AS INTEGER) END AS fps FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", geometry.frame_rate("value").alias("fps"))


@query("readable_pairs", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def _(spark, sf):
    sides = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic", F.lit("x").alias("label")), "doc_id", "left")
    return filters.readable(sides.withColumns({c: F.when(F.col("toxic") == 0, 8) for c in ("height", "width")})).select("doc_id")


# Splits, replication, unions


_SPLIT = """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place, count(*) OVER () AS n FROM documents),
s AS (SELECT doc_id, CASE WHEN place <= floor(n * (7 / 10e0)) THEN 'train' WHEN place <= floor(n * (7 / 10e0)) + floor(n * (2 / 10e0)) THEN 'val' WHEN place <= floor(n * (7 / 10e0)) + floor(n * (2 / 10e0)) + floor(n * (1 / 10e0)) THEN 'test' END AS split FROM r)"""


@query("split_assign", f"{_SPLIT} SELECT doc_id, split FROM s")
def _(spark, sf):
    return splits.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", (7, 2, 1))


@query("split_sizes", f"{_SPLIT} SELECT split, count(*) AS n FROM s WHERE split IS NOT NULL GROUP BY split")
def _(spark, sf):
    split = splits.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", (7, 2, 1))
    return split.where("split IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"))


@query("replicate", "SELECT o_orderkey, CAST(unnest(generate_series(1, 5)) AS INTEGER) AS version FROM orders")
def _(spark, sf):
    return splits.replicate(table(spark, sf, "orders").select("o_orderkey"), 5)


@query("flip_variant_names", f"WITH {_PATHS} SELECT path, tag, regexp_replace(path, '\\.[^./]*$', '') || tag || regexp_extract(path, '(\\.[^./]*)$', 1) AS \"out\" FROM f, (VALUES ('_flipped_ud'), ('_flipped_lr'), ('_flipped_ud_lf')) t(tag)")
def _(spark, sf):
    return splits.variants(paths(spark, sf).select("path"), splits.FLIP_TAGS)


@query("nearest_first", "SELECT user_id, arg_min(event_id, [value, event_id]) AS event_id, min(value) AS value FROM events GROUP BY user_id")
def _(spark, sf):
    return splits.nearest_first(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("collect_models", "SELECT image_id, class_id, 1 AS model FROM ann WHERE conf > 5e-1 UNION ALL SELECT image_id, class_id, 2 AS model FROM ann WHERE conf <= 5e-1")
def _(spark, sf):
    a = ann(spark, sf).select("image_id", "class_id", "conf")
    return splits.collected([a.where("conf > 5e-1").drop("conf"), a.where("conf <= 5e-1").drop("conf")])


# Pixels as columns


def _pixel_sql(expression: str) -> str:
    return f"WITH {_VALUES}, o AS (SELECT vec_id, {expression} AS px FROM v) SELECT vec_id, CAST(unnest(generate_series(0, len(px) - 1)) AS INTEGER) AS k, unnest(px) AS v FROM o"


def _exploded_values(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("px").alias("k", "v"))


@query("invert_pixels", _pixel_sql("list_transform(px, lambda x: 255 - x)"))
def _(spark, sf):
    return _exploded_values(values(spark, sf).withColumn("px", pixels.invert_values(F.col("px"))))


@query("contrast_pixels", _pixel_sql("list_transform(px, lambda x: CAST(trunc(least(greatest(x * (CAST(40 + vec_id % 61 AS DOUBLE) / 127 + 1) - (40 + vec_id % 61) + 10, 0e0), 255e0)) AS INTEGER))"))
def _(spark, sf):
    by = (F.col("vec_id") % 61 + 40).cast("double")
    return _exploded_values(values(spark, sf).withColumn("px", pixels.contrast_values(F.col("px"), by)))


@query("shift_pixels", _pixel_sql("list_transform(px, lambda x: least(greatest(x + (CASE WHEN vec_id % 2 = 0 THEN 40 ELSE -50 END), 0), 255))"))
def _(spark, sf):
    by = F.when(F.col("vec_id") % 2 == 0, 40).otherwise(-50)
    return _exploded_values(values(spark, sf).withColumn("px", pixels.shift_values(F.col("px"), by)))


@query("flip_lr_pixels", f"WITH {_VALUES} SELECT vec_id, CAST(k AS INTEGER) AS k, px[k // 8 * 8 + 8 - k % 8] AS v FROM v, generate_series(0, 63) g(k)")
def _(spark, sf):
    return _exploded_values(values(spark, sf).withColumn("px", pixels.flip_rows(F.col("px"), 8, 8)))


@query("flip_ud_pixels", f"WITH {_VALUES} SELECT vec_id, CAST(k AS INTEGER) AS k, px[(7 - k // 8) * 8 + k % 8 + 1] AS v FROM v, generate_series(0, 63) g(k)")
def _(spark, sf):
    rows = F.flatten(F.array(*(F.slice("px", 1 + k * 8, 8) for k in range(7, -1, -1))))
    return _exploded_values(values(spark, sf).withColumn("px", rows))


# Augmentation of boxes


HYP = Hyperparameters(hsv_h=0.015, hsv_s=0.7, hsv_v=0.4, degrees=0, translate=0.15, scale=0.5, shear=0, flipud=0.5, fliplr=0.5)


def _u(name: str) -> str:
    return f"(CAST(('0x' || substring(md5(CAST(image_id AS VARCHAR) || '|' || CAST(version AS VARCHAR) || '|{name}'), 1, 8)) AS BIGINT) / 4294967296e0)"


@query("augment_boxes", f""", b AS (SELECT image_id, class_id, unnest([1, 2]) AS version, CAST(img_w AS DOUBLE) AS iw, CAST(img_h AS DOUBLE) AS ih, {_PX} FROM ann),
d AS (SELECT *, 1e0 - 5e-1 + {_u('scale')} * 1e0 AS s, ({_u('x')} * 2e0 - 1e0) * 15e-2 * iw AS dx, ({_u('y')} * 2e0 - 1e0) * 15e-2 * ih AS dy, {_u('lr')} < 5e-1 AS lr, {_u('ud')} < 5e-1 AS ud FROM b)
SELECT image_id, class_id, version, ((CASE WHEN lr THEN iw - x2 ELSE x1 END) - iw / 2) * s + iw / 2 + dx AS x1, ((CASE WHEN ud THEN ih - y2 ELSE y1 END) - ih / 2) * s + ih / 2 + dy AS y1,
 ((CASE WHEN lr THEN iw - x1 ELSE x2 END) - iw / 2) * s + iw / 2 + dx AS x2, ((CASE WHEN ud THEN ih - y1 ELSE y2 END) - ih / 2) * s + ih / 2 + dy AS y2 FROM d""")
def _(spark, sf):
    boxes = splits.replicate(pixel_boxes(spark, sf), 2)
    return augment.augmented_boxes(boxes, HYP, "image_id", "img_w", "img_h").select("image_id", "class_id", "version", *CORNERS)


# Live frames


@query("stream_latest_frame", "SELECT user_id, arg_max(event_id, [epoch_us(ts), event_id]) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def _(spark, sf):
    return live.latest(table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", "event_id", "ts")


@query("selected_frames", "SELECT event_id, user_id FROM events WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = event_id)")
def _(spark, sf):
    frames = table(spark, sf, "events").select("event_id", "user_id", F.lit("v").alias("path"), F.col("event_id").alias("frame"))
    wanted = table(spark, sf, "labels").select(F.lit("v").alias("path"), F.col("doc_id").alias("frame")).distinct()
    return live.selected(frames, wanted).select("event_id", "user_id")
