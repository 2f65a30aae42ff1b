import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.functions import geometry, names, pixels
from lumenframe.operators import aggregates, augment, filters, joins, splits
from lumenframe.sources import files, labels
from lumenframe.sources.labels import Hyperparameters

HYP = Hyperparameters(0.015, 0.7, 0.4, 10, 0.15, 0.5, 5, 0.5, 0.5)


def listed(spark, *paths):
    return files.with_parts(spark.createDataFrame([(p, 0) for p in paths], "path string, length long"))


def test_scans(spark):
    tree = listed(spark, "a/b.jpg", "a-b.jpg", "x.JPEG", "y.PNG", "z.jng", "c.bmp", "d/e.gif", "f.GIF", "m.MP4", "n.mov", "classes.txt", "a/b.txt", "_h.txt", ".dot.txt", "noend")
    at = lambda df: [r.path for r in df.collect()]
    assert at(files.scan_images(tree)) == ["a/b.jpg", "a-b.jpg", "c.bmp", "y.PNG"]
    assert at(files.scan_images_by_letters(tree)) == ["a/b.jpg", "a-b.jpg", "y.PNG", "z.jng"]
    assert at(files.scan_images_by_letters(tree, flat=True)) == ["a-b.jpg", "y.PNG", "z.jng"]
    assert set(at(files.scan_flip_images(tree))) == {"a-b.jpg", "x.JPEG", "y.PNG", "c.bmp", "f.GIF"}
    assert set(at(files.scan_resize_images(tree))) == {"a-b.jpg", "x.JPEG", "y.PNG", "c.bmp"}
    assert set(at(files.scan_segment_images(tree))) == {"a-b.jpg", "x.JPEG", "y.PNG"}
    assert at(files.scan_videos(tree)) == ["m.MP4", "n.mov"]
    assert [r.kind for r in files.scan_media(tree).collect()] == ["image"] * 5 + ["video"] * 2
    assert set(at(files.scan_labels(tree, skip_classes=True))) == {"a/b.txt", "_h.txt", ".dot.txt"}
    with pytest.raises(FileNotFoundError):
        files.scan_media(listed(spark, "a.txt"))
    assert [files.source_kind(x) for x in ("0", "rtsp://x", "http://x", "a.mp4")] == ["stream", "stream", "stream", "files"]
    parts = {r.path: (r.dir, r.stem, r.suffix) for r in tree.collect()}
    assert parts["a/b.jpg"] == ("a", "b", "jpg") and parts["noend"] == ("", "noend", "") and parts[".dot.txt"] == ("", ".dot", "txt")


def test_lines(spark):
    texts = ["", "a\n", "a\n\n", "a\r\nb\rc", "\n", "a\n\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "path int, text string")
    found = labels.exploded(rows).collect()
    for i, t in enumerate(texts):
        import io

        assert [r.line for r in found if r.path == i] == [x.rstrip("\n") for x in io.StringIO(t, newline=None)], t


def test_polygon_lines_that_are_not(spark):
    for bad in ("1 0.5", " "):
        with pytest.raises(Exception, match="polygon"):
            labels.parse_polygons(spark.createDataFrame([(bad,)], "line string")).collect()


def test_voc(spark):
    xml = "<a><size><width>100</width><height>50</height><depth>3</depth></size>" + "".join(f"<object><name>{n}</name><bndbox><xmin>{x}</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox></object>" for n, x in (("car", 10), ("bus", 5))) + "</a>"
    none = "<a><size><width>1</width><height>1</height></size></a>"
    rows = spark.createDataFrame([("p", xml), ("q", none)], "path string, text string")
    found = labels.parse_voc(rows).collect()
    assert [(r.path, r.name, r.width, r.height, r.xmin, r.ymin, r.xmax, r.ymax) for r in found] == [("p", "car", 100, 50, 10, 2, 30, 40), ("p", "bus", 100, 50, 5, 2, 30, 40)]
    with pytest.raises(Exception, match="no name or no box"):
        labels.parse_voc(spark.createDataFrame([("p", xml.replace("<name>bus</name>", ""))], "path string, text string")).collect()


def test_plain_voc_needs_no_parser():
    """What the expressions take is as the parser has it; the rest is left to the parser."""
    box = "<bndbox><xmin>1</xmin>\n<ymin> 2 </ymin><xmax>3e1</xmax><ymax>4</ymax><more>x</more></bndbox>"
    one = f"<object><name>ein \u00e9 > 1</name><pose>Left</pose>{box}</object>"
    size = "<size><width>100</width><height>50</height><depth>3</depth></size>"
    plain = [f"<a>{size}</a>", f" <a><folder>f</folder>\n{size}<x></x>{one}\n</a>\n", f"<a>{size}{one * 3}<segmented>0</segmented></a>", f"<a>{size}{one.replace('ein', '')}</a>", f"<a>{size}<object><name></name>{box}</object></a>"]
    for xml in plain:
        assert labels._plain_objects(xml) == labels._objects(xml)
    assert len(labels._plain_objects(plain[2])) == 3
    other = [f"<a>{one}{size}</a>", f"<a>{size}{size.replace('100', '7')}{one}</a>", f"<a>{size}<object>{box}<name>n</name></object></a>", f"<a>{size}{one.replace('<name>', '<name>m</name><name>')}</a>"]
    other += [f"<?xml version='1.0'?><a>{size}{one}</a>", f"<a>{size}<!-- c -->{one}</a>", f"<a>{size}{one.replace('ein', '&lt;')}</a>", f"<a>{size}{one.replace('ein', '<![CDATA[x]]>')}</a>", f"<a b='c'>{size}{one}</a>", f"<a>{size}{one}\r\n</a>", f"<a>{one}</a>"]
    for xml in other:
        assert labels._plain_objects(xml) is None
        assert labels._objects(xml)
    for xml in (f"<a>{size}{one}</b>", f"<a>{size}{one}", f"<a>{size}{one}</a><a></a>", f"<a>{size}<object>{box}</object></a>", "", f"<a>{size}{one.replace('ein', ']]>')}</a>"):
        assert labels._plain_objects(xml) is None
        with pytest.raises((ValueError, SyntaxError)):
            labels._objects(xml)


def test_class_lists(spark):
    one = spark.createDataFrame([(" a \n\nb\n",)], "text string")
    assert [(r.class_id, r.name) for r in labels.class_list(one).collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert [r.name for r in labels.class_list(spark.createDataFrame([("\n a \nb \n",)], "text string"), outer=True).collect()] == ["a ", "b"]


def test_coco(spark):
    row = spark.createDataFrame([('{"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 1, "bbox": [1, 2, 3, 4]}]}',)], "text string")
    coco = labels.parse_coco(row).first().coco
    assert coco.images[0].file_name == "a" and coco.annotations[0].bbox == [1, 2, 3, 4]


def test_remaps(spark):
    given_ = ["0 .1", "1\t.1", "3 x 3", "5 y", "6 z", "7 z", "4", "12 q", ""]
    rows = spark.createDataFrame([(x,) for x in given_], "line string")
    assert [r.line for r in filters.remap_classes(rows).collect()] == ["0 .1", "1 x 3", "2 y", "1"]
    digits = spark.createDataFrame([("3 a",), ("23 b",), ("2 c",), ("0 d",), ("",)], "line string")
    assert [r[0] for r in digits.select(filters.remap_leading("line")).collect()] == ["0 a", "33 b", "3 c", "0 d", ""]
    assert [r[0] for r in digits.select(filters.remap_leading("line", strict=True)).collect()] == ["0 a", "23 b", "3 c", "0 d", ""]
    starts = spark.createDataFrame([(" 0 a",), ("\t15 b",), ("2 c",), ("1",)], "line string")
    assert [r[0] for r in starts.select(filters.starts_with_class("line")).collect()] == [True, True, False, True]
    assert [r[0] for r in starts.select(filters.starts_with_class("line", exact=True)).collect()] == [True, False, False, True]


def test_joins(spark):
    images, texts = listed(spark, "a.jpg", "a.png", "b.jpg"), listed(spark, "b.txt", "c.txt")
    assert [r.key for r in joins.images_without_labels(images, texts).collect()] == ["a"]
    with pytest.raises(Exception, match="no partner"):
        joins.strict_pairs(images, texts).collect()
    assert joins.strict_pairs(listed(spark, "b.jpg"), listed(spark, "b.txt")).count() == 1
    classes = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "class_id int, name string")
    assert joins.class_ids(spark.createDataFrame([("x",)], "name string"), classes).first().class_id == 0
    for bad in (lambda: joins.class_ids(spark.createDataFrame([("q",)], "name string"), classes), lambda: joins.class_names(spark.createDataFrame([(9,)], "class_id int"), classes)):
        with pytest.raises(Exception, match="no class"):
            bad().collect()
    assert aggregates.class_histogram(spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([("p", 0), ("p", 2)], "path string, class_id int"), classes).orderBy("name").collect() == [("p", "x", 2), ("p", "y", 0)]


def test_split_sizes(spark):
    for n in (0, 9, 10, 90, 170):
        rows = spark.range(n).withColumnRenamed("id", "k")
        counts = dict(splits.random_split(rows, "k", (7, 2, 1)).groupBy("split").count().collect())
        assert [counts.get(s, 0) for s in ("train", "val", "test")] == aggregates.split_sizes(n, (7, 2, 1))
    with pytest.raises(ValueError):
        splits.random_split(spark.range(3), "id", (7, 3, 1))
    assert splits.replicate(spark.range(3), 0).count() == 0


def test_first_images(spark):
    images = listed(spark, "b.jpg", "a/z.jpg", "a.jpg")
    assert [r.path for r in filters.first_images(images, 2).collect()] == ["a/z.jpg", "a.jpg"][:2]
    assert filters.first_images(images, 0).count() == filters.first_images(images, -1).count() == 3


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 99))
def test_pixel_kernels(h, w, seed):
    image = np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)
    f = pixels.flips(image)
    assert (f["_flipped_ud"][::-1] == image).all() and (f["_flipped_lr"][:, ::-1] == image).all()
    assert (pixels.invert(pixels.invert(image)) == image).all()
    assert np.abs(pixels.from_hsv(pixels.to_hsv(image)).astype(int) - image).max() <= 6
    assert (pixels.resize(image, w, h) == image).all()
    assert (pixels.warp(image, np.array([[1.0, 0, 0], [0, 1, 0]])) == image).all()
    boxed, ratio, (dw, dh) = pixels.letterbox(image, (64, 64), auto=False)
    assert boxed.shape == (64, 64, 3)
    box = np.array([0, 0, w, h]) * ratio + (dw, dh, dw, dh)
    assert np.abs((box - (dw, dh, dw, dh)) / ratio - (0, 0, w, h)).max() < 1
    grey = np.repeat(image[..., :1], 3, -1)
    assert (pixels.saturation(grey, -30) == grey).all()


def test_brightness_is_held():
    image = np.array([[[250, 250, 250], [5, 5, 5]]], np.uint8)
    assert pixels.brightness(image, 40)[0, 0].tolist() == [255] * 3 and pixels.brightness(image, -40)[0, 1].tolist() == [0] * 3


def test_moved_boxes_follow_pixels(spark):
    image = np.zeros((60, 80, 3), np.uint8)
    image[20:30, 10:40] = 255
    steps = [("affine", np.array([[-1.0, 0, 80], [0, 1, 0]]))]
    out = augment.augmented_pixels(image, steps)
    x1, y1, x2, y2 = augment.moved_boxes(np.array([[10.0, 20, 40, 30]]), augment.matrix_of(steps))[0]
    assert (x1, y1, x2, y2) == (40, 20, 70, 30) and (out[20:30, 40:70] == 255).all() and out[:20].max() == pixels.BORDER * 0
    again = augment.draw(augment.generator("p", 1), HYP, 80, 60)
    assert repr(again) == repr(augment.draw(augment.generator("p", 1), HYP, 80, 60))


def _nearest(cx, cy, x, y, w, h):
    """The border point of a dense walk along the ray."""
    t = np.linspace(0, 5000, 2_000_001)
    px, py = cx + t * (x - cx), cy + t * (y - cy)
    inside = (px >= 0) & (px <= w - 1) & (py >= 0) & (py <= h - 1)
    k = np.flatnonzero(inside)[-1]
    return px[k], py[k]


def test_boundary(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-50, 90), rng.uniform(-50, 90)) for _ in range(20)]
    df = spark.createDataFrame(rows, "x double, y double")
    found = df.select(geometry.to_boundary(16.0, 12.0, "x", "y", 32, 24).alias("p")).collect()
    for (x, y), r in zip(rows, found, strict=True):
        assert np.allclose((r.p.x, r.p.y), _nearest(16.0, 12.0, x, y, 32, 24), atol=0.5)
    centre = spark.createDataFrame([(16.0, 12.0)], "x double, y double").select(geometry.to_boundary(16.0, 12.0, "x", "y", 32, 24).alias("p")).first().p
    assert (centre.x, centre.y) == (16, 12)


def test_rounding_and_single_precision(spark):
    rows = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5)], "xc double, yc double, w double, h double")
    box = rows.select(*geometry.pixel_corners("xc", "yc", "w", "h", 10, 6)).first()
    assert list(box) == [round(2.5), round(1.5), round(7.5), round(4.5)]
    single = rows.select(*geometry.truncated_corners(F.lit(0.1), "yc", F.lit(0.3), "h", 10, 10, single=True)).first()
    f = np.float32
    assert list(single) == [int((f(0.1) - f(0.3) / 2) * f(10)), 2, int((f(0.1) + f(0.3) / 2) * f(10)), 7]


def test_summary_and_names(spark):
    row = spark.createDataFrame([("a/b.c.jpg",)], "path string")
    one = row.select(names.tagged("path", "_brt"), names.augmented_name("path", F.lit(3), ".txt"), names.detection_text_name("path", F.lit(7), F.lit(True)), names.crop_name("path", F.lit(2), F.lit(1)), names.tweak_path("path", "out")).first()
    assert list(one) == ["a/b.c_brt.jpg", "b.c_aug_3.txt", "b.c_7.txt", "b.c_m2_box_1.jpg", "out/b.c.jpg"]


def test_colours():
    assert pixels.class_colours(3) == pixels.class_colours(3)
    assert len(list(itertools.chain(*pixels.class_colours(3)))) == 9
