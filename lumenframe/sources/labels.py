"""Label files: text, polygons, XML, JSON, class lists and hyperparameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_END = r"\r\n|\r|\n"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def read_texts(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, text) of ``files`` below ``root``; empty files, which Spark skips, have an empty text."""
    read = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")
    base = root.split("://")[-1].rstrip("/") + "/"
    path = F.substring_index(F.regexp_replace(F.url_decode(F.regexp_replace("at", r"\+", "%2B")), "^[a-z]+:/+", "/"), base, -1)
    return files.select("path").join(read.select(path.alias("path"), "value"), "path", "left").select("path", F.coalesce("value", F.lit("")).alias("text"))


def lines(text: Column | str) -> Column:
    """A text's lines, as a file is read by lines: no line after the last line end."""
    text = _c(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"({LINE_END})\z", ""), LINE_END))


def exploded(texts: DataFrame) -> DataFrame:
    """(path, line_no, line) of (path, text)."""
    return texts.select("path", F.posexplode(lines("text")).alias("line_no", "line"))


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def parse_boxes(rows: DataFrame, line: str = "line") -> DataFrame:
    """class_id, xc, yc, w, h of box lines; what isn't a number is null, further fields are ignored."""
    f = _fields(F.col(line))
    number = lambda k, kind: F.try_element_at(f, F.lit(k)).try_cast(kind)
    return rows.withColumns({"class_id": number(1, "int"), **{c: number(k, "double") for k, c in enumerate(("xc", "yc", "w", "h"), 2)}})


def parse_polygons(rows: DataFrame, line: str = "line") -> DataFrame:
    """class_id and points of polygon lines; an odd number of coordinates or a blank line raises."""
    f = _fields(F.col(line))
    values = F.transform(F.slice(f, F.lit(2), F.size(f)), lambda v: v.cast("double"))
    points = F.transform(F.when(F.size(values) > 0, F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.get(values, k * 2).alias("x"), F.get(values, k * 2 + 1).alias("y")))
    bad = (F.size(values) % 2 != 0) | (F.trim(F.col(line)) == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a polygon line: "), F.col(line)))).otherwise(points)
    return rows.withColumns({"class_id": F.get(f, 0).try_cast("int"), "points": checked})


#: Plain XML: elements without attributes, texts without references, and no other markup.  A leaf is an element with a text.
_NAME = "[A-Za-z_][A-Za-z0-9_]*"
_TEXT = r"[^<&\]\r\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]*"
_SPACE = r"[ \t\n]*"


def _leaf(tag: str, name: str, *others: str) -> str:
    """A leaf of any name but ``others``; its text is the group ``name``."""
    barred = f"(?!(?:{'|'.join(others)})>)" if others else ""
    return f"<(?P<{tag}>{barred}{_NAME})>" + (f"(?P<{name}>{_TEXT})" if name else _TEXT) + f"</(?P={tag})>{_SPACE}"


_HEAD = re.compile(f"{_SPACE}<(?P<root>{_NAME})>{_SPACE}(?:{_leaf('a', '', 'size', 'object')})*<size>{_SPACE}{_leaf('b', 'width')}{_leaf('c', 'height')}(?:{_leaf('d', '')})*</size>{_SPACE}(?:{_leaf('e', '', 'size', 'object')})*")
_ONE = re.compile(
    f"<object>{_SPACE}(?:{_leaf('a', '', 'name', 'bndbox')})*<name>(?P<name>{_TEXT})</name>{_SPACE}(?:{_leaf('b', '', 'name', 'bndbox')})*<bndbox>{_SPACE}"
    + "".join(_leaf(f"c{k}", f"v{k}") for k in range(4))
    + f"(?:{_leaf('d', '')})*</bndbox>{_SPACE}(?:{_leaf('e', '', 'name', 'bndbox')})*</object>{_SPACE}(?:{_leaf('f', '', 'size', 'object')})*"
)
_TAIL = re.compile(f"</({_NAME})>{_SPACE}")


def _plain_objects(xml: str) -> list[tuple] | None:
    """As ``_objects``, for plain XML with a size, then objects with a name and then a box; None for all else."""
    head = _HEAD.match(xml)
    if not head:
        return None
    root, width, height = head.group("root", "width", "height")
    width, height = float(width), float(height)
    found, at = [], head.end()
    while one := _ONE.match(xml, at):
        name, *box = one.group("name", "v0", "v1", "v2", "v3")
        found.append((name or None, width, height, *map(float, box)))
        at = one.end()
    tail = _TAIL.fullmatch(xml, at)
    return found if tail and tail[1] == root else None


OBJECTS = "array<struct<name: string, width: double, height: double, xmin: double, ymin: double, xmax: double, ymax: double>>"


def _objects(xml: str) -> list[tuple]:
    """The objects of one annotation, its size with each."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(xml)
    width = height = None
    for size in root.findall("size"):
        width, height = float(size[0].text), float(size[1].text)
    found = []
    for o in root.findall("object"):
        called, boxes = o.findall("name"), o.findall("bndbox")
        if not called or not boxes:
            raise ValueError("an object has no name or no box")
        found.append((called[-1].text, width, height, *(float(boxes[-1][k].text) for k in range(4))))
    return found


def parse_voc(rows: DataFrame, xml: str = "text") -> DataFrame:
    """A row for each object of XML annotations: name, width, height, xmin, ymin, xmax, ymax.

    Values are by place in their parent, not by tag.  Of several sizes, names
    or boxes, the last holds.  An object without a name or a box raises.  Each
    document is parsed once, which the XPath functions would do for each value;
    plain ones by expressions for their few forms, others by an XML parser.
    """
    fields = ("name", "width", "height", "xmin", "ymin", "xmax", "ymax")

    @F.arrow_udf(OBJECTS)
    def objects(texts: pa.Array) -> pa.Array:
        found: list[tuple] = []
        ends: list[int] = [0]
        for t in texts.to_pylist():
            if t is not None:
                own = _plain_objects(t)
                found += _objects(t) if own is None else own
            ends.append(len(found))
        called, *numbers = zip(*found, strict=True) if found else [()] * len(fields)
        columns = [pa.array(called, pa.string()), *(pa.array(np.array(n, np.float64)) for n in numbers)]
        # A null text has no objects, as one without any; neither has rows.
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(fields)))

    return rows.withColumn("_o", objects(xml)).select(*rows.columns, F.inline("_o"))


COCO = "struct<images: array<struct<id: long, file_name: string, width: int, height: int>>, annotations: array<struct<id: long, image_id: long, category_id: int, bbox: array<double>, segmentation: array<array<double>>>>, categories: array<struct<id: int, name: string>>>"


def parse_coco(rows: DataFrame, text: str = "text") -> DataFrame:
    """The document of JSON annotations as a column ``coco``."""
    return rows.withColumn("coco", F.from_json(F.col(text), COCO))


def class_list(texts: DataFrame, outer: bool = False, text: str = "text") -> DataFrame:
    """(class_id, name) of class files.

    Each line is a class, trimmed, blank ones too; with ``outer``, white space
    around the whole text goes instead and names stay as they are.
    """
    source = F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), "\n") if outer else F.transform(lines(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(source).alias("class_id", "name"))


@dataclass(frozen=True)
class Hyperparameters:
    """Ranges of the random augmentation; other keys of the file are ignored."""

    hsv_h: float
    hsv_s: float
    hsv_v: float
    degrees: float
    translate: float
    scale: float
    shear: float
    flipud: float
    fliplr: float

    @classmethod
    def load(cls, path: str) -> Hyperparameters:
        import yaml

        with open(path) as f:
            found = yaml.safe_load(f)
        return cls(**{x.name: float(found[x.name]) for x in fields(cls)})

    def echo(self) -> str:
        return ", ".join(f"{x.name}={getattr(self, x.name)}" for x in fields(self))
