"""The commands, as functions of a session and as ``python -m lumenframe.plans.commands``."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry, names, pixels
from lumenframe.operators import aggregates, augment, filters, inference, joins, splits
from lumenframe.sources import files, images, labels, sinks
from lumenframe.streaming import live


def add_empty_labels(spark: SparkSession, dataset: str) -> int:
    found = files.inventory(spark, dataset)
    return sinks.apply(sinks.plan_empty_labels(files.scan_images(found), files.scan_labels(found)), dataset)


def count_object(spark: SparkSession, dataset: str) -> int:
    found = files.inventory(spark, dataset)
    return aggregates.count_objects(labels.exploded(labels.read_texts(spark, dataset, files.scan_labels(found)))).first()[0]


def _relative(decoded: DataFrame, root: str) -> DataFrame:
    base = root.split("://")[-1].rstrip("/") + "/"
    return decoded.withColumn("path", F.substring_index(F.url_decode(F.regexp_replace("path", "^[a-z]+:/+", "/")), base, -1))


def _images(spark: SparkSession, root: str) -> DataFrame:
    return _relative(images.decoded(images.read_images(spark, root)), root)


def split_val(spark: SparkSession, dataset: str, train: int, val: int, test: int, out: str) -> DataFrame:
    """Copy images and labels into a split tree below ``out``; returns the split's sizes."""
    found = files.inventory(spark, dataset)
    split = splits.random_split(files.scan_images_by_letters(found).select("path"), "path", (train, val, test))
    sinks.apply(sinks.plan_split(split, files.scan_labels(found)), dataset, out)
    return split.where("split IS NOT NULL").groupBy("split").count()


def generate_txt(spark: SparkSession, train: str, val: str, test: str | None = None) -> None:
    for name, folder in (("train", train), ("val", val), ("test", test)):
        if folder:
            parent = folder.rstrip("/").rpartition("/")[0]
            sinks.write_manifest(files.scan_images_by_letters(files.inventory(spark, folder)), folder, f"{parent}/{name}.txt")


def label_format_converter(spark: SparkSession, input_format: str, output_format: str, folder: str, classes_txt: str) -> None:
    found = files.scan_labels(files.inventory(spark, folder), input_format)
    classes = labels.class_list(spark.read.text(classes_txt, wholetext=True).withColumnRenamed("value", "text"))
    objects = joins.class_ids(labels.parse_voc(labels.read_texts(spark, folder, found)), classes)
    numbered = objects.withColumn("line_no", F.monotonically_increasing_id())
    box = geometry.voc_to_yolo("xmin", "ymin", "xmax", "ymax", "width", "height")
    lines = sinks.converted_lines(numbered.withColumns(dict(zip(("xc", "yc", "w", "h"), box, strict=True))))
    # Annotations without objects get an empty file.
    sinks.write_texts(sinks.texts_of(found, lines).withColumn("path", names.with_suffix("path", "." + output_format)), folder)


def move_labels(spark: SparkSession, root: str, source: str = "labels", dest: str = "other_classes", exact: bool = False) -> int:
    found = files.scan_labels(files.inventory(spark, f"{root}/{source}"))
    lines = labels.exploded(labels.read_texts(spark, f"{root}/{source}", found))
    chosen = joins.files_with(found, lines, filters.starts_with_class("line", exact=exact))
    moves = sinks.plan_moves(chosen, dest).withColumn("src", F.concat(F.lit(source + "/"), "src"))
    return sinks.apply(moves, root)


def tweak_json_labels(spark: SparkSession, source: str, out: str) -> None:
    """Remap vehicle classes into a tree below ``out``, with each label's image."""
    found = files.inventory(spark, source)
    chosen = files.scan_labels(found, skip_classes=True)
    kept = filters.remap_classes(labels.exploded(labels.read_texts(spark, source, chosen)))
    sinks.write_texts(sinks.texts_of(chosen, kept), out)
    pairs = joins.label_images(chosen, found).where("image IS NOT NULL")
    sinks.apply(sinks.plan(pairs, F.col("image"), F.col("image"), "copy"), source, out)


def tweak_yolo_labels(spark: SparkSession, folder: str, strict: bool = False) -> None:
    """Change leading digits in place: new texts go to a staging folder, then over the old ones, so no input is overwritten while it is read."""
    found = files.scan_labels(files.inventory(spark, folder))
    texts = labels.read_texts(spark, folder, found).where("text != ''")
    ends = F.regexp_extract_all("text", F.lit(r"[^\r\n]*(?:\r\n|\r|\n|\z)"), F.lit(0))
    changed = texts.select("path", F.array_join(F.transform(ends, lambda x: F.when(x == "", "").otherwise(filters.remap_leading(x, strict=strict))), "").alias("text"))
    staging = f"_staging_{uuid.uuid4().hex}"
    if sinks.write_texts(changed, f"{folder}/{staging}"):
        staged = files.inventory(spark, f"{folder}/{staging}")
        sinks.apply(sinks.plan(staged, F.concat(F.lit(staging + "/"), "path"), F.col("path"), "move"), folder)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{staging}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def convert_color(spark: SparkSession, folder: str, seed: int = 0) -> int:
    made = augment.colour_variants(_images(spark, folder), seed).withColumn("out", F.concat(names.without_suffix("path"), "tag", F.lit(".png")))
    found = files.inventory(spark, folder)
    n = sinks.write_pngs(made, folder)
    sinks.apply(sinks.plan_variant_labels(joins.keyed(files.scan_labels(found)).join(joins.keyed(files.scan_images_by_letters(found)).select("key"), "key", "left_semi"), splits.COLOUR_TAGS), folder)
    return n


def flip_photo(spark: SparkSession, folder: str) -> int:
    made = augment.flip_variants(_images(spark, folder)).withColumn("out", F.concat(names.without_suffix("path"), "tag", F.lit(".png")))
    return sinks.write_pngs(made, folder)


def resize_img(spark: SparkSession, source: str, out: str, width: int = 640, height: int = 640) -> int:
    made = augment.resized(_images(spark, source), width, height).withColumn("out", names.with_suffix("path", ".png"))
    return sinks.write_pngs(made, out)


def _boxes(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    return labels.parse_boxes(labels.exploded(labels.read_texts(spark, folder, found)))


def bbox_augmentation(spark: SparkSession, hyp_yaml: str, dataset: str, new_image: int = 5, out: str | None = None, seed: int = 0) -> int:
    """Augmented versions of images and boxes below ``out`` (``aug_dataset`` in the dataset by default).

    An image without a label, or a label without an image, raises before
    anything is written.  Every version gets a label file, empty where no box
    is left.
    """
    hyp = labels.Hyperparameters.load(hyp_yaml)
    found = files.inventory(spark, dataset)
    texts = files.scan_labels(found, skip_classes=True)
    pairs = joins.strict_pairs(files.scan_images(found), texts).persist()
    pairs.count()
    decoded = _images(spark, dataset)
    shapes = decoded.select(F.col("path").alias("image"), "width", "height")
    rows = pairs.join(shapes, "image").join(_boxes(spark, dataset, texts).withColumnRenamed("path", "label"), "label")
    corner = dict(zip(("x1", "y1", "x2", "y2"), geometry.truncated_corners("xc", "yc", "w", "h", "width", "height", single=True), strict=True))
    box = F.struct("class_id", *(v.cast("double").alias(k) for k, v in corner.items()))
    boxes = rows.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", box.alias("b")))), lambda x: x["b"]).alias("boxes"))
    sources = decoded.join(boxes.withColumnRenamed("image", "path"), "path", "left").withColumn("polygons", F.lit(None).cast("array<struct<class_id: int, points: array<struct<x: double, y: double>>>>"))
    versions = splits.replicate(sources, new_image)
    target = out or f"{dataset}/aug_dataset"
    n = sinks.write_pngs(augment.augment_images(versions, hyp, seed).withColumn("out", names.augmented_name("path", F.col("version"), ".png")), target)
    label = names.augmented_name("path", F.col("version"), ".txt").alias("path")
    moved = augment.augment_annotations(versions, hyp, seed)
    each = moved.select(label, "width", "height", F.posexplode("boxes").alias("line_no", "b")).select("path", "width", "height", "line_no", "b.*")
    kept = filters.centred(each)
    unit = geometry.normalise(geometry.xyxy_to_xywh("x1", "y1", "x2", "y2"), "width", "height")
    sinks.write_texts(sinks.texts_of(versions.select(label), sinks.box_lines(kept.withColumns(dict(zip(("xc", "yc", "w", "h"), unit, strict=True))))), target)
    return n


def seg_augmentation(spark: SparkSession, image_dir: str, annotation_dir: str, out: str, hyp_yaml: str, new_image: int = 5, seed: int = 0) -> int:
    """Augmented versions of images and polygons; images without a label or that can't be read are left out, and those with an empty label get empty ones."""
    hyp = labels.Hyperparameters.load(hyp_yaml)
    found = files.scan_labels(files.inventory(spark, annotation_dir))
    parsed = labels.parse_polygons(labels.exploded(labels.read_texts(spark, annotation_dir, found)).where("trim(line) != ''"))
    labelled = found.select(names.stem("path").alias("stem"), F.col("path").alias("label"))
    decoded = filters.readable(_images(spark, image_dir).withColumn("stem", names.stem("path")).join(labelled, "stem"))
    shapes = decoded.select("stem", "width", "height")
    scaled = parsed.withColumn("stem", names.stem("path")).join(shapes, "stem").withColumn("points", geometry.scale_polygon("points", "width", "height"))
    polygons = scaled.groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.struct("class_id", "points").alias("p")))), lambda x: x["p"]).alias("polygons"))
    sources = decoded.join(polygons, "stem", "left").withColumn("boxes", F.lit(None).cast("array<struct<class_id: int, x1: double, y1: double, x2: double, y2: double>>"))
    versions = splits.replicate(sources, new_image)
    n = sinks.write_pngs(augment.augment_images(versions, hyp, seed).withColumn("out", names.augmented_name("path", F.col("version"), ".png")), out)
    label = names.augmented_name("path", F.col("version"), ".txt").alias("path")
    each = augment.augment_annotations(versions, hyp, seed).select(label, "width", "height", F.posexplode("polygons").alias("line_no", "p")).select("path", "line_no", "p.class_id", geometry.correct_polygon(geometry.scale_polygon("p.points", 1.0 / F.col("width"), 1.0 / F.col("height")), "width", "height").alias("points"))
    sinks.write_texts(sinks.texts_of(versions.select(label), sinks.polygon_lines(each)), out)
    return n


def plot_yolo_labels(spark: SparkSession, dataset: str, classes_txt: str, output_count: int = 0, out: str | None = None) -> DataFrame:
    """Draw boxes on the first images and write those that have any; returns objects of each class in each image."""
    classes = labels.class_list(spark.read.text(classes_txt, wholetext=True).withColumnRenamed("value", "text"), outer=True)
    found = files.inventory(spark, dataset)
    first = filters.first_images(files.scan_images_by_letters(found, flat=True), output_count)
    paired = joins.optional_labels(first, files.scan_labels(found))
    texts = paired.where("label IS NOT NULL").select(F.col("label").alias("path"))
    decoded = _images(spark, dataset).join(first.select("path"), "path", "left_semi")
    boxes = joins.with_shapes(_boxes(spark, dataset, texts).withColumnRenamed("path", "label").join(paired.select("label", "path"), "label"), decoded)
    if out:
        corner = geometry.pixel_corners("xc", "yc", "w", "h", "width", "height")
        drawn = boxes.groupBy("path").agg(F.collect_list(F.struct("class_id", *(v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), corner, strict=True)))).alias("boxes"))
        made = augment.drawn(decoded.join(drawn, "path"), pixels.class_colours(max(1, classes.count())))
        sinks.write_pngs(made.withColumn("out", names.with_suffix("path", ".png")), out)
    return aggregates.class_histogram(decoded, boxes, classes)


def capture_frame(spark: SparkSession, videos: list[str], selection: DataFrame, out: str) -> int:
    frames = images.read_frames(spark, videos)
    chosen = live.selected(frames, selection).withColumn("out", F.concat(names.stem("path"), F.format_string("_frame%05d.png", "frame")))
    return sinks.write_pngs(chosen, out)


def detect_onnx(spark: SparkSession, models: list[str], frames: DataFrame, class_lists: list[DataFrame], conf_thres: list[float], img_size: int = 640) -> tuple[DataFrame, DataFrame]:
    """Detections above their model's threshold in whole pixels, and a summary for each frame and model."""
    return _kept(spark, inference.in_pixels(inference.detect(frames, models, img_size)), class_lists, conf_thres)


def _kept(spark: SparkSession, raw: DataFrame, class_lists: list[DataFrame], conf_thres: list[float]) -> tuple[DataFrame, DataFrame]:
    kept = filters.confident(raw, dict(enumerate(conf_thres, 1)))
    counts = kept.groupBy("path", "frame", "model", "class_id").agg(F.count("*").alias("n"))
    said = [aggregates.summaries(counts.where(F.col("model") == k), classes) for k, classes in enumerate(class_lists, 1)]
    summary = said[0]
    for other in said[1:]:
        summary = summary.unionByName(other)
    return kept, summary


def _class_file(spark: SparkSession, path: str) -> DataFrame:
    return labels.class_list(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def capture(spark: SparkSession, folder: str, selection_csv: str, out: str) -> int:
    """Frames of stored videos (.npy) that a table of path and frame asks for."""
    found = files.with_parts(files.inventory(spark, folder)).where("suffix = 'npy'").orderBy(names.path_order("path"))
    wanted = spark.read.csv(selection_csv, schema="path string, frame int", header=True)
    selection = wanted.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "path"))
    return capture_frame(spark, [f"{folder.rstrip('/')}/{r.path}" for r in found.collect()], selection, out)


def detect(
    spark: SparkSession, onnx: str, source: str, classes_txt: str, conf_thres: float = 0.5, second_onnx: str | None = None, second_classes_txt: str | None = None, second_conf_thres: float = 0.5,
    img_size: int = 640, out: str | None = None, no_label: bool = False, save_boxes: bool = False, save_txt: bool = False, save_conf: bool = False,
) -> DataFrame:
    """Detections on the images of a folder or the frames of a stored video; returns each frame's summary.

    ``out`` gets images with boxes drawn, text files and crops as asked; crops
    are of all detections, whatever their confidence.
    """
    if files.source_kind(source) == "stream":
        raise ValueError("start a live source with lumenframe.streaming.live")
    frames = images.read_frames(spark, [source]) if source.endswith(".npy") else _images(spark, source).withColumn("frame", F.lit(1))
    models = [onnx, *([second_onnx] if second_onnx else [])]
    lists = [_class_file(spark, classes_txt), *([_class_file(spark, second_classes_txt or classes_txt)] if second_onnx else [])]
    # Scored once; drawings, texts, crops and the summary all read these rows.
    raw = inference.in_pixels(inference.detect(frames, models, img_size)).persist()
    kept, summary = _kept(spark, raw, lists, [conf_thres, second_conf_thres][: len(models)])
    if out:
        box = F.struct("class_id", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))
        boxed = lambda rows: frames.join(rows.groupBy("path", "frame").agg(F.collect_list(box).alias("boxes")), ["path", "frame"])
        tagged = F.concat(names.stem("path"), F.lit("_"), F.col("frame").cast("string"))
        if not no_label:
            drawn = augment.drawn(boxed(kept).withColumn("path", tagged), pixels.class_colours(256))
            sinks.write_pngs(drawn.withColumn("out", F.concat("path", F.lit(".png"))), out)
        if save_boxes:
            for k in range(1, len(models) + 1):
                cut = augment.crops(boxed(raw.where(F.col("model") == k)).withColumn("path", tagged)).where("height > 0 AND width > 0")
                sinks.write_pngs(cut.withColumn("out", names.crop_name("path", F.lit(k), F.col("number"))), f"{out}/crops")
        if save_txt:
            shaped = kept.join(frames.select("path", "frame", "width", "height"), ["path", "frame"])
            unit = geometry.normalise(geometry.xyxy_to_xywh("x1", "y1", "x2", "y2"), "width", "height")
            lines = inference.label_lines(shaped.withColumns(dict(zip(("xc", "yc", "w", "h"), unit, strict=True))), save_conf)
            name = names.detection_text_name("path", F.col("frame"), F.lit(source.endswith(".npy")))
            ordered = lines.select(name.alias("path"), F.struct("model", "det_no").alias("line_no"), "line")
            sinks.write_texts(sinks.file_texts(ordered), f"{out}/labels", append=True)
    return summary


#: Command, function, arguments; those with "=" have a default, ":int", ":float" and ":flag" say their kind.
COMMANDS = {
    "capture_frame": (capture, ("input_dir", "selection_csv", "out")),
    "detect_onnx": (detect, ("onnx", "source", "classes_txt", "--conf-thres:float=0.5", "--second-onnx=", "--second-classes-txt=", "--second-conf-thres:float=0.5", "--img-size:int=640", "--out=", "--no-label:flag", "--save-boxes:flag", "--save-txt:flag", "--save-conf:flag")),
    "add_empty_labels": (add_empty_labels, ("dataset",)),
    "bbox_augmentation": (bbox_augmentation, ("hyp", "dataset", "--new-image:int=5")),
    "convert_color": (convert_color, ("dataset_dir",)),
    "count_object": (count_object, ("dataset_dir",)),
    "flip_photo": (flip_photo, ("dataset",)),
    "generate_txt": (generate_txt, ("train_dir", "val_dir", "--test-dir=")),
    "label_format_converter": (label_format_converter, ("input_format", "output_format", "label_dir", "classes_txt")),
    "move_labels": (move_labels, ("root",)),
    "plot_yolo_labels": (plot_yolo_labels, ("dataset_dir", "classes_txt", "output_count:int", "--out=")),
    "resize_img": (resize_img, ("input_dir", "output_dir", "--width:int=640", "--height:int=640")),
    "seg_augmentation": (seg_augmentation, ("image_dir", "annotation_dir", "output_dir", "hyp", "--new_image:int=5")),
    "split_val": (split_val, ("dataset_dir", "train:int", "val:int", "test:int", "out")),
    "tweak_json_labels": (tweak_json_labels, ("input_dir", "output_dir")),
    "tweak_yolo_labels": (tweak_yolo_labels, ("folder",)),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenframe")
    subs = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = subs.add_parser(name)
        for a in arguments:
            text, _, default = a.partition("=")
            flag, _, kind = text.partition(":")
            if kind == "flag":
                sub.add_argument(flag, action="store_true")
                continue
            of = {"int": int, "float": float}.get(kind, str)
            sub.add_argument(flag, type=of, **({"default": of(default) if default else None} if flag.startswith("--") else {}))
    found = vars(parser.parse_args(argv))
    function = COMMANDS[found.pop("command")][0]
    spark = SparkSession.builder.appName("lumenframe").getOrCreate()
    result = function(spark, *found.values())
    if isinstance(result, DataFrame):
        result.show(1000, truncate=False)
    elif result is not None:
        print(result)


if __name__ == "__main__":
    main()
