import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import pixels
from lumenframe.operators import augment, inference
from lumenframe.plans import commands
from lumenframe.sources import files, images, labels, sinks
from lumenframe.streaming import live

YAML = "hsv_h: 0.015\nhsv_s: 0.7\nhsv_v: 0.4\ncontrast: 0.5\ndegrees: 0\ntranslate: 0.1\nscale: 0.2\nshear: 0\nperspective: 0.2\nflipud: 0.5\nfliplr: 0.5\n"


def save(path, image):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(pixels.png(image))


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, found in os.walk(root) for n in found if not n.endswith(".crc"))


@pytest.fixture
def dataset(tmp_path):
    rng = np.random.default_rng(1)
    for k, name in enumerate(("a", "sub/b", "c")):
        save(f"{tmp_path}/data/{name}.png", rng.integers(0, 256, (20 + k, 30, 3), dtype=np.uint8))
    put(f"{tmp_path}/data/a.txt", "0 0.5 0.5 0.5 0.5\n1 0.2 0.2 0.1 0.1\n")
    put(f"{tmp_path}/data/sub/b.txt", "")
    return str(tmp_path / "data")


def test_png_round_trip(spark, dataset):
    read = images.read_images(spark, dataset).where(F.col("path").endswith("/a.png")).first()
    rng = np.random.default_rng(1)
    assert (pixels.to_array(read.data, read.height, read.width, read.channels) == rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)).all()


def test_inventory_has_empty_and_hidden_files(spark, dataset):
    put(f"{dataset}/_x.txt", "")
    put(f"{dataset}/.y.txt", "z")
    found = {r.path: r.length for r in files.inventory(spark, dataset).where("suffix = 'txt'").collect()}
    assert found == {"a.txt": 36, "sub/b.txt": 0, "_x.txt": 0, ".y.txt": 1}


def test_empty_labels_and_count(spark, dataset):
    assert commands.add_empty_labels(spark, dataset) == 1
    assert os.path.getsize(f"{dataset}/c.txt") == 0
    assert commands.count_object(spark, dataset) == 2


def test_split(spark, dataset, tmp_path):
    commands.split_val(spark, dataset, 10, 0, 0, str(tmp_path))
    assert [p for p in tree(f"{tmp_path}/split_dataset")] == ["images/train/a.png", "images/train/b.png", "images/train/c.png", "labels/train/a.txt", "labels/train/b.txt"]


def test_manifests(spark, dataset, tmp_path):
    commands.generate_txt(spark, dataset, dataset)
    with open(f"{tmp_path}/train.txt") as f:
        assert f.read().splitlines() == [f"{dataset}/{n}" for n in ("a.png", "c.png", "sub/b.png")]


def test_converter(spark, tmp_path):
    xml = "<a><size><width>3</width><height>7</height></size><object><name>y</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>2</xmax><ymax>3</ymax></bndbox></object></a>"
    put(f"{tmp_path}/l/a.xml", xml)
    put(f"{tmp_path}/classes.txt", "x\ny\n")
    commands.label_format_converter(spark, "xml", "txt", f"{tmp_path}/l", f"{tmp_path}/classes.txt")
    with open(f"{tmp_path}/l/a.txt") as f:
        assert f.read() == f"1 {(1.0 + 2.0) / (2 * 3.0)} {(1.0 + 3.0) / (2 * 7.0)} {(2.0 - 1.0) / 3.0} {(3.0 - 1.0) / 7.0}\n"


def test_moves_and_remaps(spark, tmp_path):
    put(f"{tmp_path}/labels/p/a.txt", "2 x\n 1 y\n")
    put(f"{tmp_path}/labels/b.txt", "5 x\r\n23 z\r\n")
    put(f"{tmp_path}/labels/a.txt", "0 first\n")
    assert commands.move_labels(spark, str(tmp_path)) == 2
    with open(f"{tmp_path}/other_classes/a.txt") as f:
        assert f.read() == "2 x\n 1 y\n"
    assert tree(tmp_path) == ["labels/b.txt", "other_classes/a.txt"]
    commands.tweak_yolo_labels(spark, f"{tmp_path}/labels")
    with open(f"{tmp_path}/labels/b.txt", newline="") as f:
        assert f.read() == "2 x\r\n33 z\r\n"
    put(f"{tmp_path}/j/a.txt", "3 x\n7 y\n")
    put(f"{tmp_path}/j/a.jpg", "j")
    commands.tweak_json_labels(spark, f"{tmp_path}/j", f"{tmp_path}/out")
    assert tree(f"{tmp_path}/out") == ["a.jpg", "a.txt"]
    with open(f"{tmp_path}/out/a.txt") as f:
        assert f.read() == "1 x\n"


def test_variants(spark, dataset):
    assert commands.convert_color(spark, dataset) == 12
    assert os.path.exists(f"{dataset}/a_brt.txt") and os.path.exists(f"{dataset}/sub/b_ivt.txt")
    assert "a_cot.png" in tree(dataset)


def test_flips_and_sizes(spark, dataset, tmp_path):
    assert commands.flip_photo(spark, dataset) == 9
    assert commands.resize_img(spark, dataset, f"{tmp_path}/small", 8, 4) == 12
    read = images.read_images(spark, f"{tmp_path}/small").collect()
    assert {(r.width, r.height) for r in read} == {(8, 4)}


def test_augmentation(spark, dataset, tmp_path):
    put(f"{tmp_path}/hyp.yaml", YAML)
    commands.add_empty_labels(spark, dataset)
    assert commands.bbox_augmentation(spark, f"{tmp_path}/hyp.yaml", dataset, 2, f"{tmp_path}/out") == 6
    made = tree(f"{tmp_path}/out")
    assert "a_aug_1.png" in made and "a_aug_2.txt" in made
    for line in open(f"{tmp_path}/out/a_aug_1.txt"):
        assert all(0 <= float(v) <= 1 for v in line.split()[1:])
    put(f"{tmp_path}/seg/a.txt", "2 0.1 0.1 0.9 0.1 0.5 0.9\n")
    assert commands.seg_augmentation(spark, dataset, f"{tmp_path}/seg", f"{tmp_path}/segout", f"{tmp_path}/hyp.yaml", 1) == 1
    with open(f"{tmp_path}/segout/a_aug_1.txt") as f:
        values = f.read().split()
    assert values[0] == "2" and len(values) == 7 and all(0 <= float(v) <= 1 for v in values[1:])
    assert "degrees=0.0" in labels.Hyperparameters.load(f"{tmp_path}/hyp.yaml").echo()
    put(f"{tmp_path}/bad.yaml", YAML.replace("degrees", "rotate"))
    with pytest.raises(KeyError):
        labels.Hyperparameters.load(f"{tmp_path}/bad.yaml")


@pytest.mark.parametrize("odd", ["image", "label", "twice"])
def test_unmatched_files_raise_before_anything_is_written(spark, dataset, tmp_path, odd):
    put(f"{tmp_path}/hyp.yaml", YAML)
    commands.add_empty_labels(spark, dataset)
    if odd == "image":
        os.remove(f"{dataset}/c.txt")
    elif odd == "label":
        put(f"{dataset}/z.txt", "0 0.5 0.5 0.5 0.5\n")
    else:
        save(f"{dataset}/a.PNG", np.zeros((8, 8, 3), np.uint8))
    with pytest.raises(Exception, match="image and label don't match"):
        commands.bbox_augmentation(spark, f"{tmp_path}/hyp.yaml", dataset, 1, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_every_version_has_a_label_file(spark, dataset, tmp_path):
    """Background images keep their empty label, for boxes and for polygons."""
    put(f"{tmp_path}/hyp.yaml", YAML)
    commands.add_empty_labels(spark, dataset)
    assert commands.bbox_augmentation(spark, f"{tmp_path}/hyp.yaml", dataset, 2, f"{tmp_path}/out") == 6
    assert tree(f"{tmp_path}/out") == sorted(f"{n}_aug_{k}.{e}" for n in "abc" for k in (1, 2) for e in ("png", "txt"))
    assert all(os.path.getsize(f"{tmp_path}/out/{n}_aug_{k}.txt") == 0 for n in "bc" for k in (1, 2)) and os.path.getsize(f"{tmp_path}/out/a_aug_1.txt")
    put(f"{tmp_path}/seg/a.txt", "2 0.1 0.1 0.9 0.1 0.5 0.9\n")
    put(f"{tmp_path}/seg/c.txt", "")
    assert commands.seg_augmentation(spark, dataset, f"{tmp_path}/seg", f"{tmp_path}/segout", f"{tmp_path}/hyp.yaml", 1) == 2
    assert tree(f"{tmp_path}/segout") == ["a_aug_1.png", "a_aug_1.txt", "c_aug_1.png", "c_aug_1.txt"]
    assert os.path.getsize(f"{tmp_path}/segout/c_aug_1.txt") == 0


def test_annotations_move_as_with_their_pixels(spark, dataset):
    hyp = labels.Hyperparameters(0.015, 0.7, 0.4, 10, 0.1, 0.2, 5, 0.5, 0.5)
    box, polygon = "array<struct<class_id: int, x1: double, y1: double, x2: double, y2: double>>", "array<struct<class_id: int, points: array<struct<x: double, y: double>>>>"
    given = images.read_images(spark, dataset).withColumns({"boxes": F.expr(f"CAST(array(struct(1, 1, 2, 9, 8)) AS {box})"), "polygons": F.expr(f"CAST(array(struct(2, array(struct(1, 2), struct(5, 6)))) AS {polygon})"), "version": F.lit(3)})
    said = ("path", "version", "polygons", "boxes")
    whole = augment.augment_images(given, hyp).select(*said)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, augment.augment_annotations(given, hyp).select(*said).collect()))


def test_annotation_without_objects(spark, tmp_path):
    put(f"{tmp_path}/l/none.xml", "<annotation><size><width>3</width><height>7</height></size></annotation>")
    put(f"{tmp_path}/classes.txt", "x\n")
    commands.label_format_converter(spark, "xml", "txt", f"{tmp_path}/l", f"{tmp_path}/classes.txt")
    assert tree(f"{tmp_path}/l") == ["none.txt", "none.xml"] and os.path.getsize(f"{tmp_path}/l/none.txt") == 0


def test_manifest_of_many_and_of_none(spark, tmp_path):
    rows = [(f"d{k % 7}/x{k * 37 % 500}.png",) for k in range(500)]
    sinks.write_manifest(spark.createDataFrame(rows, "path string").repartition(7), "/data/", f"{tmp_path}/m/all.txt")
    with open(f"{tmp_path}/m/all.txt") as f:
        assert f.read().splitlines() == [f"/data/{'/'.join(p)}" for p in sorted(r[0].split("/") for r in rows)]
    sinks.write_manifest(spark.createDataFrame([], "path string"), "/data", f"{tmp_path}/m/none.txt")
    assert os.path.getsize(f"{tmp_path}/m/none.txt") == 0
    assert tree(f"{tmp_path}/m") == ["all.txt", "none.txt"]


def test_inventory_of_deep_trees(spark, tmp_path):
    for k in range(12):
        put(f"{tmp_path}/t/d{k}/e/f g%20+/x{k}.txt", "y" * k)
    put(f"{tmp_path}/t/top.txt", "z")
    found = {(r.path, r.length) for r in files.inventory(spark, f"{tmp_path}/t").collect()}
    assert found == {(f"d{k}/e/f g%20+/x{k}.txt", k) for k in range(12)} | {("top.txt", 1)}
    with pytest.raises(Exception, match="(?i)not exist|no such"):
        files.inventory(spark, f"{tmp_path}/absent")


def test_frames_of_decoders(spark, tmp_path):
    """A decoder may give a sequence or an iterable; a live source is one with an end of its own."""
    for name in ("sequence", "walked"):
        found = images.read_frames(spark, ["rtsp://camera"], f"tests.readers:{name}").orderBy("frame").collect()
        assert [(r.frame, r.data[0]) for r in found] == [(k + 1, k) for k in range(5)]
        seen = []
        stream = spark.readStream.format("frames").option("path", "rtsp://camera").option("decoder", f"tests.readers:{name}").option("perBatch", 2).load()
        query = live.conflated(stream, "path", ("frame",), lambda batch, n, seen=seen: seen.append([r.frame for r in batch.select("frame").collect()]), f"{tmp_path}/{name}", now=False)
        query.processAllAvailable()
        assert [x for x in seen if x] == [[2], [4], [5]]
        assert len(live.rates(query)) == 3 and all(rate > 0 for _, rate in live.rates(query))
        query.stop()


def test_outputs_by_path(spark, tmp_path):
    """A batch that runs again replaces its own rows and no others."""
    write = live.write_by_path(f"{tmp_path}/out")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "path string, frame int")
    write(one, 0)
    write(spark.createDataFrame([("a", 3)], "path string, frame int"), 1)
    write(one, 0)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.path, r.batch, r.frame) for r in found.collect()) == [("a", 0, 1), ("a", 1, 3), ("b", 0, 2)]


class Counting:
    """A model that says how many images it was given, and their means."""

    calls = []

    def __init__(self, first):
        self.first = first

    def get_inputs(self):
        return [type("Input", (), {"name": "x", "shape": [self.first, 3, 4, 4]})]

    def get_outputs(self):
        return [type("Output", (), {"name": "y"})]

    def run(self, outputs, inputs):
        x = inputs["x"]
        self.calls.append(len(x))
        return [np.array([[k, 0, 0, 1, 1, k, v.mean()] for k, v in enumerate(x) if v.mean() > 0], np.float32)]


@pytest.mark.parametrize(("first", "calls"), [("batch", [4, 3]), (1, [1] * 7), (3, [3, 3, 3])])
def test_batches_of_images(monkeypatch, first, calls):
    model = Counting(first)
    monkeypatch.setattr(Counting, "calls", [])
    monkeypatch.setattr(inference, "session", lambda _: model)
    tensors = np.stack([np.full((3, 4, 4), k / 8, np.float32) for k in range(7)])
    found = dict(inference.run_batches("m", tensors, 4))
    assert model.calls == calls
    assert [len(found[k]) for k in range(7)] == [0, 1, 1, 1, 1, 1, 1]
    assert all(abs(found[k][0, 5] - k / 8) < 1e-6 for k in range(1, 7))


def test_plot(spark, dataset, tmp_path):
    put(f"{tmp_path}/classes.txt", "x\ny")
    found = commands.plot_yolo_labels(spark, dataset, f"{tmp_path}/classes.txt", 0, f"{tmp_path}/drawn").collect()
    assert sorted(tuple(r) for r in found) == [("a.png", "x", 1), ("a.png", "y", 1), ("c.png", "x", 0), ("c.png", "y", 0)]
    assert tree(f"{tmp_path}/drawn") == ["a.png"]


def test_frames(spark, tmp_path):
    video = np.arange(5 * 2 * 3 * 3, dtype=np.uint8).reshape(5, 2, 3, 3)
    np.save(f"{tmp_path}/v.npy", video)
    frames = images.read_frames(spark, [f"{tmp_path}/v.npy"])
    assert sorted(r.frame for r in frames.collect()) == [1, 2, 3, 4, 5]
    wanted = spark.createDataFrame([(f"{tmp_path}/v.npy", 2), (f"{tmp_path}/v.npy", 9)], "path string, frame int")
    assert commands.capture_frame(spark, [f"{tmp_path}/v.npy"], wanted, f"{tmp_path}/shots") == 1
    assert tree(f"{tmp_path}/shots") == ["v_frame00002.png"]
    seen = []
    spark.dataSource.register(images.FrameSource)
    stream = spark.readStream.format("frames").option("path", f"{tmp_path}/v.npy").option("perBatch", 3).load()
    query = live.conflated(stream, "path", ("frame",), lambda batch, n: seen.append([r.frame for r in batch.select("frame").collect()]), f"{tmp_path}/checkpoint", now=False)
    query.processAllAvailable()
    query.stop()
    assert [x for x in seen if x] == [[3], [5]]


def test_latest_frame_streams_as_in_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "event_id")
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    live.conflated(stream, "user_id", ("ts", "event_id"), lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(live.latest(events, "user_id", "ts", "event_id").collect())


def test_increment(spark, tmp_path):
    run = f"{tmp_path}/exp"
    assert sinks.increment_path(spark, run, exist_ok=False) == run
    os.makedirs(run)
    assert sinks.increment_path(spark, run) == run
    assert sinks.increment_path(spark, run, exist_ok=False) == run + "2"
    os.makedirs(run + "7")
    assert sinks.increment_path(spark, run, exist_ok=False) == run + "8"


def test_append(spark, tmp_path):
    text = spark.createDataFrame([("a.txt", "x\n")], "path string, text string")
    for _ in range(2):
        sinks.write_texts(text, str(tmp_path), append=True)
    with open(f"{tmp_path}/a.txt") as f:
        assert f.read() == "x\nx\n"


def test_model_scores(spark):
    onnxruntime = pytest.importorskip("onnxruntime")
    model = os.path.join(os.path.dirname(onnxruntime.__file__), "datasets", "mul_1.onnx")
    if not os.path.exists(model):
        pytest.skip("no sample model")
    rows = spark.createDataFrame([(k, [float(k), 1.0, 2.0]) for k in range(5)], "vec_id long, v array<double>").coalesce(1)
    found = {r.vec_id: r.output for r in inference.score_vectors(rows, model, "vec_id", "v", 2, 3).collect()}
    assert len(found) == 5 and all(len(v) == 2 for v in found.values())
