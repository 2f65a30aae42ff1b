"""Detection from end to end, with a stand-in for the model that always finds the same two boxes."""

import os

import numpy as np

from lumenframe.functions import pixels
from lumenframe.operators import inference
from lumenframe.plans import commands


def test_detections(spark, tmp_path, monkeypatch):
    with open(f"{tmp_path}/stand_in.py", "w") as f:
        f.write("import numpy as np\n\n\nclass Named:\n    name = 'x'\n\n\nclass Session:\n    def get_inputs(self):\n        return [Named]\n\n    get_outputs = get_inputs\n\n    def run(self, outputs, inputs):\n        n = inputs['x'].shape[-1]\n        return [np.array([[0, 0, n / 4, n / 2, n * 3 / 4, 1, 0.9], [0, n / 4, n / 4, n / 2, n / 2, 0, 0.4]], np.float32)]\n")
    spark.sparkContext.addPyFile(f"{tmp_path}/stand_in.py")
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/a.png", "wb") as f:
        f.write(pixels.png(np.zeros((20, 40, 3), np.uint8)))
    for name, text in (("one.txt", "car\nbus\n"), ("two.txt", "cat\ndog\n")):
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write(text)
    found = commands.detect(spark, "py:stand_in:Session", f"{tmp_path}/in", f"{tmp_path}/one.txt", 0.5, "py:stand_in:Session", f"{tmp_path}/two.txt", 0.3, 64, f"{tmp_path}/out", save_boxes=True, save_txt=True, save_conf=True)
    assert {(r.model, r.summary) for r in found.collect()} == {(1, "1 bus, "), (2, "1 cat, 1 dog, ")}
    assert "a_1.png" in os.listdir(f"{tmp_path}/out")
    assert len([x for x in os.listdir(f"{tmp_path}/out/crops") if not x.endswith(".crc")]) == 4
    with open(f"{tmp_path}/out/labels/a.txt") as f:
        lines = f.read().splitlines()
    # The image is half as high as the square: 16 rows of border above it, and a ratio of 1.6.
    assert len(lines) == 3 and lines[0] == "1 0.25 0.5 0.5 1 0.9"


def test_sessions_are_kept():
    assert inference.session.cache_info().maxsize == 4
