"""Sinks: plan tables, label files, manifests and image files.

Copies, moves and new empty files are rows of a plan (src, dst, action) first;
``apply`` carries them out.  Executors do the work, each row by itself, through
Arrow's file systems (local, HDFS, S3, GCS by address); a file is written under
another name first and then renamed, so a task that runs again does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import formats, names
from lumenframe.operators.joins import images_without_labels, label_images


def plan(rows: DataFrame, src: Column, dst: Column, action: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(action).alias("action"))


def plan_empty_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """An empty label for each image without one."""
    missing = images_without_labels(images, labels)
    return plan(missing, F.lit(None).cast("string"), F.concat("key", F.lit(".txt")), "touch")


def plan_split(split: DataFrame, labels: DataFrame, dest: str = "split_dataset/images", compat: bool = False) -> DataFrame:
    """Copies of images (path, split) and of their labels, where there are any."""
    to = F.concat_ws("/", F.lit(dest), "split")
    chosen = split.where(F.col("split").isNotNull())
    images = plan(chosen, F.col("path"), names.split_path("path", to), "copy")
    text = chosen.withColumn("label", names.with_suffix("path", ".txt")).join(labels.select(F.col("path").alias("label")), "label", "left_semi")
    return images.unionByName(plan(text, F.col("label"), names.split_label_path("path", to, compat), "copy"))


def plan_label_images(labels: DataFrame, images: DataFrame, out: str) -> DataFrame:
    """Copies of labels' images (the png, else the jpg) to the labels' new folder."""
    found = label_images(labels, images).where(F.col("image").isNotNull())
    return plan(found, F.col("image"), names.tweak_path("image", out), "copy")


def plan_variant_labels(labels: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    each = labels.withColumn("tag", F.explode(F.array(*map(F.lit, tags))))
    return plan(each, F.col("path"), F.concat(names.without_suffix("path"), F.col("tag"), F.lit(".txt")), "copy")


def plan_moves(labels: DataFrame, folder: str) -> DataFrame:
    """Moves into one flat folder; of files with one name the last by path stays and the others go, as if moved in turn."""
    named = labels.withColumn("dst", F.concat(F.lit(folder + "/"), names.file_name("path")))
    last = named.groupBy("dst").agg(F.max_by("path", F.split("path", "/")).alias("last"))
    action = F.when(F.col("path") == F.col("last"), "move").otherwise("remove")
    return named.join(last, "dst").select(F.col("path").alias("src"), "dst", action.alias("action"))


def _opened(root: str):
    """A file system and the path of ``root`` in it; called in workers."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root if "://" in root else f"file://{root}")


def _replace(fs, path: str, data: bytes) -> None:
    import os
    import uuid

    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly, since a listing's rows come in few partitions and each is a file's work."""
    return df.repartition(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def apply(plan_rows: DataFrame, root: str, out: str | None = None) -> int:
    """Carry out a plan below ``root`` (destinations below ``out``, if given); returns the number of rows.

    A row whose source is gone and whose destination is there has been done
    before, by an attempt that was lost.
    """

    def work(batches):
        import os

        import pandas as pd
        from pyarrow.fs import FileType

        fs, base = _opened(root)
        _, target = _opened(out or root)
        for batch in batches:
            for r in batch.itertuples(index=False):
                dst = f"{target}/{r.dst}"
                if r.action == "touch":
                    _replace(fs, dst, b"")
                    continue
                src = f"{base}/{r.src}"
                if r.action == "remove":
                    if fs.get_file_info(src).type != FileType.NotFound:
                        fs.delete_file(src)
                    continue
                if r.action not in ("copy", "move"):
                    raise ValueError(f"no such action: {r.action}")
                if r.action == "move" and fs.get_file_info(src).type == FileType.NotFound and fs.get_file_info(dst).type != FileType.NotFound:
                    continue
                fs.create_dir(os.path.dirname(dst), recursive=True)
                (fs.move if r.action == "move" else fs.copy_file)(src, dst)
            yield pd.DataFrame({"n": [len(batch)]})

    return _spread(plan_rows.select("src", "dst", "action")).mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def box_lines(boxes: DataFrame) -> DataFrame:
    """``line`` of boxes (class_id, xc, yc, w, h), with six decimals."""
    return boxes.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *(formats.fixed6(F.col(c)) for c in ("xc", "yc", "w", "h"))))


def polygon_lines(polygons: DataFrame) -> DataFrame:
    """``line`` of polygons (class_id, points), with six decimals."""
    keys = [c for c in polygons.columns if c not in ("class_id", "points")]
    each = polygons.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, "class_id", F.posexplode_outer("points").alias("_k", "p"))
    said = each.withColumn("_say", F.concat_ws(" ", formats.fixed6(F.col("p.x")), formats.fixed6(F.col("p.y"))))
    joined = said.groupBy("_row", *keys, "class_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_say")))), lambda x: x["_say"]), " ").alias("_points"))
    return joined.select(*keys, F.concat_ws(" ", F.col("class_id").cast("string"), F.when(F.col("_points") != "", F.col("_points"))).alias("line"))


def converted_lines(boxes: DataFrame) -> DataFrame:
    """``line`` of converted boxes, each number in its shortest form."""
    return boxes.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *(formats.shortest(F.col(c)) for c in ("xc", "yc", "w", "h"))))


def file_texts(rows: DataFrame, line_no: str = "line_no") -> DataFrame:
    """(path, text): the lines of each file in order, each with its end."""
    ordered = F.array_sort(F.collect_list(F.struct(line_no, "line")))
    return rows.groupBy("path").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def write_texts(texts: DataFrame, root: str, append: bool = False) -> int:
    """Write (path, text) as files below ``root``, each whole; returns how many.

    ``append`` adds to files that are there; a task that runs again would add
    twice, so each text should hold all that its file gets in a run.
    """

    def work(batches):
        import pandas as pd
        from pyarrow.fs import FileType

        fs, base = _opened(root)
        for batch in batches:
            for r in batch.itertuples(index=False):
                path, old = f"{base}/{r.path}", b""
                if append and fs.get_file_info(path).type != FileType.NotFound:
                    with fs.open_input_stream(path) as f:
                        old = f.read()
                _replace(fs, path, old + r.text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return _spread(texts.select("path", "text")).mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def texts_of(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, text) for each of ``files``: its lines, or an empty text where ``rows`` has none for it."""
    return files.select("path").join(file_texts(rows), "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"))


def write_manifest(paths: DataFrame, root: str, file: str) -> None:
    """One text file of absolute paths, sorted by path part.

    Executors sort ranges of the paths; one task reads the ranges in order and
    writes line by line, so no more than a batch of lines is held at a time.
    """
    base = root.rstrip("/") + "/"
    ordered = paths.orderBy(F.split("path", "/")).select(F.concat(F.lit(base), "path").alias("line")).coalesce(1)

    def work(batches):
        import os
        import uuid

        import pandas as pd

        fs, path = _opened(file)
        fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.part"
        n = 0
        with fs.open_output_stream(part) as f:
            for batch in batches:
                f.write("".join(f"{line}\n" for line in batch["line"]).encode())
                n += len(batch)
        fs.move(part, path)
        yield pd.DataFrame({"n": [n]})

    if not ordered.mapInPandas(work, "n long").collect():
        write_texts(paths.sparkSession.createDataFrame([(file.rpartition("/")[2], "")], "path string, text string"), file.rpartition("/")[0])


def write_pngs(images: DataFrame, root: str) -> int:
    """Write images (out, height, width, channels, data) as PNG files below ``root``, by the executors; returns how many."""

    def work(batches):
        import pandas as pd

        from lumenframe.functions import pixels

        fs, base = _opened(root)
        for batch in batches:
            for r in batch.itertuples(index=False):
                _replace(fs, f"{base}/{r.out}", pixels.png(pixels.to_array(r.data, r.height, r.width, r.channels)))
            yield pd.DataFrame({"n": [len(batch)]})

    return images.select("out", "height", "width", "channels", "data").mapInPandas(work, "n long").agg(F.sum("n")).first()[0] or 0


def increment_path(spark: SparkSession, path: str, exist_ok: bool = True, sep: str = "") -> str:
    """``path`` if it is free or may exist; else with the next number, from 2."""
    import re

    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if exist_ok or not fs.exists(at):
        return path
    stem = at.getName()
    found = [re.search(rf"{re.escape(stem)}{re.escape(sep)}(\d+)", s.getPath().getName()) for s in fs.listStatus(at.getParent())]
    numbers = [int(m[1]) for m in found if m]
    return f"{path}{sep}{max(numbers) + 1 if numbers else 2}"
