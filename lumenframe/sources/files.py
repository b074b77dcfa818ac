"""Sources: vectors, metadata, detections, frame maps, query sets, pictures, configuration.

Files are listed and read by Spark, so any store it knows will do; what can't be parsed is skipped.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.providers import encode_picture, picture_encoder
from ..functions.text import natural_key, parse_query

#: Detection confidence kept; detection and picture names in order of preference.
LEAST_CONFIDENCE, LEAST_BOX_CONFIDENCE, LEAST_OCR_CONFIDENCE = 0.15, 0.4, 0.3
DETECTION_SCHEMA = "detection_class_entities array<string>, detection_scores array<string>, detection_boxes array<array<double>>"


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _binary(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """Path, whether it is a folder, and size of what is in a folder of any store; nothing if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return sorted((s.getPath().toString(), s.isDirectory(), s.getLen()) for s in system.listStatus(where))


def first_usable(spark: SparkSession, paths: Sequence[str], least_bytes: int = 5) -> str | None:
    """The first path that is a file of more than ``least_bytes`` bytes: a list of places where a truth file may be."""
    for path in paths:
        if any(not folder and size > least_bytes for _, folder, size in _children(spark, path)):
            return path
    return None


def first_folder(spark: SparkSession, roots: Sequence[str], walk: str | None = None, named: str = "objects", more_than: int = 5) -> str | None:
    """The first of ``roots`` that exists; else the first folder under ``walk`` whose name holds ``named`` and that has more than so many entries."""
    for root in roots:
        if _children(spark, root):
            return root
    waiting = [walk] if walk else []
    while waiting:
        inside = _children(spark, waiting.pop(0))
        for path, folder, _ in inside:
            if folder:
                if named in path.rstrip("/").rpartition("/")[2].lower() and len(_children(spark, path)) > more_than:
                    return path
                waiting.append(path)
    return None


def read_vectors_of(spark: SparkSession, roots: Sequence[str], mount: str) -> DataFrame:
    """``read_vectors`` of the first of ``roots`` that has vector files, else of all of ``mount`` but paths of key frames and videos."""
    for root in roots:
        if _children(spark, root) and not _binary(spark, root, "*.[nN][pP][yY]").limit(1).isEmpty():
            return read_vectors(spark, root)
    return read_vectors(spark, mount, without=("keyframe", "video"))


def vector_files(spark: SparkSession, root: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``video_id, path`` of .npy files, one a video, found by names alone; of two files of one name the later path counts.

    ``without``: leave out paths that hold one of these words, as the fallback scan does.
    """
    files = _binary(spark, root, "*.[nN][pP][yY]").select("path")
    for word in without:
        files = files.where(~F.lower("path").contains(word))
    return files.groupBy(stem(F.col("path")).alias("video_id")).agg(F.max("path").alias("path"))


def read_vectors(spark: SparkSession, root: str, without: tuple[str, ...] = ()) -> DataFrame:
    """``video_id, frame_idx, embedding`` from .npy matrices in any store that Spark knows, a file a task; ``npy.scan_vectors`` reads large files by ranges of rows."""
    chosen = vector_files(spark, root, without)
    files = _binary(spark, root, "*.[nN][pP][yY]").join(chosen.select("path"), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["video_id"], batch["content"], strict=True):
                try:
                    matrix = np.load(io.BytesIO(content), allow_pickle=False)
                except (ValueError, OSError):
                    continue
                if matrix.ndim == 2:
                    for at in range(0, len(matrix), 4096):
                        part = matrix[at : at + 4096].astype("float32")
                        yield pd.DataFrame({"video_id": path, "frame_idx": np.arange(at, at + len(part), dtype="int32"), "embedding": list(part)})

    return files.select(stem(F.col("path")).alias("video_id"), "content").mapInPandas(run, "video_id string, frame_idx int, embedding array<float>")


def string_leaves(value: object) -> str:
    """All strings of a JSON value, depth first, each behind a space; keys, numbers and the like are left out."""
    out: list[str] = []
    rest = [value]
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            out.append(" " + x)
        elif isinstance(x, list):
            rest += reversed(x)
        elif isinstance(x, dict):
            rest += reversed(list(x.values()))
    return "".join(out)


def json_text(raw: Column) -> Column:
    """``string_leaves`` of JSON texts; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return string_leaves(json.loads(text)) if text is not None else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(raw)


def media_id(path: Column) -> Column:
    """File name up to ``_ocr`` or the first dot."""
    return F.split_part(F.split_part(F.regexp_extract(path, r"([^/]+)$", 1), F.lit("_ocr"), F.lit(1)), F.lit("."), F.lit(1))


def read_media_text(spark: SparkSession, root: str) -> DataFrame:
    """``video_id, text`` from JSON files; files of one id are joined in the order of their paths."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][sS][oO][nN]").text(root).withColumn("path", F.col("_metadata.file_path"))
    folder = F.lower(F.regexp_extract("path", r"^(.*)/", 1))
    kept = files.where(~folder.rlike("object|keyframe|video") & ~F.col("path").endswith("/local_val_gt.json"))
    return grouped_media(kept.select("path", F.col("value").alias("raw")))


def grouped_media(files: DataFrame) -> DataFrame:
    """The same of ``files(path, raw)``."""
    texts = files.select(media_id(F.col("path")).alias("video_id"), "path", json_text(F.col("raw")).alias("text")).where("text IS NOT NULL")
    joined = F.array_sort(F.collect_list(F.struct("path", "text")))
    return texts.groupBy("video_id").agg(F.concat(F.lit(" "), F.array_join(F.transform(joined, lambda s: s["text"]), " ")).alias("text"))


def detections_of(raw: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """``entity, score, box`` rows of ``raw`` JSON, zipped to the shortest array, from ``least`` on; other columns stay."""
    parsed = raw.withColumn("d", F.from_json("raw", DETECTION_SCHEMA))
    arrays = ["d.detection_class_entities", "d.detection_scores", "d.detection_boxes"]
    n = F.least(*[F.coalesce(F.size(a), F.lit(0)) for a in arrays])
    zipped = F.arrays_zip(*[F.slice(F.col(a), 1, F.greatest(n, F.lit(0))).alias(b) for a, b in zip(arrays, ("entity", "score", "box"), strict=True)])
    rest = [c for c in raw.columns if c != "raw"]
    rows = parsed.select(*rest, F.explode(zipped).alias("x")).select(*rest, "x.entity", F.col("x.score").try_cast("double").alias("score"), "x.box")
    return rows.where(F.col("score") >= least)


def read_detections(spark: SparkSession, root: str) -> DataFrame:
    """``video_id, frame_key, entity, score, box``: one JSON a frame, a folder a video."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root)
    path = F.col("_metadata.file_path")
    return detections_of(files.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("video_id"), stem(path).alias("frame_key"), F.col("value").alias("raw")))


def frame_keys(frame_idx: Column, frame_id: Column | None = None) -> Column:
    """Names under which a frame's detections may be found, best first."""
    pad = lambda x, n: F.when(F.length(x.cast("string")) >= n, x.cast("string")).otherwise(F.lpad(x.cast("string"), n, "0"))
    names = [pad(frame_idx, 3), pad(frame_idx + 1, 3), pad(frame_idx, 4), pad(frame_idx + 1, 4), pad(frame_idx, 5), frame_idx.cast("string"), (frame_idx + 1).cast("string")]
    if frame_id is not None:
        names += [frame_id, pad(frame_id, 3), pad(frame_id, 4)]
    return F.array(*names)


def resolve_frames(frames: DataFrame, known: DataFrame) -> DataFrame:
    """``frames(video_id, frame_idx)`` with the first of their names that ``known(video_id, frame_key)`` has."""
    tried = frames.select("video_id", "frame_idx", F.posexplode(frame_keys(F.col("frame_idx"))).alias("priority", "frame_key"))
    met = tried.join(known.select("video_id", "frame_key").distinct(), ["video_id", "frame_key"])
    return met.groupBy("video_id", "frame_idx").agg(F.min_by("frame_key", "priority").alias("frame_key"))


def frame_column(columns: list[str], maxima: dict[str, float]) -> str:
    """Which column of a frame map holds frame numbers: one named so, else the numeric one with the largest value, else the first."""
    named = [c for c in columns if "frame" in c.lower()]
    return named[0] if named else max(maxima, key=maxima.get) if maxima else columns[0]


def read_frame_maps(spark: SparkSession, root: str) -> DataFrame:
    """``video_id, frame_idx, frame_id`` from a CSV a video; a row's place is its frame index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, content in zip(batch["video_id"], batch["content"], strict=True):
                try:
                    table = pd.read_csv(io.BytesIO(content))
                except (ValueError, pd.errors.ParserError):
                    continue
                if len(table.columns):
                    numeric = table.select_dtypes("number")
                    ids = pd.to_numeric(table[frame_column(list(table.columns), numeric.max().to_dict())], errors="coerce")
                    rows = pd.DataFrame({"video_id": video, "frame_idx": np.arange(len(ids), dtype="int32"), "frame_id": ids}).dropna()
                    yield rows.astype({"frame_id": "int64"})

    return _binary(spark, root, "*.csv").select(stem(F.col("path")).alias("video_id"), "content").mapInPandas(run, "video_id string, frame_idx int, frame_id long")


def read_query_files(spark: SparkSession, root: str) -> DataFrame:
    """``query_id, ord, task, query, question, events`` of .txt files, also those in zips, in natural order of their paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def texts(path: str, content: bytes) -> Iterator[tuple[str, str]]:
            if path.lower().endswith(".txt"):
                yield path, content.decode("utf-8", "replace")
            elif path.lower().endswith(".zip"):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as zipped:
                        for name in zipped.namelist():
                            yield from texts(f"{path}/{name}", zipped.read(name))
                except zipfile.BadZipFile:
                    return

        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in texts(p, c)]
            yield pd.DataFrame(rows, columns=["path", "text"])

    found = _binary(spark, root, "*.{txt,TXT,zip,ZIP}").select("path", "content").mapInPandas(run, "path string, text string").dropDuplicates(["path"])
    return parsed_queries(found)


def parsed_queries(files: DataFrame) -> DataFrame:
    """The same of ``files(path, text)``."""
    rows = files.select(stem(F.col("path")).alias("query_id"), natural_key(F.col("path")).alias("key"), F.split("text", r"\r?\n").alias("lines"))
    order = F.row_number().over(Window.orderBy("key", "query_id"))  # a query set, not the corpus
    return rows.withColumn("ord", order).select("query_id", "ord", parse_query(F.col("query_id"), F.col("lines")).alias("q")).select("query_id", "ord", "q.*")


def keyframe_parts(path: Column) -> tuple[Column, Column]:
    """Video and frame of a picture's path: its folder and name."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), stem(path)


def resolve_pictures(frames: DataFrame, pictures: DataFrame) -> DataFrame:
    """``path`` of ``frames(video_id, frame_idx)``: by name, else the picture at that place in its sorted folder, the last one beyond it."""
    named = pictures.select("video_id", "path", stem(F.col("path")).alias("frame_key"))
    by_name = frames.select("video_id", "frame_idx", F.posexplode(frame_keys(F.col("frame_idx"))).alias("priority", "frame_key")).join(named, ["video_id", "frame_key"])
    by_name = by_name.groupBy("video_id", "frame_idx").agg(F.min_by("path", F.struct("priority", "path")).alias("named"))
    folder = Window.partitionBy("video_id")
    placed = pictures.select("video_id", F.col("path").alias("placed"), (F.row_number().over(folder.orderBy("path")) - 1).alias("place"), F.count(F.lit(1)).over(folder).alias("n"))
    sizes = placed.select("video_id", "n").distinct()
    wanted = frames.join(sizes, "video_id", "left").withColumn("place", F.least(F.col("frame_idx"), (F.col("n") - 1).cast("int")))
    out = wanted.join(placed.drop("n"), ["video_id", "place"], "left").join(by_name, ["video_id", "frame_idx"], "left")
    return out.select("video_id", "frame_idx", F.coalesce("named", "placed").alias("path"))


def read_pictures(spark: SparkSession, root: str) -> DataFrame:
    """``video_id, path, content`` of picture files, a folder a video."""
    files = _binary(spark, root, "*.{jpg,jpeg,png,JPG,JPEG,PNG}")
    return files.select(keyframe_parts(F.col("path"))[0].alias("video_id"), "path", "content")


def picture_features(pictures: DataFrame, encoder=picture_encoder) -> DataFrame:
    """``video_id, frame_idx, path, embedding`` of ``pictures(video_id, path, content)``: unit vectors of pictures in order.

    A picture that the encoder fails on (it gives null) is left out, and those behind it move up.
    """
    made = pictures.select("video_id", "path", encode_picture(F.col("content"), encoder).alias("embedding")).where("embedding IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("path")) - 1
    return made.select("video_id", place.alias("frame_idx"), "path", "embedding")


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
