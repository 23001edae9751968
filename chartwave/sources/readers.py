"""Readers of images, signal archives, annotations and progress logs."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = "*.{png,jpg,jpeg,bmp,tif,tiff,PNG,JPG,JPEG,BMP,TIF,TIFF}"


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per image file of a folder (or the file itself), whatever the case of its suffix."""
    return spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).load(path).dropDuplicates(["path"])


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (image_id, y, x, b, g, r) of decodable three-channel images."""
    image = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", SUFFIXES).load(path).select("image.*").where("nChannels = 3")
    rows = image.select(F.col("origin").alias("image_id"), "width", "data", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"))
    byte = lambda c: F.conv(F.hex(F.substr("data", F.col("i") * 3 + c + 1, F.lit(1))), 16, 10).cast("int")
    return rows.select("image_id", F.expr("CAST(i div width AS INT)").alias("y"), (F.col("i") % F.col("width")).alias("x"), byte(0).alias("b"), byte(1).alias("g"), byte(2).alias("r"))


def archive(content: bytes | None) -> dict[str, list[float]] | None:
    """Named arrays of an npz file; pickled ones are refused."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            return {k: np.atleast_1d(z[k]).astype(float).ravel().tolist() for k in z.files}
    except (ValueError, OSError, TypeError, zipfile.BadZipFile):
        return None


def signal_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, lead, v, sampling_rate) of all npz files below a folder; unreadable ones give no row."""

    @F.pandas_udf("map<string,array<double>>")
    def load(content: pd.Series) -> pd.Series:
        return content.map(archive)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)
    named = files.select("path", load("content").alias("m")).where("m IS NOT NULL")
    rate = F.coalesce(F.try_element_at("m", F.lit("sampling_rate"))[0], F.lit(500.0))
    rows = named.select("path", rate.alias("sampling_rate"), F.explode("m").alias("lead", "v"))
    lead = F.when(F.upper("lead") == "RHYTHM", F.lit("Rhythm")).otherwise(F.col("lead"))
    return rows.where("lead <> 'sampling_rate' AND NOT contains(lead, '__')").withColumn("lead", lead)


LABELME = "imageWidth int, imageHeight int, shapes array<struct<label:string,points:array<array<double>>>>"


def annotations(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Boxes (path, label, xa, ya, xb, yb, width, height) of annotation files with two-point shapes."""
    docs = spark.read.schema(LABELME).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    rows = docs.select("path", F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.explode("shapes").alias("s"))
    p = F.col("s.points")
    out = rows.where(F.size(p) >= 2).select("path", F.col("s.label").alias("label"), p[0][0].alias("xa"), p[0][1].alias("ya"), p[1][0].alias("xb"), p[1][1].alias("yb"), "width", "height")
    return out.where(F.col("label") == label) if label else out


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, cls, xc, yc, w, h) of label files: five numbers a line; other lines are dropped."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("f"))
    number = lambda i: F.try_element_at("f", F.lit(i + 1)).try_cast("double")
    rows = lines.select("path", number(0).cast("int").alias("cls"), *[number(i).alias(n) for i, n in enumerate(("xc", "yc", "w", "h"), 1)])
    return rows.dropna()


def progress_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of progress logs, as a batch or as a stream of files."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("text").load(path).withColumnRenamed("value", "line")


def sorted_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Image files by path; with `most` only the first ones (a look at a folder)."""
    files = image_files(spark, path).orderBy("path")
    return files.limit(most) if most else files


def result_archives(spark: SparkSession, root: str, name: str = "ecg_signals_mv.npz") -> DataFrame:
    """Archives of exactly this name below a folder, by path; one directly in it hides those further down."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    base = F.size(F.split(F.regexp_replace("path", "^file:(//)?", ""), "/"))
    direct = base == len(root.rstrip("/").split("/")) + 1
    found = files.withColumn("direct", direct)
    any_direct = found.where("direct").limit(1).select(F.lit(True).alias("hide"))
    return found.join(any_direct, F.lit(True), "left").where(F.coalesce("hide", F.lit(False)) == F.col("direct")).drop("direct", "hide").orderBy("path")


def sampling_rates(truth: DataFrame, own: DataFrame, key: str, default: float = 500.0) -> DataFrame:
    """(key, truth_hz, own_hz): a truth without a rate has the default, an extracted signal the truth's."""
    both = truth.select(key, F.col("sampling_rate").alias("t")).join(own.select(key, F.col("sampling_rate").alias("o")), key, "full")
    return both.select(key, F.coalesce("t", F.lit(default)).alias("truth_hz"), F.coalesce("o", "t", F.lit(default)).alias("own_hz"))


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name): a JSON file with an array of class names; an empty or other one is an error."""
    names = F.from_json(F.regexp_replace("value", r"\s+", " "), "array<string>")
    rows = spark.read.text(path, wholetext=True).select(names.alias("names"))
    right = F.assert_true(F.coalesce(F.size("names"), F.lit(0)) > 0, F.lit("a JSON array of class names is needed"))
    return rows.select(F.posexplode(F.when(right.isNull(), F.col("names"))).alias("ord", "name"))


#: Fields of a run's result, of both shapes: a success names its outputs, a failure its error.
RESULT = (
    "success boolean, error string, details string, run_id string, width long, height long, processed_image string, cropped_image string,"
    " npz_file string, prediction string, message string"
)


def result_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each result document (a JSON object a file) below a path, with its file and whether the run succeeded.

    Fields that a document lacks are null, a nested prediction stays JSON text.  ok is false for a
    document that reports failure, names an error or cannot be read.
    """
    read = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    ok = F.coalesce("success", F.col("error").isNull() & F.col("run_id").isNotNull())
    return read.select("*", F.col("_metadata.file_path").alias("file"), ok.alias("ok"))


def preferred_file(spark: SparkSession, folders: list[str], preferred: str, pattern: str) -> str:
    """The preferred file of the first folder that has it, else the first of the pattern by folder and name."""
    jvm = spark._jvm.org.apache.hadoop.fs
    found = []
    for folder in folders:
        at = jvm.Path(folder)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(jvm.Path(at, preferred)):
            return f"{folder.rstrip('/')}/{preferred}"
        found += sorted(str(f.getPath()) for f in system.globStatus(jvm.Path(at, pattern)) or [])
    if not found:
        raise FileNotFoundError(f"neither {preferred} nor {pattern} in {folders}")
    return found[0]


def orientation(content: bytes | None) -> int:
    """The orientation tag (1 to 8) of a JPEG's EXIF block; 1 without one."""
    at = 2
    while content and content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        block = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and block[:6] == b"Exif\0\0":
            tiff = block[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            start = number(4, 4)
            for k in range(number(start, 2)):
                entry = start + 2 + 12 * k
                if number(entry, 2) == 274:
                    value = number(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
        if content[at + 1] == 0xDA:
            break
        at += 2 + size
    return 1


def oriented_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files with the angle (0, 90, 180, 270) that their orientation tag asks to turn them by."""

    @F.pandas_udf("int")
    def tag(content: pd.Series) -> pd.Series:
        return content.map(orientation)

    files = image_files(spark, path).withColumn("tag", tag("content"))
    return files.withColumn("angle", F.when(F.col("tag").isin(3, 4), 180).when(F.col("tag").isin(5, 6), 90).when(F.col("tag").isin(7, 8), 270).otherwise(0))
