"""CSV, TSV payloads, Parquet projections and region boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All columns as text, header read, a byte-order mark cut; compressed files (.bz2, .gz) too."""
    df = spark.read.options(header=True, **options).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, null as empty text."""
    df.write.mode(mode).options(header=True, nullValue="", emptyValue="").csv(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``id<TAB>base64`` lines: id, payload, size and ``malformed`` for lines that are not both."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("payload"))
    raw = F.try_to_binary("payload", F.lit("base64"))
    return rows.select("id", "payload", F.length(raw).alias("size"), (~F.coalesce(F.col("id").rlike(r"^\d+$"), F.lit(False)) | F.col("payload").isNull() | raw.isNull()).alias("malformed"))


def project(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """Only the named (nested) leaves of a Parquet source; the scan prunes all others."""
    return spark.read.parquet(path).select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


# Component names of region boxes and the region each stands for.
VIEW_SUFFIX = r"^(.*?)_?(ANT|POST)$"


def region_boxes(df: DataFrame, dims: dict[str, str] | None = None) -> DataFrame:
    """Region rows of a box CSV: component and view from the name's suffix, xywh text to an integer box, truthy flags."""
    num = lambda c: F.col(c).try_cast("double").cast("int")
    x, y, w, h = (num(c) for c in ("x", "y", "width", "height"))
    part = F.regexp_extract("component", VIEW_SUFFIX, 1)
    name = F.replace(F.lower(part), F.lit("_"), F.lit(" "))
    for short, full in (dims or {}).items():
        name = F.when(part == short, full).otherwise(name)
    return df.withColumns({"part": part, "view": F.nullif(F.regexp_extract("component", VIEW_SUFFIX, 2), F.lit("")), "region": name, "bbox": F.array(x, y, x + w, y + h)})


def truthy(col):
    return F.lower(F.trim(col)).isin("true", "1", "yes")


def zero_stripped_id(col):
    """``patient_00012`` to ``12``."""
    return F.regexp_replace(F.regexp_extract(col, r"(\d+)$", 1), "^0+(?=.)", "")


HOTSPOTS = T.StructType([
    T.StructField("size", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])),
    T.StructField("object", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("bndbox", T.StructType([T.StructField(c, T.IntegerType()) for c in ("xmin", "ymin", "xmax", "ymax")]))]))),
])


def read_hotspots(spark: SparkSession, path: str) -> DataFrame:
    """Annotation XML files: one row per object with its file's stem, place, label, box, image size and whether the box fits."""
    df = spark.read.format("xml").option("rowTag", "annotation").schema(HOTSPOTS).load(path).withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1))
    rows = df.select("stem", "size", F.posexplode("object").alias("pos", "o"))
    b = F.array(*[F.col(f"o.bndbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    fits = (F.get(b, F.lit(0)) >= 0) & (F.get(b, F.lit(1)) >= 0) & (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3))) & (F.get(b, F.lit(2)) <= F.col("size.width")) & (F.get(b, F.lit(3)) <= F.col("size.height"))
    return rows.select("stem", "pos", F.col("o.name").alias("label"), b.alias("bbox"), F.array("size.width", "size.height").alias("image_size"), F.coalesce(fits, F.lit(False)).alias("in_bounds"))


def caption_issues(df: DataFrame, first: int = 1, last: int = 39) -> DataFrame:
    """Caption ids out of range, missing, or with texts that differ between files."""
    ids = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("text_id"))
    per = df.groupBy("text_id").agg(F.count_distinct(F.trim("text")).alias("n"))
    out = ids.join(per, "text_id", "full").withColumn("issue", F.when(F.col("n").isNull(), "missing").when(~F.col("text_id").between(first, last), "out_of_range").when(F.col("n") > 1, "texts_differ"))
    return out.where("issue is not null").select("text_id", "issue")
