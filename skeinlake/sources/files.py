"""Files as rows: inventories, digests, checksum lists, archive members, image features, reports."""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import fingerprint


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below a path: name relative to it, bytes, sha256 (read by executors, one file a row)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    root = path.rstrip("/")
    return files.select(F.regexp_replace("path", rf"^(file:)?/*{root.lstrip('/')}/", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of a set of files by name and content, whatever their order, with their number and bytes."""
    named = files.withColumn("_k", F.concat_ws("\x00", "file", "sha256"))
    size = files.agg(F.sum("bytes").alias("bytes"))
    return fingerprint(named, "_k").crossJoin(F.broadcast(size))


def write_checksums(files: DataFrame, path: str) -> None:
    """``<sha256>  <file>`` lines in order of the name."""
    files.orderBy("file").select(F.concat("sha256", F.lit("  "), "file")).write.mode("overwrite").text(path)


def check_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose checksum differs, that are missing, or that no line names. ``manifest`` has ``value`` lines."""
    want = manifest.select(F.substring("value", 1, 64).alias("_want"), F.regexp_replace("value", "^.{66}", "").alias("file"))
    out = files.join(want, "file", "full").withColumn("issue", F.when(F.col("sha256").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("sha256") != F.col("_want"), "changed"))
    return out.where("issue is not null").select("file", "issue")


def zip_members(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """Members of ZIP archives as rows: archive, member, text."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if not n.endswith("/") and (wanted is None or n == wanted):
                            yield pd.DataFrame({"archive": [p], "member": [n], "text": [z.read(n).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "archive string, member string, text string")


def image_features(spark: SparkSession, path: str) -> DataFrame:
    """Size, mean, deviation, histogram entropy and 256-bit average hash of images; needs Pillow on the executors."""
    try:
        import PIL  # noqa: F401
    except ImportError as e:
        raise RuntimeError("image features need Pillow") from e

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from PIL import Image

        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                im = Image.open(io.BytesIO(content)).convert("L")
                h = im.histogram()
                rows.append((p, *im.size, *gray_stats(h), average_hash(list(im.resize((16, 16)).getdata()))))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "mean", "std", "entropy", "a_hash"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(measure, "path string, width int, height int, mean double, std double, entropy double, a_hash string")


def gray_stats(histogram: list[int]) -> tuple[float, float, float]:
    """Mean, population deviation and entropy in bits of a 256-bin histogram."""
    n = sum(histogram) or 1
    mean = sum(i * c for i, c in enumerate(histogram)) / n
    var = sum(c * (i - mean) ** 2 for i, c in enumerate(histogram)) / n
    return mean, math.sqrt(var), -sum(c / n * math.log2(c / n) for c in histogram if c)


def average_hash(pixels: list[int]) -> str:
    """Bits above the mean as hex."""
    mean = sum(pixels) / max(len(pixels), 1)
    return f"{int(''.join('1' if p > mean else '0' for p in pixels) or '0', 2):0{len(pixels) // 4}x}"


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of small result tables, each shown whole."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def svg_overlay(size, boxes, colour: str = "red"):
    """SVG text of boxes over an image, as a column."""
    at = lambda b, i: F.get(b["bbox"], F.lit(i))
    rect = lambda b: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in ('<rect x="', at(b, 0).cast("string"), '" y="', at(b, 1).cast("string"), '" width="', (at(b, 2) - at(b, 0)).cast("string"), '" height="', (at(b, 3) - at(b, 1)).cast("string"), f'" fill="none" stroke="{colour}"/>')])
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), F.get(size, F.lit(0)).cast("string"), F.lit('" height="'), F.get(size, F.lit(1)).cast("string"), F.lit('">'), F.array_join(F.transform(boxes, rect), ""), F.lit("</svg>"))
