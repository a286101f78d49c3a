"""JSON lines and JSON documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmptySource(ValueError):
    """A source that must hold rows holds none."""


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict scan: a malformed line fails the job, an empty source raises ``EmptySource``."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise EmptySource(path)
    return df


def read_jsonl_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant scan: malformed lines are kept as text in ``_corrupt``; empty sources give no rows."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_trailing_commas(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines that may end in a comma."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("v")).where("v <> ''")
    return lines.select(F.from_json("v", schema).alias("r")).select("r.*")


def sorted_json(kind: T.DataType, col: Column, drop_nulls: bool = True) -> Column:
    """JSON text of a struct with the keys of every level in order."""
    return F.to_json(_ordered(kind, col), {"ignoreNullFields": str(drop_nulls).lower()})


def _ordered(kind: T.DataType, col: Column) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(col.isNotNull(), F.struct(*[_ordered(f.dataType, col[f.name]).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(col, lambda x: _ordered(kind.elementType, x))
    return col


@F.pandas_udf(T.StringType())
def _escaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c if c < "\x80" else json.dumps(c)[1:-1] for c in t), na_action="ignore")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", drop_nulls: bool = True, ascii_only: bool = False) -> None:
    """One object a line, keys sorted, written in parallel; with ``ascii_only`` all other signs as escapes."""
    line = sorted_json(df.schema, F.struct(*df.columns), drop_nulls)
    df.select((F.when(line.rlike("[^\\x00-\\x7f]"), _escaped(line)).otherwise(line) if ascii_only else line).alias("value")).write.mode(mode).text(path)


def digest(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free sum of row hashes."""
    r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def write_once(df: DataFrame, path: str) -> bool:
    """Write if the path is new; the same rows again are no-op (False), other rows raise."""
    spark = df.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        write_jsonl(df, path)
        return True
    there = spark.read.schema(df.schema).json(path)
    if digest(there) != digest(df):
        raise FileExistsError(f"{path} holds other rows")
    return False


def read_rooted(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document whose rows are the root list, under one of the usual keys, or under a key per split.

    A dict of lists becomes their union with the key in ``split`` (kept if the rows have their own).
    """
    doc = spark.read.option("multiLine", True).json(path)
    roots = [n for n in ("data", "questions", "annotations", "items", "records") if n in doc.columns and isinstance(doc.schema[n].dataType, T.ArrayType)]
    if roots:
        return doc.select(F.explode(roots[0]).alias("r")).select("r.*")
    lists = [f.name for f in doc.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists and len(lists) == len(doc.columns):
        out = None
        for n in lists:
            part = doc.select(F.explode(n).alias("r")).select("r.*")
            part = part if "split" in part.columns else part.withColumn("split", F.lit(n))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
    return doc
