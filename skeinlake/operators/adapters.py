"""Question sets of other makers as rows of the standard form: which columns they have, and what must be made of them first.

Defined results
- rows whose image no listing names are kept apart with the reason; null and empty masks give no box
- a conversation is read in turns: a human turn counts with the assistant's turn right behind it, others are left out
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rle_box
from ..functions.grammar import parse_tags
from ..functions.text import last_ordinal
from .export import split_of_name
from .standard import standardise

# Columns of each layout by the standard field they hold.
LAYOUTS = {
    "slake": {"record_id": "qid", "image_id": "img_name", "question": "question", "answer": "answer", "region": "location"},
    "pathvqa": {"image_id": "image", "question": "question", "answer": "answer"},
    "heal": {"record_id": "id", "image_id": "image", "question": "question_text", "answer": "gt"},
}


def with_images(df: DataFrame, listing: DataFrame, image: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Rows whose image is listed, and the others with ``reason``."""
    named = listing.select(F.col(path).alias(image)).distinct()
    return df.join(named, image, "left_semi"), df.join(named, image, "left_anti").withColumn("reason", F.lit("no_image"))


def slake(df: DataFrame, listing: DataFrame, language: str = "en") -> tuple[DataFrame, DataFrame]:
    """Questions of one language whose image is there, in standard form; the rest as they are."""
    mine = df.where(F.lower(F.trim("q_lang")) == language) if "q_lang" in df.columns else df
    held, lost = with_images(mine, listing, "img_name")
    return standardise(held, "slake", LAYOUTS["slake"], task_hint="vqa"), lost


def pathvqa(df: DataFrame, path: str = "path") -> DataFrame:
    """Shards as rows: the split comes from the file's name if the rows have none."""
    rows = df if "split" in df.columns else df.withColumn("split", split_of_name(F.col(path)))
    return standardise(rows.drop(path), "pathvqa", LAYOUTS["pathvqa"], task_hint="vqa")


def heal(df: DataFrame, counts: str = "mask_counts", height: str = "mask_height") -> DataFrame:
    """Run-length masks as boxes: rows with an empty or null mask are plain questions."""
    boxed = df.withColumn("bbox", rle_box(F.col(counts), F.col(height)).cast("array<double>")).drop(counts, height)
    return standardise(boxed, "heal", LAYOUTS["heal"])


def conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", human: str = "user", machine: str = "assistant") -> DataFrame:
    """key, turn, question, answer, place (the image the question names last, from 0), boxes of the answer's tags."""
    w = Window.partitionBy(key).orderBy(turn)
    rows = df.withColumn("_next", F.lead(speaker).over(w)).withColumn("answer", F.lead(text).over(w)).where((F.col(speaker) == human) & (F.col("_next") == machine))
    return rows.select(key, turn, F.col(text).alias("question"), "answer", last_ordinal(F.col(text)).alias("place"), parse_tags(F.col("answer"))["boxes"].alias("boxes"))
