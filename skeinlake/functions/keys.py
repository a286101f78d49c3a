"""One spelling for identifiers, categories and digests (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u00a0"


def clean_key(col: Column | str) -> Column:
    """Identifier in lower case without blanks at its ends; null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(col, F.lit(BLANKS)))


def clean_category(col: Column | str) -> Column:
    """Category in lower case, ends and a final full stop cut, blank/hyphen/underscore runs as one ``_``.

    Null and blank values come out as null.
    """
    col = F.col(col) if isinstance(col, str) else col
    plain = col.rlike("^[a-z0-9]+(_[a-z0-9]+)*$")  # most values need no rewriting
    cut = F.regexp_replace(F.lower(col), r"^[\s\u00a0]+|[\s\u00a0]*\.?[\s\u00a0]*$", "")
    return F.when(plain, col).otherwise(F.nullif(F.regexp_replace(cut, r"[\s\u00a0_-]+", "_"), F.lit("")))


def clean_split(col: Column | str) -> Column:
    """``clean_category`` with ``valid`` as another name of ``val``."""
    c = clean_category(col)
    return F.when(c == "valid", F.lit("val")).otherwise(c)


def clean_digest(col: Column | str) -> Column:
    """256-bit hex digest in lower case without ``0x``/``sha256:`` mark; anything else is null."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(F.btrim(col, F.lit(BLANKS))), r"^(0x|sha256[:=-])|[\s:]", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def bits64(hex_col: Column, word: int) -> Column:
    """The ``word``-th 64-bit word (0 = leftmost) of a 64-digit hex digest as a signed long."""
    half = lambda k: F.conv(F.substring(hex_col, 1 + 16 * word + 8 * k, 8), 16, 10).cast("long")
    return F.shiftleft(half(0), 32).bitwiseOR(half(1))


def hash_unit(seed: str, *cols: Column | str) -> Column:
    """Uniform number in [0, 1) from sha256 of ``seed:col:...``; same on every run and layout (52 bits)."""
    return hash_bits(seed, *cols, digits=13) / F.lit(float(2**52))


def hash_bits(seed: str, *cols: Column | str, digits: int = 15) -> Column:
    """The first ``digits`` hex digits of sha256 of ``seed:col:...`` as a non-negative long."""
    text = F.concat_ws(":", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long")
