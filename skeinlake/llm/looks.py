"""The look of signs: which stored characters are drawn alike, and text folded to one of them (by table)."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and signs that are drawn like the one below or right of them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏ", "ABESIJKMHOPCTYXaesijopcyxhdqwl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp")
ROMAN = ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm")
SIGNS = ("ɡμ‐‑﹣−∶", "gµ----:")
LIGATURES = ("ﬀﬁﬂﬃﬄﬅﬆ", ("ff", "fi", "fl", "ffi", "ffl", "st", "st"))
# Stretches of signs that are not drawn (Unicode's default ignorable code points).
IGNORED_SPANS = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Ignorables of the basic plane; those beyond it are rare and left to the slower way.
IGNORABLE = "".join(chr(c) for a, b in IGNORED_SPANS if b < 0x10000 for c in range(a, b + 1))
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@cache
def _bases() -> dict[str, str]:
    """Single characters, decomposed, to the sign they look like; width and font forms by Unicode's own rule."""
    out: dict[str, str] = {c: " " for c in BLANKS}
    for start, end in ((0xFF01, 0xFFEF), (0x1D400, 0x1D800), (0x2102, 0x2140)):
        for c in map(chr, range(start, end)):
            kind, _, code = unicodedata.decomposition(c).partition(" ")
            if kind in ("<wide>", "<narrow>", "<font>") and " " not in code:
                out[c] = chr(int(code, 16))
    for a, b in (CYRILLIC, GREEK, ROMAN, SIGNS, LIGATURES):
        out |= dict(zip(a, b, strict=True))
    out |= {c: "" for c in IGNORABLE}
    return {a: out.get(b, b) for a, b in out.items() if a != out.get(b, b)}


@cache
def _python_table() -> dict[int, str]:
    hidden = {c: "" for a, b in IGNORED_SPANS for c in range(a, b + 1)}
    return {ord(a): b for a, b in _bases().items()} | hidden


def fold(text: str) -> str:
    """Text as its signs look: decomposed, so that a mark does not hide its letter, by table, composed again."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_python_table()))


@cache
def _composed_letters() -> tuple[dict[str, str], tuple[int, ...]]:
    """Letters with marks on a base that looks like another letter: those whose look is one sign, and all others."""
    single, more = {}, []
    for c in map(chr, [*range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        if len(unicodedata.normalize("NFD", c)) > 1 and (to := fold(c)) != unicodedata.normalize("NFC", c):
            if len(to) == 1:
                single[c] = to
            else:
                more.append(ord(c))
    return single, tuple(more)


@cache
def look_table() -> dict[str, str]:
    """Single characters to the one sign they look like, ignorables to nothing: what a plain translation can do."""
    return {a: b for a, b in _bases().items() if len(b) < 2} | _composed_letters()[0]


#: Regex of texts without a character that folding may change: ASCII and composed Latin. Narrow on purpose, as a class of
#: few ranges is quick; what is outside it but not in the table passes through unchanged.
PLAIN = r"\A[\x00-\x7f\u00a1-\u00ac\u00ae-\u017f]*+\z"


@cache
def composed_class() -> str:
    """Regex class of characters a plain translation cannot fold: marks, jamo, the stretches NFC rewrites alone, letters whose
    look is several signs, ligatures and what lies beyond the basic plane's ignorables."""
    odd = {c for c in range(0x340, 0x2FA20) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)}
    to_marks = {ord(a) for a, b in _bases().items() if b and unicodedata.combining(b[0])}
    spans: list[list[int]] = []
    for c in sorted(odd | to_marks | set(_composed_letters()[1]) | set(map(ord, LIGATURES[0])) | set(range(0x1BCA0, 0x1BCA4)) | set(range(0x1D173, 0x1D17B))):
        if spans and c - spans[-1][1] < 0x40:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return r"[\p{M}\x{1100}-\x{11ff}\x{e0000}-\x{e0fff}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


@cache
def alike() -> dict[str, str]:
    """Of each sign, all characters drawn like it (itself first)."""
    out: dict[str, str] = {}
    one = {a: b for a, b in _bases().items() if len(b) == 1}
    for a, b in one.items():
        out[b] = out.get(b, b) + a
    return out | {a: out[b] for a, b in one.items()}


def plain_signs(token: str) -> str:
    """Decomposed, ligatures taken apart, signs that are not drawn left out."""
    return unicodedata.normalize("NFD", token).translate(_undrawn())


@cache
def _undrawn() -> dict[int, str]:
    return {c: b for c, b in _python_table().items() if len(b) != 1}


def suspect(col: Column) -> Column:
    """Whether folding may change the text. Texts of one byte a sign, most of all, need no look at their signs."""
    return (F.octet_length(col) != F.char_length(col)) & ~col.rlike(PLAIN)


@F.pandas_udf(T.StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


def fold_text(col: Column) -> Column:
    """``fold`` over a column: by JVM translation, and in Arrow batches only for texts that need composition.

    Null stays null; an empty text stays empty.
    """
    parts = look_table()
    kept = sorted(parts, key=lambda c: parts[c] == "")  # translate drops what has no partner at the end
    by_table = F.translate(col, "".join(kept), "".join(parts[c] for c in kept))
    composes = suspect(col) & col.rlike(composed_class())
    return F.when(composes, _fold_udf(F.when(composes, col))).when(suspect(col), by_table).otherwise(col)


def words(col: Column) -> Column:
    """The longest stretches of letters and digits, folded, without regard to case (sharp s counts as ss)."""
    low = F.replace(F.lower(fold_text(col)), F.lit("ß"), F.lit("ss"))
    return F.regexp_extract_all(low, F.lit(r"[a-z0-9\p{L}\p{Nd}]+"), F.lit(0))


def script(token: str) -> str:
    """Scripts of a token's letters among Latin, Greek, Cyrillic: one name, '' for none, 'mixed' for several or others."""
    seen = {m[0] if (m := re.match("LATIN|GREEK|CYRILLIC", unicodedata.name(c, ""))) else "OTHER" for c in token if c.isalpha()}
    return next(iter(seen)) if len(seen) == 1 else "mixed" if seen else ""
