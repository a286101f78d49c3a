"""Queries over ``documents``: leaked test items (p7), mixing sources (p8), one look (p9)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_category
from ..tables import table
from .leakage import leak_report, leaks
from .lookalike import look_classes, same_look_pairs
from .mixing import Mix


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "bench_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).sample()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any mix, as rows: documents taken that are not in the table or have another source, copies above the
    cap, sources with enough tokens that miss their plan by more than a document or pass it, rows of the report."""
    mix = Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    own = table(spark, d, "documents").select("doc_id", clean_category("source").alias("own"))
    joined = mix.sample().join(own, "doc_id", "left")
    sources = mix.report().where("dimension = 'source'")
    most = mix.docs.groupBy(F.col("source").alias("value")).agg(F.max("n_tokens").alias("most"))
    sources = sources.join(most, "value", "left")
    off = (F.col("planned_tokens") - F.col("tokens") > F.col("most")) | (F.col("tokens") > F.col("planned_tokens") + 1)
    one = lambda df, name, value: df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
    return (
        one(joined, "other_sources", F.sum((~F.col("own").eqNullSafe(F.col("source"))).cast("long"))).unionByName(one(sources, "above_cap", F.sum((F.col("most_copies") > F.col("max_repeats")).cast("long"))))
        .unionByName(one(sources.where("not limited"), "off_by_a_document", F.sum(off.cast("long")))).unionByName(one(sources, "sources", F.count("*")))
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return same_look_pairs(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of equal forms, without the forms themselves."""
    return look_classes(table(spark, d, "documents")).drop("form")


QUERIES = {f.__name__: f for f in (p7_found, p7_leaks, p7_report, p8_sample, p8_report, p8_checks, p9_found, p9_forms, p9_classes)}

# Fixed values, written apart from the library's table: signs drawn alike, by the sign they count as.
_PAIRS = (
    ("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX"), ("аеѕіјорсухһԁԛԝӏ", "aesijopcyxhdqwl"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp"), ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),
    ("ɡμ‐‑﹣−∶", "gµ----:"), ("".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F)))),
    ("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " " * 16),
)
_MATH = "".join(c for c in map(chr, range(0x1D400, 0x1D800)) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c)
_FROM = "".join(a for a, _ in _PAIRS) + _MATH
_TO = "".join(b for _, b in _PAIRS) + unicodedata.normalize("NFKC", _MATH)
_TO = _TO.translate(str.maketrans("".join(a for a, _ in _PAIRS[:5]), "".join(b for _, b in _PAIRS[:5])))
_HIDDEN = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]))


def sql_fold(col: str) -> str:
    """DuckDB: the look of a text by table (translate drops what has no partner)."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return f"nfc_normalize(translate(nfc_normalize({col}), {quoted(_FROM + _HIDDEN)}, {quoted(_TO)}))"


def _words(col: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower({sql_fold(col)}), '[ßẞ]', 'ss', 'g'), '[\\p{{L}}\\p{{Nd}}]+')"


_HELD = "(SELECT * FROM bench_items WHERE lower(trim(split, ' ' || chr(9) || '.')) IN ('val', 'valid', 'test'))"
_RUN = "SELECT {0}, i, w[i:i + 11] AS run, len(w) AS n FROM (SELECT {0}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {0}, {1} AS w FROM {2}))"
_LEAKS = f"""d AS ({_RUN.format("doc_id", _words("text"), "documents")}), t AS ({_RUN.format("item_id", _words("item_text"), _HELD)}),
  m AS (SELECT DISTINCT doc_id, item_id, t.i AS i, d.i - t.i AS shift, t.n AS n FROM d JOIN t USING (run)),
  r AS (SELECT doc_id, item_id, n, min(i) AS start, count(*) + 11 AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS island FROM m) GROUP BY doc_id, item_id, n, shift, island),
  leaks AS (SELECT doc_id, item_id, n AS item_words, max(len) AS longest, count(DISTINCT p) AS matched FROM (SELECT *, unnest(range(start, start + len)) AS p FROM r) GROUP BY ALL)"""
_NEAR = f"""dw AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, {_words("text")} AS w FROM documents)), tw AS (SELECT DISTINCT item_id, unnest({_words("item_text")}) AS term FROM {_HELD}),
  df AS (SELECT term, count(*) AS c FROM dw GROUP BY term), rare AS (SELECT item_id, term FROM tw JOIN df USING (term) WHERE c <= greatest((SELECT count(DISTINCT doc_id) FROM dw) * 10 / 1000.0, 1)),
  hit AS (SELECT doc_id, item_id, term, place FROM dw JOIN rare USING (term)),
  near AS (SELECT doc_id, item_id FROM (SELECT b.doc_id, b.item_id, b.place, count(DISTINCT a.term) AS c FROM hit b JOIN hit a ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.place BETWEEN b.place - 39 AND b.place GROUP BY ALL) WHERE c >= 4 GROUP BY ALL)"""
ORACLE = {
    "p7_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p7_leaks": f"WITH {_LEAKS} SELECT doc_id, item_id, longest, matched, item_words FROM leaks",
    "p7_report": f"""WITH {_LEAKS}, {_NEAR} SELECT item_id, any_value(CASE WHEN lower(trim(split, ' ' || chr(9) || '.')) = 'valid' THEN 'val' ELSE lower(trim(split, ' ' || chr(9) || '.')) END) AS split, any_value(b.lang) AS lang,
      count(l.doc_id) AS phrase_docs, count(l.doc_id) FILTER (matched = item_words) AS whole_docs, coalesce(max(longest), 0) AS longest,
      (SELECT count(*) FROM near WHERE near.item_id = b.item_id AND NOT EXISTS (SELECT 1 FROM leaks x WHERE x.doc_id = near.doc_id AND x.item_id = near.item_id)) AS proximity_docs
      FROM {_HELD} b LEFT JOIN leaks l USING (item_id) GROUP BY item_id""",
    "p8_checks": "SELECT unnest(['other_sources', 'above_cap', 'off_by_a_document']) AS name, 0::BIGINT AS value UNION ALL SELECT 'sources', count(*) FROM mix_targets",
    "p9_found": f"""WITH f AS (SELECT doc_id, text, {sql_fold("text")} AS look FROM documents WHERE text <> '')
      SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p9_classes": f"""SELECT doc_id, CASE WHEN text <> '' THEN min(doc_id) OVER w END AS class_id, CASE WHEN text <> '' THEN spellings END AS spellings, CASE WHEN text <> '' THEN count(*) OVER w END AS members
      FROM (SELECT doc_id, text, {sql_fold("text")} AS look FROM documents) LEFT JOIN (SELECT {sql_fold("text")} AS look, count(DISTINCT text) AS spellings FROM documents WHERE text <> '' GROUP BY 1) USING (look) WINDOW w AS (PARTITION BY look, text <> '')""",
}
