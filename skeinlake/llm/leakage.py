"""Evaluation texts inside training text, by a distributed positional inverted index.

Training documents are cut into words once (folded to one look, without case) and written as an index partitioned by
document: a row holds a document's words in order of their places, so the posting list of any term in it is read off the
row. Of every window of consecutive item words the rarest terms (by the number of their postings in the whole corpus) are
searched first: the postings of the rarest one are taken from the index, the lists of the next rarest are intersected with
them at the adjusted offsets, rarest first, and what is left is held against all words of the window. All of that happens
inside the row of a document; only matched windows leave their task. Matched windows of one shift that overlap make a
run. Proximity matches are documents in which several of the item's rare terms stand close to each other.

Defined results
- null or empty text, text without words, items shorter than the run: no match; null ids of documents or items: no match row
- repeated rows of a document or an item count once; rows that share an id but not the text match each by itself, the
  longest run counts, matched words are the union; very long texts are processed whole
- a run that occurs several times: the longest counts; matched words are counted once per item word
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_split
from ..operators.skew import hot_keys, salted_pairs
from ..session import Workspace
from .looks import words

#: Windows of items are sent to every executor up to this many; more are joined by shuffle, with the same result.
BROADCAST_WINDOWS = 100_000
#: Lists intersected at their offsets before a window is compared as a whole.
LISTS = 4


class PositionalIndex:
    """The index of a corpus and the searches of test items in it."""

    def __init__(self, docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", broadcast_windows: int = BROADCAST_WINDOWS):
        self.work, self.broadcast_windows = Workspace(docs.sparkSession, "index"), broadcast_windows
        said = items.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), words(F.col(item_text)).alias("ws")).where(F.size("ws") > 0).distinct()
        self.items = self.work.save(said.withColumn("copy", F.xxhash64(F.array_join("ws", " "))).select("item_id", "copy", F.posexplode("ws").alias("i", "term")), "items")
        forward = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc_id"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
        self.forward = self.work.save(forward, "forward")
        vocabulary = self.items.select("term").distinct()
        counts = self.forward.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        self.frequency = self.work.save(counts.join(vocabulary, "term", "left_semi"), "frequency")
        self.terms = self.work.save(self.items.join(self.frequency, "term", "left").select("item_id", "copy", "i", "term", F.coalesce("df", F.lit(0)).alias("df")), "terms")

    def windows(self, run: int) -> DataFrame:
        """Every window of ``run`` item words that the corpus can hold: its first place, its words, and of its rarest words
        (ties by place) their places in it: ``at0`` the rarest (of the ``LISTS`` first), ``term`` the rarest word itself."""
        w = Window.partitionBy("item_id", "copy").orderBy("i").rowsBetween(0, run - 1)
        ws = self.terms.select("item_id", "i", F.collect_list(F.struct("df", "i", "term")).over(w).alias("w")).where(F.size("w") == run)
        order = ws.withColumn("r", F.array_sort("w")).where(F.get("r", F.lit(0))["df"] > 0)
        k = min(LISTS, run)
        out = order.select("item_id", "i", F.get("r", F.lit(0))["term"].alias("term"), F.transform("w", lambda x: x["term"]).alias("wanted"), *[(F.get("r", F.lit(j))["i"] - F.col("i")).alias(f"at{j}") for j in range(k)])
        return self.work.save(out.distinct(), f"windows{run}")

    def _matches(self, run: int) -> DataFrame:
        """doc_id, version, item_id, start (place of the window in the item), shift: windows that a document holds."""
        windows = self.windows(run)
        k = min(LISTS, run)
        version = F.xxhash64("words").alias("version")
        if windows.count() <= self.broadcast_windows:
            placed = self.forward.select("doc_id", "words", F.posexplode("words").alias("place", "term"))
            hit = placed.join(F.broadcast(windows), "term")
            word, first = lambda at: F.get("words", at), F.col("place") - F.col("at0")
            whole = F.slice("words", first + 1, F.lit(run)) == F.col("wanted")
        else:
            # each posting of a rarest term carries the words around it, so the join needs no document
            rare = windows.select("term").distinct()
            near = lambda x, p: F.transform(F.sequence(p - (run - 1), p + (run - 1)), lambda q: F.when(q >= 0, F.get(x, q)))
            placed = self.forward.select("doc_id", version, "words", F.posexplode("words").alias("place", "term")).join(rare, "term", "left_semi")
            postings = self.work.save(placed.select("doc_id", "version", "place", "term", near(F.col("words"), F.col("place")).alias("near")), f"postings{run}")
            hit = _split_pairs(postings, windows, "term")
            word, first = lambda at: F.get("near", F.lit(run - 1) + at - F.col("place")), F.col("place") - F.col("at0")
            whole = F.slice("near", F.lit(run) - F.col("at0"), F.lit(run)) == F.col("wanted")
        on: Column = first >= 0
        for j in range(1, k):  # the lists of the next rarest words, at their offsets
            on = on & word(first + F.col(f"at{j}")).eqNullSafe(F.get("wanted", F.col(f"at{j}")))
        found = hit.where(on).where(whole)
        return found.select("doc_id", version if "words" in found.columns else "version", "item_id", F.col("i").alias("start"), (first - F.col("i")).alias("shift")).distinct()

    def phrases(self, run: int = 12) -> DataFrame:
        """doc_id, item_id, longest run, item words matched in runs of at least ``run``."""
        found = self._matches(run)
        by_shift = found.groupBy("doc_id", "version", "item_id", "shift").agg(F.array_sort(F.collect_set("start")).alias("starts"))
        # a run goes on while the next window starts one word later
        step = F.aggregate(
            "starts", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("best")),
            lambda a, s: F.struct(s.alias("last"), F.when(s == a["last"] + 1, a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["best"], F.when(s == a["last"] + 1, a["now"] + 1).otherwise(1)).alias("best")),
        )["best"]
        covered = F.array_distinct(F.flatten(F.transform("all", lambda s: F.sequence(s, s + (run - 1)))))
        out = by_shift.select("doc_id", "item_id", (step + (run - 1)).cast("bigint").alias("longest"), "starts").groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.array_distinct(F.flatten(F.collect_set("starts"))).alias("all"))
        return out.select("doc_id", "item_id", "longest", F.size(covered).cast("bigint").alias("matched"))

    def proximity(self, rare_permille: int = 10, least: int = 4, span: int = 40) -> DataFrame:
        """doc_id, item_id, near_terms: at least ``least`` of the item's rare terms within ``span`` words, in any order.

        Rare are all terms of an item with at most ``rare_permille`` postings to 1,000 documents. Places fall into
        half-overlapping stretches of 2 * ``span`` words, so a window of ``span`` lies whole in one of them.
        """
        limit = self.forward.count() * rare_permille / 1000
        rare = self.terms.where((F.col("df") > 0) & (F.col("df") <= max(limit, 1))).select("item_id", "term").distinct()
        wanted = rare.select("term").distinct()
        # few words are rare terms, so the lists are small before they meet the items
        lists = self.forward.select("doc_id", F.posexplode("words").alias("place", "term")).join(wanted, "term", "left_semi")
        lists = self.work.save(lists.distinct(), "rare_lists")
        hits = _split_pairs(lists, rare, "term").select("doc_id", "item_id", "term", "place")
        part = F.floor(F.col("place") / span)
        parts = hits.withColumn("part", F.explode(F.array(part, part - 1)))
        enough = parts.groupBy("doc_id", "item_id", "part").agg(F.count_distinct("term").alias("t")).where(F.col("t") >= least)
        w = Window.partitionBy("doc_id", "item_id", "part").orderBy("place").rangeBetween(-(span - 1), 0)
        inside = parts.join(enough.drop("t"), ["doc_id", "item_id", "part"]).withColumn("near", F.size(F.collect_set("term").over(w)))
        return inside.groupBy("doc_id", "item_id").agg(F.max("near").cast("bigint").alias("near_terms")).where(F.col("near_terms") >= least)

    def lengths(self) -> DataFrame:
        return self.items.groupBy("item_id", "copy").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.max("n").alias("item_words"))


def _split_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All pairs of equal key; the few hot keys of the left side are salted, all others shuffled once."""
    hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(salted_pairs(left.where(is_hot), right.where(is_hot), key))


def held_out(items: DataFrame) -> DataFrame:
    return items.where(clean_split("split").isin("val", "test"))


def leaks(docs: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """doc_id, item_id, longest run, matched words and the item's words: exact phrase matches."""
    index = PositionalIndex(docs.select("doc_id", "text"), held_out(items))
    return index.phrases(run).join(index.lengths(), "item_id")


def leak_report(docs: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """Per held-out item: documents with a phrase of it, wholly or partly, and documents with its rare terms close together."""
    index = PositionalIndex(docs.select("doc_id", "text"), held_out(items))
    phrase = index.work.save(index.phrases(run).join(index.lengths(), "item_id"), "phrases")
    near = index.proximity().join(phrase.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    found = phrase.groupBy("item_id").agg(F.count("*").alias("phrase_docs"), F.sum((F.col("matched") == F.col("item_words")).cast("long")).alias("whole_docs"), F.max("longest").alias("longest"))
    close = near.groupBy("item_id").agg(F.count("*").alias("proximity_docs"))
    every = held_out(items).where("item_id is not null").groupBy("item_id").agg(F.min(clean_split("split")).alias("split"), F.min("lang").alias("lang"))
    return every.join(found, "item_id", "left").join(close, "item_id", "left").na.fill(0, ["phrase_docs", "whole_docs", "longest", "proximity_docs"])
