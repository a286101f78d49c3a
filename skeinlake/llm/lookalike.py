"""One consistent form of texts that look the same but are stored with different characters.

Tokens (stretches without blanks) that hold a look-alike, an ignorable or a sign that composes are counted over all
documents, and with them the plain tokens that have one of their looks; no other token can be their canonical spelling. They
are matched against tries of the well-formed ones by a weighted edit automaton in which look-alikes and ignorables cost
nothing and every other edit costs more than the budget, which is 0 where only equal looks may meet. The canonical spelling
is the matched one: the spelling the table folds to if the vocabulary has it, else the most frequent well-formed one (a word
written wholly in one script keeps it). Tokens that match nothing take the form of the table. All spellings of one look
share a trie (they are sharded by the hash of their look, into shards of a given number of tokens, so a trie does not grow
with the corpus) and see the same choices: equal looks get equal forms.

Defined results
- null text: null form; empty text: empty form; a text that is nothing but ignorables: an empty form
- blanks of any kind become the plain blank, one for one; line breaks and tabs stay, case, accents and digits stay
- repeated rows each keep their row; extra columns stay; an empty table gives an empty one with the added column
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_split_join, salted_pairs
from ..session import Workspace
from .looks import BLANKS, _bases, alike, fold, fold_text, plain_signs, script, suspect

#: Tokens with odd signs to a shard, and so to a trie.
SHARD_TOKENS = 2_000
_TOKEN = f"[^\\s{BLANKS}]+"


class Trie:
    """A trie kept as a sorted list of decomposed words: a node is the interval of words that share their first signs."""

    def __init__(self, counts: dict[str, int]):
        named = sorted((unicodedata.normalize("NFD", w), w) for w in counts)
        self.keys, self.words, self.counts = [k for k, _ in named], [w for _, w in named], counts

    def child(self, lo: int, hi: int, depth: int, sign: str) -> tuple[int, int]:
        """The part of a node whose words go on with ``sign`` at ``depth``."""
        at = lambda k: k[depth : depth + 1]
        return bisect_left(self.keys, sign, lo, hi, key=at), bisect_right(self.keys, sign, lo, hi, key=at)

    def search(self, token: str, budget: int = 0, substitute: int = 1, skip: int = 1) -> dict[str, int]:
        """Words within ``budget`` of the token, with their cost. Look-alikes and ignorables are free."""
        same = alike()
        states = {(0, len(self.keys), 0): 0}
        for c in plain_signs(token):
            near, after = same.get(c, c), {}

            def reach(lo: int, hi: int, depth: int, cost: int, after: dict = after) -> None:
                if lo < hi and cost <= min(budget, after.get((lo, hi, depth), budget)):
                    after[lo, hi, depth] = cost

            for (lo, hi, depth), cost in states.items():
                if hi - lo == 1:  # a single word left: no search for its next sign
                    if self.keys[lo][depth : depth + 1] in near and len(self.keys[lo]) > depth:
                        reach(lo, hi, depth + 1, cost)
                else:
                    for a in near:
                        reach(*self.child(lo, hi, depth, a), depth + 1, cost)
                if cost + skip <= budget:
                    reach(lo, hi, depth, cost + skip)
                if cost + substitute <= budget:
                    at = lo
                    while at < hi:
                        a = self.keys[at][depth : depth + 1]
                        start, end = self.child(at, hi, depth, a)
                        if a and a not in near:
                            reach(start, end, depth + 1, cost + substitute)
                        at = max(end, at + 1)
            states = after
        return {self.words[lo]: cost for (lo, hi, depth), cost in states.items() if lo < hi and len(self.keys[lo]) == depth}


def well_formed(token: str) -> bool:
    """Fit to be a canonical spelling: composed, no ignorables, no width or font forms, letters of one script."""
    table = _bases()
    return token == unicodedata.normalize("NFC", token) and script(token) != "mixed" and all(table.get(c, c) == c or unicodedata.name(c, "").startswith(("CYRILLIC ", "GREEK ")) for c in token)


def canonical(token: str, trie: Trie) -> tuple[str, bool]:
    """The spelling chosen for a token, and whether the vocabulary had one."""
    look = fold(token)
    found = trie.search(token)
    if not found or look in found:
        return look, bool(found)
    return min(found, key=lambda w: (-trie.counts[w], w)), True


def _match(clean: pd.DataFrame, dirty: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(clean["token"], clean["n"]))
    counts |= {t: n for t, n in zip(dirty["token"], dirty["n"]) if well_formed(t)}
    trie = Trie(counts)
    rows = [(t, *canonical(t, trie)) for t in dirty["token"]]
    return pd.DataFrame(rows, columns=["token", "form", "matched"])


def spellings(docs: DataFrame, text: str = "text", per_shard: int = SHARD_TOKENS) -> DataFrame:
    """Of every token that may have to change: ``token``, ``form``, ``matched``. Counts come from all documents."""
    work, t = Workspace(docs.sparkSession, "tokens"), F.col(text)
    odd = F.explode(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)))
    dirty = docs.where(suspect(t)).select(odd.alias("token")).where(suspect(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))
    dirty = work.save(dirty.withColumn("look", fold_text(F.col("token"))), "dirty")
    shards = -(-dirty.count() // per_shard) or 1
    # a text without odd signs has ASCII blanks only, which one quick split finds
    plain = F.when(suspect(t), F.filter(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)), lambda x: ~suspect(x))).otherwise(F.split(t, r"\s+"))
    clean = docs.select(F.explode(plain).alias("look")).where("look <> ''").groupBy("look").agg(F.count("*").alias("n"))
    clean = clean.join(dirty.select("look").distinct(), "look", "left_semi").select("look", F.col("look").alias("token"), "n")
    shard = F.pmod(F.xxhash64("look"), F.lit(shards)).cast("int").alias("shard")
    return (
        clean.select(shard, "token", "n").groupBy("shard").cogroup(dirty.select(shard, "token", "n").groupBy("shard"))
        .applyInPandas(_match, "token string, form string, matched boolean")
    )


def normalize_looks(docs: DataFrame, text: str = "text", into: str = "form", forms: DataFrame | None = None) -> DataFrame:
    """``docs`` with the consistent form of ``text`` in the added column ``into``.

    Only texts with a token that may change are taken apart; their tokens meet the spellings by a join on the token.
    """
    work = Workspace(docs.sparkSession, "looks")
    forms = work.save(spellings(docs, text) if forms is None else forms, "forms")
    marked = docs.withColumn("_dirty", F.coalesce(suspect(F.col(text)), F.lit(False)))
    clean = marked.where("not _dirty").drop("_dirty").withColumn(into, F.col(text))
    piece = f"[{BLANKS}]|\\s+|{_TOKEN}"
    odd = work.save(marked.where("_dirty").drop("_dirty").withColumn("_row", F.expr("uuid()")).withColumn("_pieces", F.regexp_extract_all(F.col(text), F.lit(piece), F.lit(0))), "odd")
    found = odd.select("_row", F.posexplode("_pieces").alias("_at", "token")).where(suspect(F.col("token")))
    blank = F.col("token").rlike(f"^[{BLANKS}]$")
    joined = hot_split_join(found.where(~blank), forms.select("token", F.col("form").alias("_to")), "token", "left")
    changed = joined.select("_row", "_at", F.coalesce("_to", "token").alias("_to"))
    per_row = changed.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_to"))).alias("_map"))
    whole = odd.join(per_row, "_row", "left").withColumn(
        into,
        F.array_join(F.transform("_pieces", lambda p, i: F.when(p.rlike(f"^[{BLANKS}]$"), F.lit(" ")).otherwise(F.coalesce(F.try_element_at("_map", i), p))), ""),
    )
    return clean.unionByName(whole.drop("_row", "_pieces", "_map"))


def same_look_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (``doc_a`` < ``doc_b``) of non-empty texts stored differently whose consistent forms are equal."""
    formed = normalize_looks(docs.select(key, text).where((F.col(text) != "") & F.col(key).isNotNull()), text)
    seen = Workspace(docs.sparkSession, "same").save(formed.select(F.col(key).alias("doc"), F.md5(text).alias("raw"), F.md5("form").alias("look")), "seen")
    several = seen.groupBy("look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("look")
    of = Workspace(docs.sparkSession, "several").save(seen.join(several, "look", "left_semi"), "of")
    right = of.select("look", F.col("doc").alias("doc_b"), F.col("raw").alias("raw_b"))
    return salted_pairs(of.withColumnRenamed("doc", "doc_a"), right, "look", (F.col("doc_a") < F.col("doc_b")) & (F.col("raw") != F.col("raw_b"))).select("doc_a", "doc_b")


def look_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its form, the least id that shares the look, the number of stored spellings of that look."""
    formed = normalize_looks(docs.select(key, text), text).withColumn("look", F.md5("form"))
    size = formed.where(F.col(text) != "").groupBy("look").agg(F.min(key).alias("class_id"), F.countDistinct(text).alias("spellings"), F.count("*").alias("members"))
    return formed.join(size, "look", "left").select(key, "form", "class_id", "spellings", "members")
