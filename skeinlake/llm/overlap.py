"""Same or nearly the same records across splits: an exact prefix-filter join of evaluation against training records.

A 256-bit hash is cut into 18 places of 14 or 15 bits, which stand in four groups; its shingles are the pairs of places of one
group with their bits (32 shingles of 28 to 30 bits). Hashes within 12 bits differ in at most 12 places; of the six that
agree two pairs at least fall into one group, so they share two shingles. With the shingles of every hash in one order,
rarest first, two such hashes share one among their first 31. Evaluation prefixes are indexed by shingle, training prefixes
probe them; a pair survives the length filter (set bits differ by at most the distance) and the exact distance, inside the
join, and comes out only at the first of the shingles it shares, so no pair is made twice. All hashes have equally many
shingles, so a position filter could drop nothing that the prefix keeps; the places serve the rule of the first shingle.
Shingles of more bits keep the candidates near the number of hashes; ``Shingles`` takes other numbers of places and groups
(fewer places: wider shingles, more of them). The result has every pair: no candidate is capped.

Defined results
- digests in other case, with ``0x`` or ``sha256:`` in front or blanks around are the same; what is no 256-bit hex is null
- null digest: compared by the other one only; both null: no pair; empty files (0 bytes) take no part
- a record shown by both sides can pair with records of either; a record never pairs with itself; repeated rows add nothing
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import bits64, clean_digest, clean_split
from ..operators.skew import hot_keys, salted_pairs
from ..session import Workspace

WORDS = ["w0", "w1", "w2", "w3"]
BITS = 256


class Shingles:
    """Pairs of places of a hash. ``places``: number of pieces a hash is cut into; ``groups``: only places of one group pair."""

    def __init__(self, distance: int = 12, places: int = 18, groups: int = 4):
        left = places - distance  # places on which two near hashes agree at least
        cuts = [BITS * i // places for i in range(places + 1)]
        self.pieces = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(places)]
        self.pairs = [p for g in range(groups) for p in combinations(range(g, places, groups), 2)]
        low, more = divmod(max(left, 0), groups)  # spread as evenly as can be they make the fewest pairs
        self.shared = more * (low + 1) * low // 2 + (groups - more) * low * (low - 1) // 2
        if self.shared < 1 or len(self.pairs) > 63 or max(n for _, n in self.pieces) > 28:
            raise ValueError("these places and groups do not make sure that near hashes share a shingle")
        self.prefix = len(self.pairs) - self.shared + 1

    def piece(self, i: int, word=F.col) -> Column:
        """The bits of a place as a number; ``word`` gives a 64-bit word of the hash by its name."""
        start, n = self.pieces[i]
        k, at = divmod(start, 64)
        mask = (1 << n) - 1
        if at + n <= 64:
            return F.shiftrightunsigned(word(WORDS[k]), 64 - at - n).bitwiseAND(mask)
        over = at + n - 64
        return F.shiftleft(word(WORDS[k]), over).bitwiseOR(F.shiftrightunsigned(word(WORDS[k + 1]), 64 - over)).bitwiseAND(mask)

    def shingle(self, k: int) -> Column:
        """The k-th shingle: its number above the bits of its two places."""
        a, b = self.pairs[k]
        n = self.pieces[b][1]
        return F.lit(k << 56).bitwiseOR(F.shiftleft(self.piece(a), n)).bitwiseOR(self.piece(b))

    def shared_before(self, k: Column, kept: Column, differ) -> Column:
        """Whether two hashes share a shingle below number ``k`` that both keep; ``differ`` gives a word of their difference."""
        same = [self.piece(i, differ) == 0 for i in range(len(self.pieces))]
        mask = F.lit(0).cast("long")
        for j, (a, b) in enumerate(self.pairs):
            mask = mask.bitwiseOR(F.when(same[a] & same[b], F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
        below = F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1
        return mask.bitwiseAND(kept).bitwiseAND(below) != 0


def shown_sides(tasks: DataFrame) -> DataFrame:
    """Per image path: whether a training row and whether an evaluation row shows it."""
    split = clean_split("split")
    rows = tasks.select(split.alias("s"), F.explode(F.array_distinct("images.image")).alias("source_path")).where("source_path is not null and s is not null")
    return rows.groupBy("source_path").agg(F.max(F.col("s") == "train").alias("in_train"), F.max(F.col("s").isin("val", "test")).alias("in_eval"), F.max(F.col("s") == "val").alias("in_val"), F.max(F.col("s") == "test").alias("in_test"))


def records_with_sides(records: DataFrame, tasks: DataFrame) -> DataFrame:
    clean = records.where("file_bytes is null or file_bytes <> 0").select("rec_id", "source", "source_path", clean_digest("sha256").alias("sha"), clean_digest("a_hash").alias("hash"))
    return clean.join(shown_sides(tasks), "source_path").where("in_train or in_eval").distinct()


def _frequent(sided: DataFrame, shape: Shingles, parts: int = 64) -> list[set]:
    """Of every place, the bits more than one of ``parts`` hashes have there (at most that many values a place), counted over all hashes."""
    n = len(shape.pieces)
    seen = sided.select(F.explode(F.array(*[F.lit(i << 32).cast("long").bitwiseOR(shape.piece(i)) for i in range(n)])).alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    total = sided.count()
    hot = [r[0] for r in seen.where(F.col("c") * parts > total).where("c > 1").select("v").collect()]
    return [{v & 0xFFFFFFFF for v in hot if v >> 32 == i} for i in range(n)]


def hash_prefixes(sided: DataFrame, shape: Shingles) -> DataFrame:
    """The rarest ``prefix`` shingles of every hash, a row each: words, sides, ``gram``, ``k`` its number, ``kept`` those kept.

    A shingle is as rare as the rarer of its places; those of two frequent places come last, ties by number. The order
    depends on the shingle alone, so it is one order for all hashes.
    """
    often = _frequent(sided, shape)
    is_often = [shape.piece(i).isin(sorted(often[i])) if often[i] else F.lit(False) for i in range(len(shape.pieces))]
    both = [is_often[a] & is_often[b] for a, b in shape.pairs]
    n, drop = len(both), len(both) - shape.prefix
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    if drop == 1:  # the last in the order: the highest number among the frequent ones, if any
        dropped = bit(F.coalesce(F.greatest(*[F.when(c, F.lit(k)) for k, c in enumerate(both)]), F.lit(n - 1)))
    else:
        last = F.slice(F.array_sort(F.array(*[F.struct((-c.cast("int")).alias("o"), F.lit(-k).alias("k")) for k, c in enumerate(both)])), 1, drop) if drop else F.array().cast("array<struct<o:int,k:int>>")
        dropped = F.aggregate(last, F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(bit(-s["k"])))
    frequent = F.lit(0).cast("long")
    for k, c in enumerate(both):
        frequent = frequent.bitwiseOR(F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    rows = sided.select(*WORDS, "t", "e", F.bitwise_not(dropped).alias("kept"), frequent.alias("frequent"), F.posexplode(F.array(*[shape.shingle(k) for k in range(n)])).alias("k", "gram"))
    return rows.where(F.col("kept").bitwiseAND(bit(F.col("k"))) != 0).withColumn("often", (F.col("frequent").bitwiseAND(bit(F.col("k"))) != 0).cast("int")).drop("frequent")


def near_hashes(probe: DataFrame, index: DataFrame, distance: int = 12, shape: Shingles | None = None) -> DataFrame:
    """Pairs of a probe and an index hash (``hash_t``, ``hash_e``, ``bits``) within ``distance``, from distinct hashes."""
    shape = shape or Shingles(distance)
    work = Workspace(probe.sparkSession, "hashes")
    sided = probe.select("hash", F.lit(True).alias("t"), F.lit(False).alias("e")).unionByName(index.select("hash", F.lit(False).alias("t"), F.lit(True).alias("e")))
    sided = sided.where("hash is not null").groupBy("hash").agg(F.max("t").alias("t"), F.max("e").alias("e"))
    sided = work.save(sided.select(*[bits64(F.col("hash"), i).alias(w) for i, w in enumerate(WORDS)], "t", "e"), "sided")
    prefixes = work.save(hash_prefixes(sided, shape), "prefixes")
    left = prefixes.where("t").select("gram", "k", F.col("kept").alias("kept_t"), *[F.col(w).alias(f"{w}t") for w in WORDS])
    right = prefixes.where("e").select("gram", F.col("kept").alias("kept_e"), *[F.col(w).alias(f"{w}e") for w in WORDS])
    ones = lambda s: sum((F.bit_count(f"{w}{s}") for w in WORDS[1:]), F.bit_count(f"w0{s}"))
    differ = lambda w: F.col(f"{w}t").bitwiseXOR(F.col(f"{w}e"))
    apart = sum((F.bit_count(differ(w)) for w in WORDS[1:]), F.bit_count(differ("w0")))
    first = ~shape.shared_before(F.col("k"), F.col("kept_t").bitwiseAND(F.col("kept_e")), differ)
    on = (F.abs(ones("t") - ones("e")) <= distance) & (apart <= distance)
    # only a shingle of two frequent places can be hot; no more than 64 times the number of shingles are
    counts = prefixes.where("t and often = 1").groupBy("gram").agg(F.count("*").alias("c"))
    hot = [r[0] for r in counts.where(F.col("c") * 64 > sided.count()).where("c > 1000").select("gram").collect()]
    pairs = left.join(right, "gram") if not hot else _split(left, right, hot)
    text = lambda s: F.concat(*[F.lpad(F.lower(F.hex(f"{w}{s}")), 16, "0") for w in WORDS])
    return pairs.where(on).where(first).select(text("t").alias("hash_t"), text("e").alias("hash_e"), apart.alias("bits"))


def _split(left: DataFrame, right: DataFrame, hot: list, key: str = "gram") -> DataFrame:
    """All pairs of equal key; hot keys (known by a count) are salted, all others shuffled once."""
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(salted_pairs(left.where(is_hot), right.where(is_hot), key, salts=32))


def _pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    hot = hot_keys(left, key)
    return left.join(right, key) if not hot else _split(left, right, hot, key)


def cross_split_pairs(records: DataFrame, tasks: DataFrame, distance: int = 12) -> DataFrame:
    """Pairs of records, one shown by training and one by evaluation rows: ``rec_t``, ``rec_e``, ``how``, ``bits``."""
    work = Workspace(records.sparkSession, "overlap")
    sided = work.save(records_with_sides(records, tasks), "sided")
    train = sided.where("in_train").select(F.col("rec_id").alias("rec_t"), F.col("sha"), F.col("hash").alias("hash_t"))
    held = sided.where("in_eval").select(F.col("rec_id").alias("rec_e"), F.col("sha"), F.col("hash").alias("hash_e"))
    exact = _pairs(train.where("sha is not null").select("sha", "rec_t"), held.where("sha is not null").select("sha", "rec_e"), "sha").select("rec_t", "rec_e", F.lit("sha256").alias("how"), F.lit(0).alias("bits"))
    hashes = near_hashes(sided.where("in_train").select("hash"), sided.where("in_eval").select("hash"), distance)
    at_train = _pairs(train.where("hash_t is not null").select("hash_t", "rec_t"), hashes, "hash_t").select("hash_e", "rec_t", "bits")
    near = _pairs(held.where("hash_e is not null").select("hash_e", "rec_e"), at_train, "hash_e").select("rec_t", "rec_e", F.lit("a_hash").alias("how"), "bits")
    return exact.unionByName(near).where("rec_t <> rec_e")


def overlap_classes(records: DataFrame, tasks: DataFrame, distance: int = 12) -> DataFrame:
    """One row per evaluation record with an overlap: its splits and source, its class (its hash, else its file digest), its
    links, counted between distinct hashes and as copies, and one training record it overlaps (the least or greatest of
    its copies, never itself). No pairs of copies are listed and no link between different hashes or files is lost."""
    work = Workspace(records.sparkSession, "classes")
    sided = work.save(records_with_sides(records, tasks), "sided")
    train = sided.where("in_train")
    per_sha = train.where("sha is not null").groupBy("sha").agg(F.count("*").alias("same_file"), F.min("rec_id").alias("file_least"), F.max("rec_id").alias("file_most"))
    per_hash = train.where("hash is not null").groupBy(F.col("hash").alias("hash_t")).agg(F.count("*").alias("n"), F.min("rec_id").alias("a"), F.max("rec_id").alias("b"))
    links = near_hashes(train.select("hash"), sided.where("in_eval").select("hash"), distance).join(per_hash, "hash_t")
    links = links.groupBy(F.col("hash_e").alias("hash")).agg(F.count("*").alias("near_hashes"), F.sum("n").alias("near_records"), F.min("bits").alias("least_bits"), F.min("a").alias("near_least"), F.max("b").alias("near_most"))
    held = sided.where("in_eval").join(per_sha, "sha", "left").join(links, "hash", "left")
    own = F.when(F.col("in_train"), F.lit(1)).otherwise(F.lit(0))
    other = lambda c: F.when(F.col(c) != F.col("rec_id"), F.col(c))
    out = held.select(
        "rec_id", "source", "in_val", "in_test", F.coalesce("hash", F.concat(F.lit("file:"), "sha")).alias("class_id"), (F.coalesce("same_file", F.lit(0)) - F.when(F.col("sha").isNotNull(), own).otherwise(0)).alias("same_file"),
        F.coalesce("near_hashes", F.lit(0)).alias("near_hashes"), (F.coalesce("near_records", F.lit(0)) - F.when(F.col("hash").isNotNull(), own).otherwise(0)).alias("near_records"),
        F.coalesce(*map(other, ("file_least", "file_most", "near_least", "near_most"))).alias("train_rec"),
    )
    return out.where("same_file > 0 or near_records > 0")


def overlap_report(records: DataFrame, tasks: DataFrame, distance: int = 12) -> DataFrame:
    """Per evaluation split and source: records shown, records with an equal file, records with a near image in training."""
    found = overlap_classes(records, tasks, distance)
    rows = found.select(F.explode(F.array_compact(F.array(F.when(F.col("in_val"), F.lit("val")), F.when(F.col("in_test"), F.lit("test"))))).alias("split"), "source", "same_file", "near_records")
    return rows.groupBy("split", "source").agg(F.count("*").alias("records"), F.sum((F.col("same_file") > 0).cast("long")).alias("with_same_file"), F.sum((F.col("near_records") > 0).cast("long")).alias("with_near_image"))
