"""Documents of several sources mixed to target shares of all tokens, by raking weights and calibrated sampling.

Token counts are summed per cell (source, language, topic). Texts are tokenized once; their hashed token counts are written,
a k-means model of topics is trained on those of every document in passes over that table, and a last pass gives each document
its topic. Iterative proportional fitting scales the cells' weights until sources hold their target shares and languages and
topics keep the shares they have in the corpus; no weight passes its source's cap of repeats. A document is taken
floor(weight) times, and once more with the probability of the rest, by exponential race: hashes give every document an order
within its source and documents are taken until the planned tokens are reached. What is then left of a plan, less than one
document, is filled by the largest documents that still fit, so a source with enough documents misses its plan by less than
its smallest free document.

Defined results
- null or blank source, or one without a target: not mixed; null language: ``unknown``; null text: no tokens
- a source that is missing, or too small even at its cap: all it can give, and the report says so
- marginals that the caps or the sources make impossible: raking ends when a round changes nothing more, and the report
  gives what each language and topic reached
- no tokens or no targets: an empty mix; two runs, or two layouts of the same rows, give the same mix
- a document id that occurs twice: each row counts by itself, both rows get the copies of either
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import clean_category, hash_bits, hash_unit
from ..operators.skew import take_lowest
from ..session import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Topic model: clusters, width of the hashed counts, and the unit of its whole-number vectors.
TOPICS, WIDTH, ONE = 8, 512, 2**11
#: Documents packed and multiplied at a time (products this small are not handed to further threads), and those worth a task.
BLOCK, TILE, TASK = 2048, 64, 2**18


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hashed_counts(ids: list[int]) -> np.ndarray:
    """Counts of a text's tokens in ``WIDTH`` cells."""
    return np.bincount(((np.asarray(ids, dtype=np.int64) * 2654435761) & 0xFFFFFFFF) % WIDTH, minlength=WIDTH)


def token_counts(col: Column, path: str = TOKENIZER) -> Column:
    """Struct(n_tokens, cells, counts) of whole texts: the cells a text's tokens fall into, ascending, and the tokens in each,
    packed as 16- and 32-bit numbers."""
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    @F.pandas_udf(schema)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path)
        for texts in batches:
            out = []
            for t in texts:
                counts = hashed_counts(enc.encode_ordinary(t) if t else [])
                cells = np.flatnonzero(counts)
                out.append((int(counts.sum()), cells.astype("<u2").tobytes(), counts[cells].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=schema.names)

    return count(col)


class TopicModel:
    """k-means of tf-idf weighted hashed token counts, trained on every document. The executors hold the documents, packed in
    blocks; the driver holds the centres and the sums of a pass.

    Vectors and centres are whole multiples of 1/``ONE``. Their products and sums stay below 2**24 and are exact, so the same
    documents give the same model in any layout, and the rounds end when centres come back. Starting documents are drawn from
    all, by the squared distance to those before.
    """

    def __init__(self, idf: np.ndarray, centres: np.ndarray):
        self.idf, self.centres = idf, centres

    @classmethod
    def fit(cls, counted: DataFrame, work: Workspace, k: int = TOPICS) -> TopicModel:
        """``counted``: a written table of packed ``cells`` and ``counts`` with a ``hash`` of each document."""
        counted = counted.select("cells", "counts", "hash").where(F.length("cells") > 0)
        n, inside = cls._documents(counted)
        model = cls(np.log((1 + n) / (1 + inside)) + 1, np.zeros((0, WIDTH)))
        if not n:
            return model
        blocks = work.save(counted.mapInArrow(model._pack, "lengths binary, cells binary, parts binary, hashes binary"), "blocks").coalesce(1 + n // TASK)
        while len(model.centres) < min(k, n):
            model.centres = np.vstack([model.centres, model._next_start(blocks)])
        seen = set()
        while model.centres.tobytes() not in seen:  # each round lowers the summed distance, but for rounding
            seen.add(model.centres.tobytes())
            sums = model._sums(blocks)
            model.centres = np.where(sums[:, -1:] > 0, np.rint(sums[:, :-1] / np.maximum(sums[:, -1:], 1)), model.centres)
        work.drop("blocks")
        return model

    @staticmethod
    def _documents(counted: DataFrame) -> tuple[int, np.ndarray]:
        """Number of documents, and of those with tokens in each cell."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(WIDTH + 1, dtype=np.int64)
            for b in batches:
                cells = b.column("cells").to_numpy(zero_copy_only=False)
                total[:WIDTH] += np.bincount(np.frombuffer(b"".join(cells), "<u2"), minlength=WIDTH)
                total[WIDTH] += len(cells)
            yield _numbers(total)

        total = _added(counted.select("cells"), count, WIDTH + 1)
        return int(total[WIDTH]), total[:WIDTH]

    def _pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of up to ``BLOCK`` documents: numbers of cells, cells, vectors' parts there and hashes, end to end."""
        for b in batches:
            cells, counts, hashes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cells", "counts", "hash"))
            for at, lengths, where, parts in self._parts(cells, counts):
                row = [lengths.astype("<u2"), where.astype("<u2"), parts.astype("<u2"), hashes[at].astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], names=["lengths", "cells", "parts", "hashes"])

    def _parts(self, cells: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Place, lengths, cells and parts of the vectors of up to ``BLOCK`` documents at a time."""
        for i in range(0, len(cells), BLOCK):
            at = slice(i, min(i + BLOCK, len(cells)))
            lengths = np.fromiter(map(len, cells[at]), np.int64, at.stop - i) // 2
            where = np.frombuffer(b"".join(cells[at]), "<u2")
            v = np.log1p(np.frombuffer(b"".join(counts[at]), "<u4").astype(float)) * self.idf[where]
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(lengths)), lengths), v * v, minlength=len(lengths)))
            yield at, lengths, where, np.rint(v * ONE / np.repeat(norm, lengths))

    def _next_start(self, blocks: DataFrame) -> np.ndarray:
        """Vector of one document of all, drawn with the squared distance to the nearest centre by an exponential race."""
        step = np.uint64((len(self.centres) + 1) * 0x9E3779B97F4A7C15 % 2**64)

        def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for lengths, cells, parts, hashes in _unpacked(batches):
                x = _spread(lengths, cells, parts)
                far = (x.astype(float) ** 2).sum(axis=1) - self._score(x).max(axis=1) if len(self.centres) else np.zeros(len(x))
                z = hashes.view("<u8") + step  # splitmix64
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z = z ^ (z >> np.uint64(31))
                time = -np.log(((z >> np.uint64(11)) + 0.5) / 2**53) / (far[: len(z)] + 1e-6)
                for i in np.flatnonzero(time == time.min()):
                    mine = (float(time[i]), x[i].astype("<u2").tobytes())
                    best = mine if best is None else min(best, mine)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in best], names=["time", "vector"])

        first = blocks.mapInArrow(race, "time double, vector binary").orderBy("time", "vector").first()
        return np.frombuffer(bytes(first[1]), "<u2").astype(float)

    def _sums(self, blocks: DataFrame) -> np.ndarray:
        """Per centre the sum of the vectors nearest to it and, last, their number."""
        k = len(self.centres)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, WIDTH + 1), dtype=np.int64)
            for lengths, cells, parts in _unpacked(batches):
                x = _spread(lengths, cells, parts)
                near = self._score(x).argmax(axis=1)
                mine = np.eye(k, dtype=np.float32)[near].reshape(-1, TILE, k).transpose(0, 2, 1)
                total[:, :-1] += (mine @ x.reshape(-1, TILE, WIDTH)).sum(axis=0).astype(np.int64)
                total[:, -1] += np.bincount(near[: len(lengths)], minlength=k)
            yield _numbers(total.ravel())

        return _added(blocks.select("lengths", "cells", "parts"), add, k * (WIDTH + 1)).reshape(k, WIDTH + 1)

    def _score(self, x: np.ndarray) -> np.ndarray:
        """Highest for the nearest centre: what the squared length of the vector exceeds the squared distance by."""
        products = x.reshape(-1, TILE, WIDTH) @ self.centres.T.astype(np.float32)
        return 2 * products.reshape(len(x), len(self.centres)).astype(float) - (self.centres**2).sum(axis=1)

    def topics(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Topics of packed counts; ``none`` where there are no tokens."""
        names = np.array([f"topic_{j}" for j in range(len(self.centres))], dtype=object)
        out = np.full(len(cells), "none", dtype=object)
        for at, lengths, where, parts in self._parts(cells, counts) if len(names) else ():
            near = self._score(_spread(lengths, where, parts)).argmax(axis=1)[: len(lengths)]
            out[at] = np.where(lengths > 0, names[near], "none")
        return out

    def topic(self, cells: Column, counts: Column) -> Column:
        @F.pandas_udf(T.StringType())
        def nearest(cells: pd.Series, counts: pd.Series) -> pd.Series:
            return pd.Series(self.topics(cells.to_numpy(), counts.to_numpy()), dtype=object)

        return nearest(cells, counts)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The arrays of each block."""
    for b in batches:
        for row in zip(*[c.to_numpy(zero_copy_only=False) for c in b.columns], strict=True):
            yield [np.frombuffer(v, "<i8" if name == "hashes" else "<u2") for v, name in zip(row, b.schema.names, strict=True)]


def _spread(lengths: np.ndarray, cells: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """One row per vector, and empty rows up to a whole number of tiles."""
    x = np.zeros((-(-len(lengths) // TILE) * TILE, WIDTH), dtype=np.float32)
    x.ravel()[np.repeat(np.arange(len(lengths)) * WIDTH, lengths) + cells] = parts
    return x


def _numbers(values: np.ndarray) -> pa.RecordBatch:
    """Rows (place, value) of the values that are not 0."""
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(values[at])], names=["place", "value"])


def _added(df: DataFrame, partial: Callable, size: int) -> np.ndarray:
    """Sums by place of what the tasks give; the driver sees one row per place."""
    out = np.zeros(size, dtype=np.int64)
    for r in df.mapInArrow(partial, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r[0]] = r[1]
    return out


def tokens_and_topic(col: Column, model: TopicModel, path: str = TOKENIZER) -> Column:
    """Struct(n_tokens, topic) of whole texts by a model that is there; a text without tokens has topic ``none``."""
    c = token_counts(col, path)
    return F.struct(c["n_tokens"].alias("n_tokens"), model.topic(c["cells"], c["counts"]).alias("topic"))


def rake(cells: pd.DataFrame, shares: dict[str, float], caps: dict[str, int], total: float, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of the cells (source, lang, topic, tokens): sources at ``shares`` of ``total`` as far as the caps allow, languages
    and topics at their present shares. Ends when a round moves no more than ``tolerance`` of the tokens; where the marginals
    contradict each other the rounds settle between them, the sources being exact."""
    t = cells["tokens"].to_numpy(float)
    cap = cells["source"].map(caps).to_numpy(float)
    want = {s: shares[s] * total for s in shares}
    w = np.ones(len(cells))
    sides = [(cells[d].to_numpy(), cells.groupby(d)["tokens"].sum() / max(t.sum(), 1)) for d in ("lang", "topic")]
    by_source = {s: np.flatnonzero(cells["source"].to_numpy() == s) for s in shares}
    moved, rounds = np.inf, 0
    while moved > tolerance:
        old, rounds = w.copy(), rounds + 1
        for value, share in sides:
            now = pd.Series(w * t).groupby(value).sum()
            mass = (w * t).sum()
            w = w * pd.Series(value).map(share * mass / now.where(now > 0)).fillna(1.0).to_numpy()
        for s, at in by_source.items():
            w[at] = _fit(w[at], t[at], cap[at], want[s])
        moved = (np.abs(w - old) * t).sum() / max((w * t).sum(), 1)
        if rounds % 1000 == 0:  # contradicting marginals close in ever more slowly
            tolerance *= 10
            if tolerance > 1e-3:
                raise RuntimeError("raking does not settle")
    return w


def _fit(w: np.ndarray, t: np.ndarray, cap: np.ndarray, want: float) -> np.ndarray:
    """Scale w so that sum(min(cap, f * w) * t) is ``want``; all at the cap if that is too little."""
    if not len(w) or (cap * t).sum() <= want:
        return cap.copy()
    free = np.ones(len(w), dtype=bool)
    while True:
        rest = want - (cap[~free] * t[~free]).sum()
        f = rest / max((w[free] * t[free]).sum(), 1e-300)
        over = free & (w * f > cap)
        if not over.any():
            return np.where(free, w * f, cap)
        free &= ~over


class Mix:
    """The mix and its reports. ``total``: tokens to plan for, by default those of all documents whose source has a target."""

    def __init__(self, docs: DataFrame, targets: DataFrame, total: float | None = None, tokenizer: str = TOKENIZER, seed: str = "mix", topics: TopicModel | None = None):
        spark = docs.sparkSession
        work = Workspace(spark, "mix")
        rows = targets.select(clean_category("source").alias("s"), "target_permille", "max_repeats").where("s is not null").collect()  # one row per source by nature
        self.targets = {r[0]: (int(r[1] or 0), int(r[2] or 0)) for r in rows}
        source = clean_category("source")
        mine = docs.where(source.isin(list(self.targets)))
        lang = F.coalesce(clean_category("lang"), F.lit("unknown"))
        named = mine.select("doc_id", source.alias("source"), lang.alias("lang"), hash_bits("topics", "doc_id").alias("hash"), token_counts(F.col("text"), tokenizer).alias("c"))
        counted = work.save(named.select("doc_id", "source", "lang", "hash", "c.*"), "counted")
        model = topics or TopicModel.fit(counted, work)
        self.docs = work.save(counted.select("doc_id", "source", "lang", model.topic(F.col("cells"), F.col("counts")).alias("topic"), "n_tokens"), "docs")
        work.drop("counted")
        dims = ["source", "lang", "topic"]
        cells = self.docs.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")).orderBy(*dims).toPandas()  # sources of the targets x languages x topics
        self.cells = cells
        self.total = float(total if total is not None else cells["tokens"].sum())
        permille = sum(p for p, _ in self.targets.values()) or 1
        shares = {s: p / permille for s, (p, _) in self.targets.items()}
        cells["weight"] = rake(cells, shares, {s: c for s, (_, c) in self.targets.items()}, self.total) if len(cells) else []
        self.shares = shares
        plan = spark.createDataFrame([(*map(str, r[:3]), float(r[3])) for r in cells[[*dims, "weight"]].itertuples(index=False)], "source string, lang string, topic string, weight double")
        base, rest = F.floor("weight"), F.col("weight") - F.floor("weight")
        race = 1 - F.pow(1 - hash_unit(seed, "doc_id"), 1 / F.col("_rest"))
        weighted = self.docs.join(F.broadcast(plan), dims).withColumn("_rest", rest).withColumn("_base", base)
        weighted = work.save(weighted.withColumn("_race", F.when(F.col("_rest") > 0, (race * F.lit(float(2**59))).cast("long"))), "weighted")
        quotas = weighted.groupBy("source").agg(F.sum(F.col("_rest") * F.col("n_tokens")).alias("quota"))
        racing = weighted.where("_race is not null")
        extra = work.save(take_lowest(racing, ["source"], "_race", "doc_id", quotas, size="n_tokens").select("doc_id", "source", "n_tokens"), "extra")
        free = work.save(racing.join(extra.select("doc_id"), "doc_id", "left_anti").where("n_tokens > 0"), "free")
        filled = extra.select("doc_id").unionByName(self._fill(free, quotas, extra).select("doc_id")).withColumn("_extra", F.lit(1))
        out = weighted.join(filled, "doc_id", "left").withColumn("copies", F.col("_base") + F.coalesce("_extra", F.lit(0)))
        self.mixed = work.save(out.select("doc_id", *dims, "n_tokens", "copies").where("copies > 0"), "mixed")
        work.drop("free")

    def _fill(self, free: DataFrame, quotas: DataFrame, extra: DataFrame) -> DataFrame:
        """Documents that fill what is left of each source's plan: the largest that fit, of one size those first in the race.

        The rest of a plan is below the size of one document, so the sizes that come into question are few; they are counted
        per source, and the driver sees one row for each.
        """
        had = extra.groupBy("source").agg(F.sum("n_tokens").alias("had"))
        gaps = {r[0]: r[1] for r in quotas.join(had, "source", "left").select("source", F.floor(F.col("quota") - F.coalesce("had", F.lit(0)) + F.lit(1e-6))).collect()}
        gap = F.try_element_at(F.create_map(*[F.lit(x) for kv in gaps.items() for x in kv]), F.col("source")) if gaps else F.lit(None).cast("long")
        sizes = free.where(F.col("n_tokens") <= gap).groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect()
        picks, left = [], dict(gaps)
        for r in sorted(sizes, key=lambda r: (r[0], -r[1])):
            k = min(r[2], left[r[0]] // r[1])
            if k:
                picks.append((r[0], r[1], k))
                left[r[0]] -= k * r[1]
        plan = free.sparkSession.createDataFrame(picks, "source string, n_tokens long, quota long")
        return take_lowest(free, ["source", "n_tokens"], "_race", "doc_id", plan)

    def sample(self) -> DataFrame:
        """``doc_id``, source, lang, topic, n_tokens and how often the document is taken."""
        return self.mixed

    def report(self) -> DataFrame:
        """One row per source, language and topic: target (for languages and topics their share of the corpus) and reached
        permille of all tokens taken; for sources also caps, tokens had, planned and taken, and whether the cap limits them."""
        spark = self.mixed.sparkSession
        rows = [(s, float(p), c, round(self.shares[s] * self.total)) for s, (p, c) in sorted(self.targets.items())]
        plan = spark.createDataFrame(rows, "value string, target_permille double, max_repeats int, planned_tokens long").withColumn("dimension", F.lit("source"))
        sides = ["source", "lang", "topic"]
        sided = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in sides]))
        long = lambda df: df.select(sided.alias("d"), *[c for c in df.columns if c not in sides]).select("d.*", *[c for c in df.columns if c not in sides])
        had = long(self.docs).groupBy("dimension", "value").agg(F.sum("n_tokens").alias("available_tokens"))
        got = long(self.mixed).groupBy("dimension", "value").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
        sums = self.mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all")).first()[0] or 0
        corpus = int(self.cells["tokens"].sum()) if len(self.cells) else 0
        keys = ["dimension", "value"]
        out = had.join(F.broadcast(plan), keys, "full").join(got, keys, "left").na.fill(0, ["available_tokens", "tokens", "most_copies"])
        target = F.coalesce("target_permille", F.try_divide(F.col("available_tokens") * 1000.0, F.lit(corpus)))
        return out.select("dimension", "value", target.alias("target_permille"), F.try_divide(F.col("tokens") * 1000.0, F.lit(sums)).alias("reached_permille"), "max_repeats", "most_copies", "available_tokens", "planned_tokens", "tokens", (F.col("available_tokens") * F.col("max_repeats") < F.col("planned_tokens")).alias("limited"))
