"""A sample that stays the same on every run and layout and keeps its members as records are added.

Every unit has a persistent sequence number. Units are numbered by the delivery they first came with and, inside a delivery,
by the hash of their id, so later deliveries only append. What comes out of order (late rows of an old delivery, deliveries
without a number) would shift such numbers if they were made anew; a ``Registry`` keeps the numbers given so far and puts
every unit it does not know behind the last one. Numbers fall into fixed blocks; the hash of the block number and the place
picks the chosen places of a block before any unit fills it, the last, unfilled block included.

Defined results
- null unit: not numbered; several rows: the earliest known delivery; repeated rows add nothing
- null delivery: numbered below zero, in blocks of their own, so that such units never move others; if a numbered delivery
  of the unit comes too, that one counts
- ties cannot happen (ids are distinct); an empty table gives an empty sample; extra columns are left alone
- with a registry, numbered units keep their numbers whatever the rows say, new ones follow behind the last number
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_key
from ..session import Workspace

NUMBERS = "unit string, seq long"


def first_deliveries(rows: DataFrame, unit: str, delivery: str) -> DataFrame:
    """``unit`` and the earliest ``delivery`` it came with (null if none of its rows names one)."""
    return rows.select(clean_key(unit).alias("unit"), F.col(delivery).cast("long").alias("delivery")).where("unit is not null").groupBy("unit").agg(F.min("delivery").alias("delivery"))


def number_units(units: DataFrame, start: int = 0, below: int = -1, cells: int = 12) -> DataFrame:
    """``unit``, ``seq``: numbers from ``start`` up in order of (delivery, sha256 of the unit); units without a delivery from
    ``below`` down in order of the hash.

    Counts per delivery and leading ``cells`` bits of the hash give each cell its offset; only a cell's units are ranked
    together, so no task sorts a whole delivery. The offsets are one row per delivery and cell.
    """
    hashed = units.withColumn("_h", F.sha2("unit", 256)).withColumn("_cell", F.shiftright(F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"), 16 - cells))
    hashed = hashed.withColumn("_known", F.col("delivery").isNotNull()).withColumn("delivery", F.coalesce("delivery", F.lit(0).cast("long")))
    hashed = Workspace(units.sparkSession, "numbers").save(hashed, "hashed")
    keys = ["_known", "delivery"]
    sizes = hashed.groupBy(*keys, "_cell").agg(F.count("*").alias("n"))
    per = sizes.groupBy(*keys).agg(F.sum("n").alias("n"))
    upto = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    before = per.withColumn("_before", upto(Window.partitionBy("_known").orderBy("delivery"))).drop("n")
    inside = sizes.withColumn("_inside", upto(Window.partitionBy(*keys).orderBy("_cell"))).drop("n")
    offsets = inside.join(before, keys).select(*keys, "_cell", (F.col("_before") + F.col("_inside")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy("_h", "unit"))
    at = F.col("_offset") + F.col("_rank") - 1
    placed = hashed.withColumn("_rank", rank).join(offsets, [*keys, "_cell"])
    return placed.select("unit", F.when(F.col("_known"), at + start).otherwise(below - at).alias("seq"))


class Registry:
    """The numbers given so far, in a folder of parts that are only ever added to.

    ``extend`` numbers what is new and writes it as the next part; nothing given before is read anew from the rows, so late,
    unnumbered and repeated deliveries cannot move a member. A part counts once its commit marker is there: a job that dies
    while writing leaves the registry as it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _parts(self) -> list[int]:
        there = self._fs.listStatus(self._path(self.root)) if self._fs.exists(self._path(self.root)) else []
        names = [s.getPath().getName() for s in there]
        return sorted(int(n[4:]) for n in names if n.startswith("part") and self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def numbers(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(NUMBERS).parquet(*[f"{self.root}/part{k}" for k in parts]) if parts else self.spark.createDataFrame([], NUMBERS)

    def extend(self, units: DataFrame) -> DataFrame:
        """All numbers, those of the ``units`` (``unit``, ``delivery``) that had none included. All new units follow behind the
        last number, in order of delivery; only a registry still empty numbers unknown deliveries below zero."""
        parts, known = self._parts(), self.numbers()
        if parts:
            last = known.agg(F.max("seq"), F.min("seq")).first()
            units = units.join(known.select("unit"), "unit", "left_anti")
            fresh = number_units(units, max((last[0] if last[0] is not None else -1) + 1, 0), min(-1 if last[1] is None else last[1] - 1, -1))
        else:
            fresh = number_units(units)
        fresh.write.mode("overwrite").parquet(f"{self.root}/part{(parts[-1] if parts else -1) + 1}")
        return self.numbers()


def block_sample(numbers: DataFrame, seed: str = "blocks", block: int = 1000, take: int = 150) -> DataFrame:
    """The numbered units at chosen places: ``unit``, ``seq``. Of every full block exactly ``take`` of ``block``.

    A block's units (``block`` at most) come together by one shuffle on the block number; its chosen places are made there,
    from the number alone. Nothing is broadcast and no table of places exists.
    """
    b = F.floor(F.col("seq") / block).cast("long")
    filled = numbers.select("unit", "seq", b.alias("b")).groupBy("b").agg(F.collect_list(F.struct("unit", "seq")).alias("units"))
    place = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda p: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), p.cast("string"))).alias("h"), p.alias("p")))
    chosen = F.transform(F.slice(F.array_sort(place), 1, take), lambda c: c["p"] + F.col("b") * block)
    held = filled.select("units", chosen.alias("chosen")).select(F.explode(F.expr("filter(units, u -> array_contains(chosen, u.seq))")).alias("u"))
    return held.select("u.unit", "u.seq")
