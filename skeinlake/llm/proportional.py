"""A sample whose category shares follow given targets, with a minimum from small categories, by swap repair.

Units are grouped by their signature (one category per field; categories without a target count as one), so the search
runs on signature counts: at most the product of (targets + 1) over the fields, whatever the number of units. The start is
random but holds the floors: each small category is drawn its minimum first, the rest is filled at random. Then counts are
exchanged between two signatures as long as that lowers the deviation from the targets, first its squares, then its absolute
sum; every exchange lowers a cost that takes finitely many values, so the search ends by itself. The units are drawn at
random (by hash) within each signature. What the repaired sample still misses is the report: too few units, or joint limits.

Defined results
- null or blank category: ``missing``; spellings that differ in case, blanks, hyphens, underscores or a final stop are one
- null unit id: the row is no unit; a unit with several rows has the categories of its last row (time, then row id)
- a target that cannot be met is reported, never forced; no units or no targets give an empty sample
- met: the minimum is held and the rows lie within one of the exact share; ``short_by`` counts rows below the greater of
  goal and minimum, ``over_by`` rows above the goal; ``reason`` is ``too_few`` where all units there are would not do, else
  ``joint`` (other targets or their units stand against it), null where the target is met
- two runs, or two layouts of the same rows, draw the same units
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import clean_category, clean_key, clean_split, hash_bits
from ..operators.skew import take_lowest
from ..session import Workspace

OTHER = "*"


@dataclass(frozen=True)
class Target:
    field: str
    category: str
    permille: int
    floor: int
    shown: str


def read_targets(df: DataFrame) -> list[Target]:
    """The target rows (a small table by nature: one row per field and category)."""
    named = df.select("field_name", "category", "target_permille", "min_rows", F.coalesce(clean_split("category"), F.lit("missing")).alias("clean")).where("field_name is not null")
    return sorted((Target(r[0], r[4], r[2] or 0, r[3] or 0, r[1]) for r in named.collect()), key=lambda t: (t.field, t.category))


def units_of(rows: DataFrame, unit: str, fields: list[str], order: list[str]) -> DataFrame:
    """One row per unit: ``unit``, the categories of its last row, and of each field all categories any row of it has."""
    cats = [F.coalesce((clean_split if f == "split" else clean_category)(f), F.lit("missing")).alias(f) for f in fields]
    clean = rows.select(clean_key(unit).alias("unit"), *cats, F.struct(*order).alias("_at")).where("unit is not null")
    last = F.max_by(F.struct(*fields), "_at").alias("_last")
    return clean.groupBy("unit").agg(last, *[F.collect_set(f).alias(f"all_{f}") for f in fields]).select("unit", "_last.*", *[f"all_{f}" for f in fields])


class _Search:
    """Exchange of signature counts. x[s] of n[s] units are taken from signature s."""

    def __init__(self, signatures: list[tuple], sizes: list[int], fields: list[str], targets: list[Target], total: int, seed: int):
        self.n, self.total = np.array(sizes, dtype=np.int64), total
        cats = {(t.field, t.category): i for i, t in enumerate(targets)}
        for s in signatures:
            for f, c in zip(fields, s):
                cats.setdefault((f, c), len(cats))
        self.cat = np.array([[cats[(f, c)] for f, c in zip(fields, s)] for s in signatures], dtype=np.int64).reshape(len(signatures), len(fields))
        goal = {(t.field, t.category): t.permille * total / 1000 for t in targets}
        floor = {(t.field, t.category): t.floor for t in targets}
        self.goal = np.array([goal.get(k, 0.0) for k in cats])
        have = np.zeros(len(cats), dtype=np.int64)
        np.add.at(have, self.cat, self.n[:, None])
        self.have = have
        self.floor = np.minimum(np.array([floor.get(k, 0) for k in cats]), have)
        self.x = self._start(np.random.default_rng(seed))

    def _start(self, rng: np.random.Generator) -> np.ndarray:
        """A random sample that holds the floors as far as the total allows: the scarcest category first."""
        x, left = np.zeros_like(self.n), self.total
        for c in np.argsort(self.have, kind="stable") if len(self.n) else ():
            holds = (self.cat == c).any(axis=1)
            need = min(int(self.floor[c] - x[holds].sum()), left)
            if need > 0:
                x[holds] += self._draw(rng, (self.n - x)[holds], need)
                left -= need
        return x + self._draw(rng, self.n - x, min(left, int((self.n - x).sum())))

    @staticmethod
    def _draw(rng: np.random.Generator, free: np.ndarray, k: int) -> np.ndarray:
        if k <= 0:
            return np.zeros_like(free)
        if free.sum() < 10**9:
            return rng.multivariate_hypergeometric(free, k, method="marginals")
        share = free * (k / free.sum())
        x = np.floor(share).astype(np.int64)
        x[np.argsort(-(share - x), kind="stable")[: k - x.sum()]] += 1
        return x

    def counts(self) -> np.ndarray:
        c = np.zeros(len(self.goal), dtype=np.int64)
        np.add.at(c, self.cat, self.x[:, None])
        return c

    def _cost(self, count: np.ndarray, power: int) -> np.ndarray:
        """Cost of each category: missing its floor outweighs all else; the deviation from its goal to a power (0: none)."""
        short = np.maximum(0, self.floor - count) * (1e6 * max(1, self.total) ** max(0, power - 1))
        return short + np.abs(count - self.goal) ** power if power else short

    def _improve(self, power: int) -> None:
        while True:
            c = self.counts()
            now = self._cost(c, power)
            less, more = self._cost(c - 1, power) - now, self._cost(c + 1, power) - now
            gain = less[self.cat].sum(axis=1)[:, None] + more[self.cat].sum(axis=1)[None, :]
            for f in range(self.cat.shape[1]):  # a field in which both signatures agree does not change
                k = self.cat[:, f]
                gain -= np.where(k[:, None] == k[None, :], (less + more)[k][:, None], 0.0)
            gain[self.x <= 0, :] = np.inf
            gain[:, self.x >= self.n] = np.inf
            a, b = np.unravel_index(np.argmin(gain), gain.shape)
            if not gain[a, b] < -1e-9:
                return
            moved = np.zeros(len(c), dtype=np.int64)
            np.add.at(moved, self.cat[a], -1)
            np.add.at(moved, self.cat[b], 1)
            k, most = 1, int(min(self.x[a], self.n[b] - self.x[b]))
            cost = lambda k: self._cost(c + k * moved, power).sum()
            while k * 2 <= most and cost(k * 2) < cost(k):
                k *= 2
            self.x[a] -= k
            self.x[b] += k

    def run(self) -> np.ndarray:
        if len(self.n) and self.total:
            self._improve(0)  # until the floors hold
            self._improve(2)  # squares are smooth: exchanges of two reach their least sum, where absolute values could stick
            self._improve(1)
        return self.x


class ProportionalSample:
    """The sample and its report. ``fraction`` of the distinct units, rounded up."""

    def __init__(self, rows: DataFrame, targets: DataFrame, unit: str, order: list[str], fraction: float = 0.15, seed: str = "share"):
        self.targets = read_targets(targets)
        self.fields = list(dict.fromkeys(t.field for t in self.targets if t.field in rows.columns))
        self.seed = seed
        spark = rows.sparkSession
        units = units_of(rows, unit, self.fields, order)
        known = {f: [t.category for t in self.targets if t.field == f] for f in self.fields}
        sig = [F.when(F.col(f).isin(known[f]), F.col(f)).otherwise(OTHER).alias(f"sig_{f}") for f in self.fields]
        self.sig = [f"sig_{f}" for f in self.fields]
        self.units = Workspace(spark, "share").save(units.select("*", *sig, hash_bits(seed, "unit").alias("_h")), "units")
        sizes = sorted((tuple(r[:-1]), r[-1]) for r in self.units.groupBy(*self.sig).agg(F.count("*")).collect()) if self.fields else []
        self.n_units = self.units.count()
        self.n_sample = math.ceil(round(fraction * self.n_units, 9))
        mine = [t for t in self.targets if t.field in self.fields]
        any_row = [F.sum(F.array_contains(f"all_{t.field}", t.category).cast("long")) for t in mine]
        last_row = [F.sum((F.col(t.field) == t.category).cast("long")) for t in mine]
        counted = [v or 0 for v in self.units.agg(*any_row, *last_row).first()] if mine else []
        at = {t: i for i, t in enumerate(mine)}
        self.available = [counted[at[t]] if t in at else 0 for t in self.targets]
        self.available_last = [counted[len(mine) + at[t]] if t in at else 0 for t in self.targets]
        search = _Search([s for s, _ in sizes], [n for _, n in sizes], self.fields, self.targets, self.n_sample if sizes else 0, 20260101)
        self.quotas = [(*s, int(x)) for (s, _), x in zip(sizes, search.run())]
        self.reached = search.counts()

    def sample(self) -> DataFrame:
        """``unit`` and its categories, exactly ``n_sample`` units."""
        if not self.quotas:
            return self.units.where("false").select("unit", *self.fields)
        spark = self.units.sparkSession
        quotas = spark.createDataFrame(self.quotas, ", ".join(f"{s} string" for s in self.sig) + ", quota long")
        return take_lowest(self.units, self.sig, "_h", "unit", F.broadcast(quotas)).select("unit", *self.fields)

    def report(self) -> DataFrame:
        """One row per target: units that have the category (by any row, by their last row), rows wanted, rows the repaired
        sample holds, by how many it misses and why."""
        rows = []
        for i, t in enumerate(self.targets):
            share = t.permille * self.n_sample / 1000
            goal = math.ceil(round(share, 9))
            got = int(self.reached[i]) if self.fields else 0
            want = max(goal, t.floor)
            few = self.available_last[i] < want
            met = got >= t.floor and abs(got - share) < 1 or t.floor > share and got == t.floor
            why = None if met else "too_few" if few else "joint"
            rows.append((t.field, t.shown, self.available[i], self.available_last[i], goal, t.floor, got, met, max(0, want - got), max(0, got - want), why, got * 1000 / self.n_sample if self.n_sample else None, t.permille))
        return self.units.sparkSession.createDataFrame(
            rows, "field_name string, category string, available long, available_last long, goal_rows long, min_rows long, sample_rows long, met boolean, short_by long, over_by long, reason string, sample_permille double, target_permille int"
        )

    def cannot_be_met(self) -> DataFrame:
        """Targets the repaired sample falls short of that no sample could meet: fewer units than wanted have the category in
        any of their rows. The search names the candidates (a category with too few units is always among them), the count decides."""
        return self.report().where("short_by > 0").where(F.col("available") < F.greatest("goal_rows", "min_rows")).select("field_name", "category")
