"""Queries over tasks, patients and image records: proportional sample (p3), overlap (p4), grouped splits (p5), stable sample (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import clean_split
from ..session import Workspace
from ..tables import table
from .block_sample import Registry, block_sample, first_deliveries
from .group_split import assign_splits, entity_groups, split_conflicts, split_shares
from .overlap import cross_split_pairs, overlap_classes, overlap_report
from .proportional import ProportionalSample

PATIENT_TABLES = ("multitask", "canonical", "paired_evidence", "metastases", "patient_splits", "documents")


def _share(spark: SparkSession, d: str) -> ProportionalSample:
    return ProportionalSample(table(spark, d, "multitask"), table(spark, d, "sample_targets"), "task_id", ["ingested_at", "row_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).cannot_be_met()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).report()


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _share(spark, d).sample().withColumnRenamed("unit", "task_id")


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    """What the targets ask for and what there is, without the sample."""
    return _share(spark, d).report().select("field_name", "category", "available", "available_last", "goal_rows", "min_rows")


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any proportional sample, as rows: its size, repeated or unknown tasks, categories that are not those of
    the last row, minimums not held that the report calls met, report rows that differ from a recount."""
    s = _share(spark, d)
    got, report = Workspace(spark, "checks").save(s.sample(), "sample"), s.report()
    clean = F.coalesce(clean_split("category"), F.lit("missing"))
    pairs = got.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("c")) for f in s.fields])).alias("r")).groupBy("r.field_name", "r.c").agg(F.count("*").alias("n"))
    both = report.withColumn("c", clean).join(pairs, ["field_name", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    units = s.units.select("unit", F.struct(*s.fields).alias("own"))
    joined = got.select("unit", F.struct(*s.fields).alias("said")).join(units, "unit", "left")
    one = lambda df, name, value: df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("value")).select(F.lit(name).alias("name"), "value")
    return (
        one(got, "rows", F.count("*")).unionByName(one(got, "distinct_tasks", F.count_distinct("unit")))
        .unionByName(one(joined, "unknown_tasks", F.sum(F.col("own").isNull().cast("long")))).unionByName(one(joined, "other_categories", F.sum((F.col("own") != F.col("said")).cast("long"))))
        .unionByName(one(both, "unreported_minimums", F.sum((F.col("met") & (F.col("n") < F.col("min_rows"))).cast("long")))).unionByName(one(both, "report_differs", F.sum((F.col("n") != F.col("sample_rows")).cast("long"))))
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, d, "whole_records"), table(spark, d, "multitask"))
    return pairs.select(F.least("rec_t", "rec_e").alias("rec_a"), F.greatest("rec_t", "rec_e").alias("rec_b")).distinct()


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap_classes(table(spark, d, "whole_records"), table(spark, d, "multitask"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "whole_records"), table(spark, d, "multitask"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return entity_groups([table(spark, d, t) for t in PATIENT_TABLES], table(spark, d, "canonical"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_conflicts(_groups(spark, d), [table(spark, d, "multitask"), table(spark, d, "patient_splits")]).select("patient_id")


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(_groups(spark, d), table(spark, d, "split_targets"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each split, by patients, with its components and the largest of them."""
    return split_shares(p5_splits(spark, d), table(spark, d, "split_targets"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of a registry that saw the whole table at once; deliveries in order give the same ones."""
    registry = Registry(spark, Workspace(spark, "registry").path("numbers"))
    return registry.extend(first_deliveries(table(spark, d, "multitask"), "task_id", "batch"))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return block_sample(_numbers(spark, d)).withColumnRenamed("unit", "task_id")


def p6_registry(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(spark, d).withColumnRenamed("unit", "task_id")


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p3_sample, p3_limits, p3_checks, p4_found, p4_classes, p4_report, p5_found, p5_splits, p5_report, p6_sample, p6_registry)}

_K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_CAT = r"nullif(regexp_replace(regexp_replace(lower({}), '^\s+|\s*\.?\s*$', '', 'g'), '[\s_-]+', '_', 'g'), '')"
_SPLIT = f"(CASE WHEN {_CAT} = 'valid' THEN 'val' ELSE {_CAT} END)"
_DIGEST = r"(CASE WHEN regexp_full_match(regexp_replace(lower(trim({0}, ' ' || chr(9))), '^(0x|sha256:)', ''), '[0-9a-f]{{64}}') THEN regexp_replace(lower(trim({0}, ' ' || chr(9))), '^(0x|sha256:)', '') END)"
_WORD = lambda c, k: f"('0x' || substr({c}, {1 + 16 * k}, 16))::UBIGINT"
_APART = " + ".join(f"bit_count(xor({_WORD('a.h', k)}, {_WORD('b.h', k)}))::INT" for k in range(4))
_P4_ROWS = f"""shown AS (SELECT path, bool_or(s = 'train') AS tr, bool_or(s IN ('val', 'test')) AS ev, bool_or(s = 'val') AS in_val, bool_or(s = 'test') AS in_test FROM (SELECT {_SPLIT.format("split", "split")} AS s, unnest(list_transform(images, lambda x: x.image)) AS path FROM multitask) WHERE s IS NOT NULL GROUP BY path),
      r AS (SELECT rec_id, source, {_DIGEST.format("sha256")} AS sha, {_DIGEST.format("a_hash")} AS h, tr, ev, in_val, in_test FROM whole_records JOIN shown ON path = source_path WHERE file_bytes IS DISTINCT FROM 0)"""
_P4_CLASSES = f"""{_P4_ROWS}, f AS (SELECT sha, count(*) AS n, min(rec_id) AS lo, max(rec_id) AS hi FROM r WHERE tr AND sha IS NOT NULL GROUP BY sha), a AS (SELECT h, count(*) AS n, min(rec_id) AS lo, max(rec_id) AS hi FROM r WHERE tr AND h IS NOT NULL GROUP BY h),
      l AS (SELECT b.h, count(*) AS near_hashes, sum(a.n)::BIGINT AS near_records, min(a.lo) AS lo, max(a.hi) AS hi FROM a JOIN (SELECT DISTINCT h FROM r WHERE ev AND h IS NOT NULL) b ON {_APART} <= 12 GROUP BY b.h),
      classes AS (SELECT * FROM (SELECT rec_id, source, in_val, in_test, coalesce(h, 'file:' || sha) AS class_id, coalesce(f.n, 0) - (tr AND sha IS NOT NULL)::INT AS same_file, coalesce(near_hashes, 0) AS near_hashes, coalesce(near_records, 0) - (tr AND h IS NOT NULL)::INT AS near_records,
        coalesce(nullif(f.lo, rec_id), nullif(f.hi, rec_id), nullif(l.lo, rec_id), nullif(l.hi, rec_id)) AS train_rec FROM r LEFT JOIN f USING (sha) LEFT JOIN l USING (h) WHERE ev) WHERE same_file > 0 OR near_records > 0)"""
_PATIENTS = " UNION ".join(f"SELECT {_K.format('patient_id')} AS p FROM {t} WHERE patient_id IS NOT NULL" for t in PATIENT_TABLES)
_GROUPS = f"""patients AS ({_PATIENTS}),
  c AS (SELECT {_K.format("patient_id")} AS p, {_K.format("duplicate_of_patient_id")} AS q, {_K.format("duplicate_group_id")} AS g FROM canonical WHERE patient_id IS NOT NULL),
  one AS (SELECT p, q FROM c WHERE q IN (FROM patients) UNION SELECT a.p, b.p FROM c a JOIN c b ON a.g = b.g),
  edges AS (SELECT p, q FROM one UNION SELECT q, p FROM one),
  reach AS (SELECT p, p AS q FROM patients UNION SELECT reach.p, edges.q FROM reach JOIN edges ON reach.q = edges.p),
  groups AS (SELECT p, min(q) AS component FROM reach GROUP BY p)"""


def _p3_have(field: str) -> str:
    cat = (_SPLIT if field == "split" else _CAT).format(field, field)
    return f"SELECT '{field}' AS field_name, coalesce({cat}, 'missing') AS cat, count(DISTINCT {_K.format('task_id')}) AS n FROM multitask WHERE task_id IS NOT NULL GROUP BY 1, 2"


_P3_FIELDS = ("split", "region_level", "interaction_type", "answer_label")


def _p3_last(field: str) -> str:
    cat = (_SPLIT if field == "split" else _CAT).format(field, field)
    return f"SELECT '{field}' AS field_name, coalesce({cat}, 'missing') AS cat, count(*) AS n FROM last GROUP BY 1, 2"


ORACLE = {
    "p3_limits": f"""WITH have AS ({" UNION ALL ".join(map(_p3_have, _P3_FIELDS))}), last AS (SELECT * FROM multitask WHERE task_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_K.format("task_id")} ORDER BY ingested_at DESC, row_id DESC) = 1),
      held AS ({" UNION ALL ".join(map(_p3_last, _P3_FIELDS))}), size AS (SELECT (count(*) * 15 + 99) // 100 AS n FROM last)
      SELECT s.field_name, s.category, coalesce(h.n, 0) AS available, coalesce(l.n, 0) AS available_last, ((s.target_permille * size.n + 999) // 1000)::BIGINT AS goal_rows, s.min_rows::BIGINT AS min_rows
      FROM sample_targets s CROSS JOIN size LEFT JOIN have h ON h.field_name = s.field_name AND h.cat = coalesce({_SPLIT.format("s.category", "s.category")}, 'missing') LEFT JOIN held l ON l.field_name = s.field_name AND l.cat = coalesce({_SPLIT.format("s.category", "s.category")}, 'missing')""",
    "p3_checks": f"""WITH size AS (SELECT (count(DISTINCT {_K.format("task_id")}) * 15 + 99) // 100 AS n FROM multitask)
      SELECT 'rows' AS name, n AS value FROM size UNION ALL SELECT 'distinct_tasks', n FROM size UNION ALL SELECT unnest(['unknown_tasks', 'other_categories', 'unreported_minimums', 'report_differs']), 0""",
    "p3_found": f"""WITH have AS ({" UNION ALL ".join(map(_p3_have, ("split", "region_level", "interaction_type", "answer_label")))}),
      size AS (SELECT (count(DISTINCT {_K.format("task_id")}) * 15 + 99) // 100 AS n FROM multitask)
      SELECT s.field_name, s.category FROM sample_targets s CROSS JOIN size LEFT JOIN have h ON h.field_name = s.field_name AND h.cat = {_SPLIT.format("s.category", "s.category")}
      WHERE coalesce(h.n, 0) < greatest((s.target_permille * size.n + 999) // 1000, s.min_rows)""",
    "p4_found": f"""WITH {_P4_ROWS} SELECT DISTINCT least(a.rec_id, b.rec_id) AS rec_a, greatest(a.rec_id, b.rec_id) AS rec_b FROM r a JOIN r b ON a.tr AND b.ev AND a.rec_id <> b.rec_id WHERE a.sha = b.sha OR (a.h IS NOT NULL AND b.h IS NOT NULL AND {_APART} <= 12)""",
    "p4_classes": f"""WITH {_P4_CLASSES} SELECT * FROM classes""",
    "p4_report": f"""WITH {_P4_CLASSES} SELECT split, source, count(*) AS records, count(*) FILTER (same_file > 0) AS with_same_file, count(*) FILTER (near_records > 0) AS with_near_image
      FROM (SELECT *, unnest(list_filter([CASE WHEN in_val THEN 'val' END, CASE WHEN in_test THEN 'test' END], lambda x: x IS NOT NULL)) AS split FROM classes) GROUP BY split, source""",
    "p5_found": f"""WITH RECURSIVE {_GROUPS},
      said AS (SELECT {_K.format("patient_id")} AS p, {_SPLIT.format("split", "split")} AS s FROM multitask UNION SELECT {_K.format("patient_id")}, {_SPLIT.format("split", "split")} FROM patient_splits)
      SELECT p AS patient_id FROM groups WHERE component IN (SELECT component FROM said JOIN groups USING (p) WHERE s IS NOT NULL GROUP BY component HAVING count(DISTINCT s) > 1)""",
    "p5_report": f"""WITH RECURSIVE {_GROUPS}, ranges AS (SELECT {_SPLIT.format("split", "split")} AS s, sum(target_permille) OVER (ORDER BY {_SPLIT.format("split", "split")}) AS upto, target_permille AS p FROM split_targets),
      g AS (SELECT component, s, count(*) AS n FROM groups JOIN ranges r ON ('0x' || substr(sha256('group-split:' || component), 1, 15))::BIGINT % (SELECT sum(target_permille) FROM split_targets) BETWEEN r.upto - r.p AND r.upto - 1 GROUP BY ALL)
      SELECT r.s AS split, r.p AS target_permille, coalesce(sum(n), 0)::BIGINT AS entities, count(n) AS components, coalesce(max(n), 0) AS largest, round(coalesce(sum(n), 0) * 1000.0::DOUBLE / (SELECT sum(n) FROM g), 3) AS reached_permille FROM ranges r LEFT JOIN g USING (s) GROUP BY r.s, r.p""",
    "p5_splits": f"""WITH RECURSIVE {_GROUPS}, ranges AS (SELECT {_SPLIT.format("split", "split")} AS s, sum(target_permille) OVER (ORDER BY {_SPLIT.format("split", "split")}) AS upto, target_permille AS p FROM split_targets)
      SELECT g.p AS patient_id, component, s AS new_split FROM groups g JOIN ranges r ON ('0x' || substr(sha256('group-split:' || component), 1, 15))::BIGINT % (SELECT sum(target_permille) FROM split_targets) BETWEEN r.upto - r.p AND r.upto - 1""",
    "p6_registry": f"""SELECT unit AS task_id, CASE WHEN b IS NULL THEN -row_number() OVER (PARTITION BY b IS NULL ORDER BY sha256(unit), unit) ELSE row_number() OVER (PARTITION BY b IS NULL ORDER BY b, sha256(unit), unit) - 1 END AS seq
      FROM (SELECT {_K.format("task_id")} AS unit, min(batch) AS b FROM multitask WHERE task_id IS NOT NULL GROUP BY 1)""",
    "p6_sample": f"""WITH u AS (SELECT {_K.format("task_id")} AS unit, min(batch) AS b FROM multitask WHERE task_id IS NOT NULL GROUP BY 1),
      n AS (SELECT unit, row_number() OVER (ORDER BY b, sha256(unit), unit) - 1 AS seq FROM u),
      chosen AS (SELECT b * 1000 + p AS seq FROM (SELECT b, p, row_number() OVER (PARTITION BY b ORDER BY md5('blocks:' || b || ':' || p), p) AS r FROM (SELECT unnest(range((SELECT max(seq) // 1000 + 1 FROM n))) AS b), (SELECT unnest(range(1000)) AS p)) WHERE r <= 150)
      SELECT unit AS task_id, seq FROM n WHERE seq IN (SELECT seq FROM chosen)""",
}
