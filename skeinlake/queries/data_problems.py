"""Queries of the general data problems (nested records, orphan references) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.nested import Child, TaggedTables
from ..operators.orphans import Entity, Reference, ReferenceGraph
from ..tables import table

TASK_CHILDREN = (Child("images", "image"), Child("targets", "target"), Child("required_outputs", "output", "flags"))


def _tables(spark: SparkSession, d: str) -> TaggedTables:
    return TaggedTables(spark, table(spark, d, "multitask"), "row_id", TASK_CHILDREN)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).links()


def p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """The root table: one row per record with how many children of each kind it has."""
    c = F.col("child")
    per = _tables(spark, d).links().groupBy("row_id").agg(*[F.count(F.when(c == k, 1)).alias(f"n_{k}") for k in ("image", "target", "output")])
    root = table(spark, d, "multitask").select("row_id", "task_id", "split", "task_type")
    return root.join(per, "row_id", "left").na.fill(0, ["n_image", "n_target", "n_output"])


def p1_images(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d).table("image")
    return t.select("row_id", "pk", "parent_pk", "pos", "image", F.get("image_size", F.lit(0)).alias("width"), F.get("image_size", F.lit(1)).alias("height"), "view")


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d).table("target")
    return t.select("row_id", "pk", "parent_pk", "pos", "view", F.size("bbox").cast("bigint").alias("n_coords"), F.array_join(F.transform("bbox", lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ",").alias("bbox"))


def p1_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).table("output").select("row_id", "pk", "parent_pk", "pos", "member")


def reference_graph(spark: SparkSession, d: str) -> ReferenceGraph:
    t = lambda n: table(spark, d, n)
    return ReferenceGraph(
        [
            Entity("canonical", t("canonical"), "row_id", "record_id", deleted="deleted_at"),
            Entity("paired_evidence", t("paired_evidence"), "row_id", "evidence_id", deleted="deleted_at"),
            Entity("metastases", t("metastases"), "row_id", "metastasis_id"),
            Entity("multitask", t("multitask"), "row_id", "task_id"),
        ],
        [
            Reference("multitask", F.col("evidence_id"), "paired_evidence"),
            Reference("metastases", F.col("candidate_record_ids"), "canonical", many=True),
            Reference("paired_evidence", F.col("images.record_id"), "canonical", many=True),
        ],
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return reference_graph(spark, d).cascade().where("depth = 0").select("tbl", "row_id", "ref_key")


def p2_inherited(spark: SparkSession, d: str) -> DataFrame:
    return reference_graph(spark, d).cascade().where("depth > 0").select("tbl", "row_id", "ref_key", F.col("depth").cast("bigint").alias("depth"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return reference_graph(spark, d).report()


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p1_images, p1_targets, p1_outputs, p2_found, p2_inherited, p2_report)}


def _elements(field: str, fields: str) -> str:
    return f"""SELECT row_id, i - 1 AS pos, {field}[i] AS x FROM (SELECT row_id, {field}, unnest(range(1, len({field}) + 1)) AS i FROM multitask)
      WHERE {field}[i] IS NOT NULL AND NOT ({" AND ".join(f"{field}[i].{f} IS NULL" for f in fields.split())})
      QUALIFY row_number() OVER (PARTITION BY row_id, {", ".join(f"{field}[i].{f}" for f in fields.split())} ORDER BY i) = 1"""


_IMAGES, _TARGETS = _elements("images", "image image_size view"), _elements("targets", "view bbox")
_OUTPUTS = """SELECT row_id, m.pos, m.member FROM (SELECT row_id, unnest([{'pos': 0, 'member': 'answer', 'v': required_outputs.answer},
      {'pos': 1, 'member': 'classification', 'v': required_outputs.classification}, {'pos': 2, 'member': 'locations', 'v': required_outputs.locations}]) AS m FROM multitask) WHERE m.v"""
_KEYS = "row_id, row_id || '/{0}/' || pos AS pk, row_id::VARCHAR AS parent_pk, pos::INT AS pos"
_K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"
_DIRECT = f"""
  refs AS (
    SELECT DISTINCT 'multitask' AS tbl, row_id, {_K.format("task_id")} AS own_key, 'paired_evidence' AS parent, {_K.format("evidence_id")} AS ref_key, ingested_at AS came FROM multitask
    UNION ALL SELECT DISTINCT 'metastases', row_id, {_K.format("metastasis_id")}, 'canonical', {_K.format("r")}, ingested_at FROM (SELECT row_id, metastasis_id, ingested_at, unnest(candidate_record_ids) AS r FROM metastases)
    UNION ALL SELECT DISTINCT 'paired_evidence', row_id, {_K.format("evidence_id")}, 'canonical', {_K.format("r.record_id")}, ingested_at FROM (SELECT row_id, evidence_id, ingested_at, unnest(images) AS r FROM paired_evidence)),
  hist AS (
    SELECT 'canonical' AS parent, {_K.format("record_id")} AS ref_key, min(ingested_at) AS first_at, min(deleted_at) AS gone_at FROM canonical GROUP BY 1, 2
    UNION ALL SELECT 'paired_evidence', {_K.format("evidence_id")}, min(ingested_at), min(deleted_at) FROM paired_evidence GROUP BY 1, 2),
  direct AS (SELECT refs.*, CASE WHEN first_at IS NULL THEN 'missing' WHEN came < first_at THEN 'late' ELSE 'deleted' END AS cause, 0 AS depth FROM refs LEFT JOIN hist USING (parent, ref_key)
    WHERE ref_key IS NOT NULL AND (first_at IS NULL OR came < first_at OR came >= gone_at)),
  inherited AS (SELECT refs.*, 'inherited' AS cause, 1 AS depth FROM refs SEMI JOIN (SELECT DISTINCT tbl, own_key FROM direct WHERE own_key IS NOT NULL) o ON refs.parent = o.tbl AND refs.ref_key = o.own_key
    ANTI JOIN direct x ON x.tbl = refs.tbl AND x.row_id = refs.row_id AND x.parent = refs.parent AND x.ref_key = refs.ref_key)"""

ORACLE = {
    "p1_found": f"SELECT row_id, 'image' AS child, pos::INT AS pos FROM ({_IMAGES}) UNION ALL SELECT row_id, 'target', pos::INT FROM ({_TARGETS}) UNION ALL SELECT row_id, 'output', pos::INT FROM ({_OUTPUTS})",
    "p1_rows": f"""WITH c AS (SELECT row_id, 'image' AS child FROM ({_IMAGES}) UNION ALL SELECT row_id, 'target' FROM ({_TARGETS}) UNION ALL SELECT row_id, 'output' FROM ({_OUTPUTS}))
      SELECT m.row_id, task_id, split, task_type, count(child) FILTER (child = 'image') AS n_image, count(child) FILTER (child = 'target') AS n_target, count(child) FILTER (child = 'output') AS n_output FROM multitask m LEFT JOIN c USING (row_id) GROUP BY ALL""",
    "p1_images": f"SELECT {_KEYS.format('image')}, x.image AS image, x.image_size[1] AS width, x.image_size[2] AS height, x.view AS view FROM ({_IMAGES})",
    "p1_targets": f"SELECT {_KEYS.format('target')}, x.view AS view, len(x.bbox) AS n_coords, array_to_string(list_transform(x.bbox, lambda v: coalesce(v::VARCHAR, 'null')), ',') AS bbox FROM ({_TARGETS})",
    "p1_outputs": f"SELECT {_KEYS.format('output')}, member FROM ({_OUTPUTS})",
    "p2_found": f"WITH {_DIRECT} SELECT tbl, row_id, ref_key FROM direct",
    "p2_inherited": f"WITH {_DIRECT} SELECT tbl, row_id, ref_key, depth::BIGINT AS depth FROM inherited",
    "p2_report": f"""WITH {_DIRECT} SELECT tbl, strftime(came, '%Y-%m') AS month, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS kind, cause, count(*) AS n_refs, count(DISTINCT row_id) AS n_rows
      FROM (SELECT * FROM direct UNION ALL SELECT * FROM inherited) GROUP BY ALL""",
}
