"""Audits: counts, summaries, language, duplicates, coverage, leakage, baselines, text metrics, feature maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import clean_category, clean_key, clean_split, hash_bits
from ..operators import baselines as B
from ..operators import features as V
from ..operators import profile as P
from ..operators import standard as N
from ..operators import textmetrics as Q
from ..operators.relational import last_per_key
from ..tables import table
from .base import tasks
from .catalog import Catalog
from .sqlkit import category, key, over, split, unit

C = Catalog()
_TOK = r"[A-Za-z]+(?:[''-][A-Za-z]+)*|\d+(?:\.\d+)?"
_WORDS = f"list_transform(regexp_extract_all(text, '{_TOK}'), lambda x: lower(x))"


def _docs(spark, d):
    return table(spark, d, "documents")


@C.add("SELECT count(*) AS n_rows, count(text) AS n_texts, sum(n_chars)::BIGINT AS n_chars, sum(length(text))::BIGINT AS text_chars, count(DISTINCT source) AS n_sources FROM documents")
def scan_projection_counts(spark, d):
    return _docs(spark, d).agg(F.count("*").alias("n_rows"), F.count("text").alias("n_texts"), F.sum("n_chars").alias("n_chars"), F.sum(F.length("text").cast("long")).alias("text_chars"), F.count_distinct("source").alias("n_sources"))


@C.add(f"SELECT {category('source')} AS source, {category('lang')} AS lang, count(*) AS n FROM documents GROUP BY ALL")
def group_counts(spark, d):
    return P.counts(_docs(spark, d), [clean_category("source").alias("source"), clean_category("lang").alias("lang")])


@C.add(over("tasks") + "SELECT region_level, task_type, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM t GROUP BY ALL")
def nested_counts_pivot(spark, d):
    p = tasks(spark, d).groupBy("region_level", "task_type").pivot("split", ["train", "val", "test"]).count()
    return p.na.fill(0, ["train", "val", "test"])


@C.add(over("tasks") + "SELECT split, task_type, region_level, grouping(split)::INT AS g_split, grouping(task_type)::INT AS g_task, grouping(region_level)::INT AS g_level, count(*) AS n FROM t GROUP BY GROUPING SETS ((), (split), (task_type), (task_type, region_level))")
def grouping_sets_strata(spark, d):
    t = tasks(spark, d).select("split", "task_type", "region_level")
    g = t.groupingSets([[], [F.col("split")], [F.col("task_type")], [F.col("task_type"), F.col("region_level")]], F.col("split"), F.col("task_type"), F.col("region_level"))
    return g.agg(F.grouping("split").cast("int").alias("g_split"), F.grouping("task_type").cast("int").alias("g_task"), F.grouping("region_level").cast("int").alias("g_level"), F.count("*").alias("n"))


@C.add("SELECT flag, count(*) AS n FROM (SELECT unnest(map_entries(flags)) AS e FROM canonical), LATERAL (SELECT e.key AS flag) WHERE e.value GROUP BY flag")
def flag_counts(spark, d):
    return P.flag_counts(table(spark, d, "canonical"), "flags")


_NUM = "SELECT {k}, '{n}' AS value, count({v}) AS count, round(min({v})::DOUBLE, 4) AS min, round(median({v})::DOUBLE, 4) AS median, round(avg({v}), 4) AS mean, round(max({v})::DOUBLE, 4) AS max, round(stddev_pop({v}), 4) AS std FROM {t} GROUP BY 1"


@C.add(" UNION ALL ".join(_NUM.format(k=f"{category('source')} AS source", n=n, v=v, t="documents") for n, v in (("chars", "length(text)"), ("words", f"len({_WORDS})"))))
def numeric_summary(spark, d):
    docs = _docs(spark, d).select(clean_category("source").alias("source"), F.length("text").alias("c"), F.when(F.col("text").isNotNull(), F.size(X.tokens(F.col("text")))).alias("w"))
    return P.numeric_summary(docs, ["source"], {"chars": F.col("c"), "words": F.col("w")}, 4)


@C.add(" UNION ALL ".join(_NUM.format(k=f"{category('source')} AS source", n=v, v=v, t="whole_records") for v in ("mean", "entropy", "file_bytes")).replace("round(median(file_bytes)::DOUBLE, 4)", "round(median(file_bytes)::DOUBLE, 4)"))
def image_feature_summary(spark, d):
    w = table(spark, d, "whole_records").select(clean_category("source").alias("source"), "mean", "entropy", "file_bytes")
    return P.numeric_summary(w, ["source"], {c: F.col(c) for c in ("mean", "entropy", "file_bytes")}, 4)


def _top(n: int) -> str:
    grams = _WORDS if n == 1 else f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    inner = f"SELECT unnest({grams}) AS gram FROM documents" if n == 1 else f"SELECT unnest({grams}) AS gram FROM (SELECT {_WORDS} AS w FROM documents)"
    return f"SELECT gram, count(*) AS n FROM ({inner}) GROUP BY gram ORDER BY n DESC, gram LIMIT 15"


def _grams(spark, d, n):
    words = X.tokens(F.col("text"))
    return P.top_k(_docs(spark, d).select(F.explode(words if n == 1 else X.ngrams(words, n)).alias("gram")), "gram", 15)


@C.add(_top(1))
def topk_tokens(spark, d):
    return _grams(spark, d, 1)


@C.add(_top(2))
def topk_bigrams(spark, d):
    return _grams(spark, d, 2)


@C.add(_top(3))
def topk_trigrams(spark, d):
    return _grams(spark, d, 3)


@C.add(over("tasks") + "SELECT task_type, n, classes, round(CASE WHEN classes <= 1 THEN 0 ELSE bits END, 4) AS bits FROM (SELECT task_type, sum(c)::BIGINT AS n, count(*) AS classes, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS bits FROM (SELECT task_type, answer_label, count(*) AS c FROM t WHERE answer_label IS NOT NULL GROUP BY ALL) GROUP BY task_type)")
def label_entropy(spark, d):
    return P.entropy(tasks(spark, d), ["task_type"], "answer_label").select("task_type", "n", "classes", F.round("bits", 4).alias("bits"))


@C.add(over("tasks") + "SELECT label, arg_min(answer_label, (-n, answer_label)) AS answer_label, max(n) AS n FROM (SELECT label, answer_label, count(*) AS n FROM t WHERE answer_label IS NOT NULL GROUP BY ALL) GROUP BY label")
def mode_with_ties(spark, d):
    return P.mode(tasks(spark, d), ["label"], "answer_label")


_MODE = "SELECT {0}, arg_min(answer_label, (-n, answer_label)) AS a FROM (SELECT {0}, answer_label, count(*) AS n FROM t WHERE split = 'train' AND answer_label IS NOT NULL GROUP BY ALL) GROUP BY ALL"


@C.add(over("tasks", f"near AS ({_MODE.format('task_type, label, view_scope')})", f"far AS ({_MODE.format('task_type')})") + "SELECT task_id, coalesce(near.a, far.a) AS predicted FROM t LEFT JOIN near ON t.task_type = near.task_type AND t.label = near.label AND t.view_scope = near.view_scope LEFT JOIN far ON t.task_type = far.task_type WHERE split = 'test'")
def majority_prior_fallback(spark, d):
    t = tasks(spark, d)
    return B.majority_prior(t.where("split = 'train'"), t.where("split = 'test'").select("task_id", "task_type", "label", "view_scope"), ["task_type", "label", "view_scope"], "answer_label", ["task_type"]).select("task_id", "predicted")


_BX = "bx AS (SELECT label, x.view AS view, x.bbox AS b FROM (SELECT label, unnest(targets) AS x FROM t WHERE split = 'train') WHERE len(x.bbox) = 4 AND x.bbox[1] < x.bbox[3] AND x.bbox[2] < x.bbox[4] AND x.bbox[1] >= 0 AND x.bbox[2] >= 0)"


def _train_boxes(spark, d):
    from ..functions.geometry import is_box

    b = tasks(spark, d).where("split = 'train'").select("label", F.explode("targets").alias("x")).select("label", F.col("x.view").alias("view"), F.col("x.bbox").alias("bbox"))
    return b.where(F.coalesce(is_box(F.col("bbox")), F.lit(False)))


@C.add(over("tasks", _BX) + "SELECT label, view, n, x1, y1, greatest(x2, x1 + 1) AS x2, greatest(y2, y1 + 1) AS y2 FROM (SELECT label, view, count(*) AS n, " + ", ".join(f"round_even(median(b[{i}]), 0)::BIGINT AS {c}" for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)) + " FROM bx GROUP BY ALL)")
def median_box_prior(spark, d):
    return B.box_priors(_train_boxes(spark, d), ["label", "view"])


@C.add(over("tasks", _BX) + "SELECT label, view, count(*) AS n, " + ", ".join(f"round(avg(b[{i}] / {s}), 4) AS {c}" for i, (c, s) in enumerate((("x1", "256.0::DOUBLE"), ("y1", "1024.0::DOUBLE"), ("x2", "256.0::DOUBLE"), ("y2", "1024.0::DOUBLE")), 1)) + " FROM bx GROUP BY ALL")
def mean_box_prior(spark, d):
    out = B.mean_box_priors(_train_boxes(spark, d), ["label", "view"], "bbox", F.lit(256.0), F.lit(1024.0))
    return out.select("label", "view", "n", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


_CODE = "regexp_extract_all(replace(lower(coalesce(prompt, '')), '-', '_'), '[a-z0-9_]+')"
_NB = f"""tr AS (SELECT task_type, answer_label, prompt FROM t WHERE split = 'train' AND task_type <> 'grounding' AND answer_label IS NOT NULL), cl AS (SELECT task_type, answer_label, count(*) AS r, sum(count(*)) OVER (PARTITION BY task_type) AS a FROM tr GROUP BY 1, 2),
  tk AS (SELECT task_type, answer_label, token, count(*) AS c FROM (SELECT task_type, answer_label, unnest({_CODE}) AS token FROM tr) GROUP BY ALL),
  den AS (SELECT cl.task_type, cl.answer_label, ln(r::DOUBLE / a) AS prior, coalesce((SELECT sum(c) FROM tk WHERE tk.task_type = cl.task_type AND tk.answer_label = cl.answer_label), 0) + (SELECT count(DISTINCT token) FROM tk WHERE tk.task_type = cl.task_type) AS d FROM cl),
  ev AS (SELECT task_id, task_type, unnest({_CODE}) AS token FROM t WHERE split = 'test' AND task_type <> 'grounding'),
  sc AS (SELECT e.task_id, e.task_type, den.answer_label, any_value(prior) + sum(ln((coalesce(c, 0) + 1)::DOUBLE / d)) AS score FROM ev e JOIN den ON e.task_type = den.task_type LEFT JOIN tk ON tk.task_type = e.task_type AND tk.answer_label = den.answer_label AND tk.token = e.token GROUP BY ALL)"""


def _nb(spark, d):
    t = tasks(spark, d).where("task_type <> 'grounding'")
    return B.NaiveBayes(t.where("split = 'train'"), "task_type", "answer_label", "prompt"), t.where("split = 'test' and prompt is not null").select("task_id", "task_type", "prompt", "answer_label")


@C.add(over("tasks", _NB) + "SELECT task_type, answer_label, token, c FROM tk")
def nb_token_counts(spark, d):
    return _nb(spark, d)[0].tokens


@C.add(over("tasks", _NB) + "SELECT task_id, task_type, answer_label, round(score, 4) AS score FROM sc")
def nb_scores(spark, d):
    nb, rows = _nb(spark, d)
    return nb.scores(rows, "task_id").withColumn("score", F.round("score", 4))


@C.add(over("tasks", _NB) + "SELECT task_id, task_type, arg_min(answer_label, (-round(score, 9), answer_label)) AS predicted FROM sc GROUP BY ALL")
def nb_predictions(spark, d):
    nb, rows = _nb(spark, d)
    return nb.predict(rows, "task_id")


@C.add(over("tasks", _NB) + "SELECT task_id, task_type, round(max(score) FILTER (answer_label IN ('yes', 'abnormal') AND (answer_label = 'yes') = (task_type = 'vqa')) - max(score) FILTER (answer_label IN ('no', 'normal') AND (answer_label = 'no') = (task_type = 'vqa')), 4) AS score FROM sc GROUP BY ALL")
def nb_log_odds(spark, d):
    nb, rows = _nb(spark, d)
    return nb.log_odds(rows, "task_id", {"vqa": "yes", "grounded_vqa": "abnormal"}, {"vqa": "no", "grounded_vqa": "normal"}).withColumn("score", F.round("score", 4))


@C.add(over("tasks") + ", p AS (SELECT patient_id, list_sort(list_distinct(list(label) FILTER (label IS NOT NULL))) AS ls FROM t WHERE patient_id IS NOT NULL GROUP BY 1) SELECT len(ls) AS labels, count(*) AS n FROM p GROUP BY 1")
def label_cardinality(spark, d):
    p = tasks(spark, d).where("patient_id is not null").groupBy("patient_id").agg(F.count_distinct("label").alias("labels"))
    return P.counts(p, ["labels"])


@C.add(over("tasks") + ", p AS (SELECT DISTINCT evidence_id AS e, task_type AS l FROM t WHERE evidence_id IS NOT NULL) SELECT a.l AS first, b.l AS second, count(*) AS n FROM p a JOIN p b ON a.e = b.e AND a.l < b.l GROUP BY ALL")
def label_pair_frequency(spark, d):
    """Pairs of task types of one evidence: its few distinct types are gathered, not its rows paired."""
    s = tasks(spark, d).where("evidence_id is not null").groupBy("evidence_id").agg(F.array_sort(F.collect_set("task_type")).alias("s"))
    pair = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    return s.select(F.explode(pair).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def _dup(form: str) -> str:
    return f"SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS members FROM (SELECT doc_id, {form} AS f FROM documents) WHERE f IS NOT NULL WINDOW w AS (PARTITION BY f) QUALIFY members > 1"


@C.add(_dup("text"))
def exact_duplicate_groups(spark, d):
    return P.duplicate_groups(_docs(spark, d), "doc_id", F.col("text"))


@C.add(_dup("trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"))
def normalised_duplicate_groups(spark, d):
    return P.duplicate_groups(_docs(spark, d), "doc_id", X.exact_form(F.col("text")))


@C.add("SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_unique, sum((c > 1)::INT)::BIGINT AS groups, sum(c - 1)::BIGINT AS surplus, round(sum(c - 1)::DOUBLE / sum(c), 6) AS duplicate_rate FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))")
def duplicate_summary(spark, d):
    return P.duplicate_summary(_docs(spark, d), X.squeeze(F.col("text")))


@C.add("SELECT vec_id, min(vec_id) OVER w AS class_id, count(*) OVER w AS members FROM (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding) THEN '1' ELSE '0' END), '') AS h FROM embeddings) WINDOW w AS (PARTITION BY h) QUALIFY members > 1")
def ahash_duplicate_groups(spark, d):
    e = table(spark, d, "embeddings")
    return P.duplicate_groups(e, "vec_id", V.average_hash(F.col("embedding")))


@C.add(r"SELECT rec_id, min(rec_id) OVER w AS class_id, count(*) OVER w AS members FROM (SELECT rec_id, regexp_replace(lower(trim(a_hash)), '^(0x|sha256[:=-])|[\s:]', '', 'g') AS h FROM whole_records) WHERE regexp_full_match(h, '[0-9a-f]{64}') WINDOW w AS (PARTITION BY h) QUALIFY members > 1")
def image_ahash_duplicate_groups(spark, d):
    from ..functions.keys import clean_digest

    return P.duplicate_groups(table(spark, d, "whole_records"), "rec_id", clean_digest("a_hash"))


@C.add("SELECT file, count(*) AS n FROM (SELECT CASE WHEN c = 1 THEN 'single' WHEN c = 2 THEN 'pair' ELSE 'more' END AS file FROM (SELECT count(*) AS c FROM whole_records WHERE sha256 IS NOT NULL GROUP BY regexp_replace(lower(trim(sha256)), '^sha256:', ''))) GROUP BY file")
def file_duplicate_sizes(spark, d):
    from ..functions.keys import clean_digest

    g = table(spark, d, "whole_records").select(clean_digest("sha256").alias("s")).where("s is not null").groupBy("s").agg(F.count("*").alias("c"))
    return P.counts(g.select(F.when(F.col("c") == 1, "single").when(F.col("c") == 2, "pair").otherwise("more").alias("file")), ["file"])


@C.add(f"""WITH w AS (SELECT {category('lang')} AS lang, {_WORDS} AS w FROM documents WHERE trim(text) <> ''), g AS (SELECT lang, 1 AS n, unnest(w) AS gram FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
  p AS (SELECT lang, n, gram, count(*) AS c FROM g GROUP BY ALL) SELECT lang, n_tokens, unique_words, unique_bigrams, unique_trigrams, hapax, round(unique_words::DOUBLE / n_tokens, 6) AS type_token_ratio, round(hapax::DOUBLE / unique_words, 6) AS hapax_ratio FROM (SELECT lang, sum(c) FILTER (n = 1)::BIGINT AS n_tokens, count(*) FILTER (n = 1) AS unique_words, count(*) FILTER (n = 2) AS unique_bigrams, count(*) FILTER (n = 3) AS unique_trigrams, count(*) FILTER (n = 1 AND c = 1) AS hapax FROM p GROUP BY lang)""".replace("sum(c) FILTER (n = 1)::BIGINT", "(sum(c) FILTER (n = 1))::BIGINT"))
def linguistic_profile(spark, d):
    return P.linguistic(_docs(spark, d).withColumn("lang", clean_category("lang")), ["lang"], "text")


_REGIONS = ["left chest", "right chest", "left knee", "right knee", "left ankle", "right ankle", "left elbow", "right elbow", "left shoulder", "right shoulder", "vertebra", "pelvis", "head"]


def _sql_skeleton(col: str) -> str:
    out = rf"' ' || replace(trim(regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}<>\-'']+', ' ', 'g')), ' ', '  ') || ' '"
    swaps = [(r, "<REGION>") for r in _REGIONS] + [(w, "<VIEW>") for w in X.VIEW_WORDS] + [(w, "<CLASS>") for w in X.CLASS_WORDS]
    for w, m in sorted(swaps, key=lambda s: (-len(s[0]), s[0])):
        out = f"replace({out}, ' {w.replace(' ', '  ')} ', ' {m} ')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@C.add(over("tasks") + f"SELECT task_type, {_sql_skeleton('prompt')} AS skeleton, count(*) AS n FROM t WHERE prompt IS NOT NULL GROUP BY ALL")
def masked_skeletons(spark, d):
    return tasks(spark, d).where("prompt is not null").groupBy("task_type", X.skeleton(F.col("prompt"), _REGIONS).alias("skeleton")).agg(F.count("*").alias("n"))


def _sql_question(col: str, grounding: str) -> str:
    norm = rf"trim(regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}<>\-'']+', ' ', 'g'))"
    rules = " ".join(f"WHEN regexp_matches(n, '{p}')" + (f" OR {grounding}" if name == "localization" else "") + f" THEN '{name}'" for name, p in X.QUESTION_RULES)
    return f"(SELECT CASE WHEN coalesce(n, '') = '' THEN 'missing' {rules} ELSE 'other' END FROM (SELECT {norm} AS n))"


@C.add(over("tasks") + f"SELECT task_type, {_sql_question('prompt', 'task_type = ' + chr(39) + 'grounding' + chr(39))} AS question_type, count(*) AS n FROM t GROUP BY ALL")
def question_types(spark, d):
    return tasks(spark, d).groupBy("task_type", X.question_type(F.col("prompt"), F.col("task_type") == "grounding").alias("question_type")).agg(F.count("*").alias("n"))


@C.add("SELECT CASE WHEN regexp_matches(text, '[\\x{3400}-\\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\\x{3400}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END AS hint, count(*) AS n FROM documents GROUP BY 1")
def language_hints(spark, d):
    return P.counts(_docs(spark, d).select(X.language_hint(F.col("text")).alias("hint")), ["hint"])


@C.add("SELECT sum(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')::INT)::BIGINT AS email, sum(regexp_matches(text, '(^|[^0-9])[0-9]{6,}([^0-9]|$)')::INT)::BIGINT AS long_number FROM documents")
def pii_flags(spark, d):
    return _docs(spark, d).agg(*[F.sum(c.cast("long")).alias(n) for n, c in X.pii_flags(F.col("text")).items()])


@C.add(over("tasks") + "SELECT task_id, (SELECT arg_min(r, (-length(r), r)) FROM (SELECT unnest([" + ", ".join(f"'{r}'" for r in _REGIONS) + "]) AS r) WHERE contains(' ' || regexp_replace(lower(prompt), '[^a-z0-9_]+', ' ', 'g') || ' ', ' ' || r || ' ')) AS region FROM t WHERE prompt IS NOT NULL")
def regions_in_prompts(spark, d):
    return tasks(spark, d).where("prompt is not null").select("task_id", X.find_region(F.col("prompt"), _REGIONS).alias("region"))


@C.add(over("tasks") + "SELECT label, view_scope, count(*) AS tasks, count(DISTINCT patient_id) AS patients, bool_or(task_type = 'vqa') AS has_vqa, bool_or(task_type = 'grounding') AS has_grounding, bool_or(task_type = 'grounded_vqa') AS has_grounded, sum(len(targets))::BIGINT AS boxes FROM t GROUP BY ALL")
def coverage_profile(spark, d):
    has = lambda k: F.bool_or(F.col("task_type") == k)
    return tasks(spark, d).groupBy("label", "view_scope").agg(F.count("*").alias("tasks"), F.count_distinct("patient_id").alias("patients"), has("vqa").alias("has_vqa"), has("grounding").alias("has_grounding"), has("grounded_vqa").alias("has_grounded"), F.sum(F.when(F.col("targets").isNotNull(), F.size("targets"))).cast("long").alias("boxes"))


_CROSS = "SELECT '{0}' AS kind, {1} AS value, array_to_string(list_sort(list_distinct(list(split))), '+') AS splits, count(*) AS n FROM {2} WHERE split IS NOT NULL AND {1} IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split) > 1"


@C.add(over("tasks") + " UNION ALL ".join(_CROSS.format(*k) for k in (("patient", "patient_id", "t"), ("evidence", "evidence_id", "t"), ("image", "image", "(SELECT DISTINCT task_id, split, unnest(images).image AS image FROM t)"))))
def split_leakage(spark, d):
    return P.crossing(tasks(spark, d), {"patient": F.col("patient_id"), "evidence": F.col("evidence_id"), "image": F.col("images.image")})


@C.add(f"SELECT p AS patient_id, count(DISTINCT s) AS n_splits, min(s) AS first_split, max(s) AS last_split FROM (SELECT {key('patient_id')} AS p, {split('split')} AS s FROM multitask UNION ALL SELECT {key('patient_id')}, {split('split')} FROM canonical UNION ALL SELECT {key('patient_id')}, {split('split')} FROM patient_splits) WHERE p IS NOT NULL AND s IS NOT NULL GROUP BY p HAVING count(DISTINCT s) > 1")
def split_disagreement(spark, d):
    rows = None
    for t in ("multitask", "canonical", "patient_splits"):
        r = table(spark, d, t).select(clean_key("patient_id").alias("patient_id"), clean_split("split").alias("s")).where("patient_id is not null and s is not null")
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("patient_id").agg(F.count_distinct("s").alias("n_splits"), F.min("s").alias("first_split"), F.max("s").alias("last_split")).where("n_splits > 1")


@C.add(over("tasks") + "SELECT split, answer_label, count(*) AS n, count(*) < 20 AS rare FROM t WHERE split IS NOT NULL AND answer_label IS NOT NULL GROUP BY ALL HAVING count(*) < 200")
def rare_class_warnings(spark, d):
    n = P.counts(tasks(spark, d).where("split is not null and answer_label is not null"), ["split", "answer_label"]).where("n < 200")
    return n.withColumn("rare", F.col("n") < 20)


_KPI = "SELECT unnest([{{'name': 'rows', 'value': count(*)::DOUBLE}}, {{'name': 'null_text', 'value': sum(({c} IS NULL)::INT)::DOUBLE}}, {{'name': 'mean_chars', 'value': round(avg(length({c})), 4)}}, {{'name': 'distinct', 'value': count(DISTINCT {c})::DOUBLE}}]) AS k FROM {t}"


def _kpis(df, c):
    one = df.agg(F.count("*").cast("double").alias("rows"), F.sum(F.col(c).isNull().cast("long")).cast("double").alias("null_text"), F.round(F.avg(F.length(c)), 4).alias("mean_chars"), F.count_distinct(c).cast("double").alias("distinct"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in one.columns])).alias("k")).select("k.*")


@C.add(f"SELECT a.k.name AS name, a.k.value AS first, b.k.value AS second, b.k.value - a.k.value AS difference FROM ({_KPI.format(c='text', t='documents')}) a JOIN ({_KPI.format(c='prompt', t='multitask')}) b ON a.k.name = b.k.name")
def kpi_compare_datasets(spark, d):
    return P.compare(_kpis(_docs(spark, d), "text"), _kpis(table(spark, d, "multitask"), "prompt"))


@C.add(f"SELECT CASE WHEN k.name = 'null_text' THEN 'texts are missing' ELSE 'texts repeat' END AS warning, k.name AS name, k.value AS value FROM ({_KPI.format(c='text', t='documents')}) WHERE (k.name = 'null_text' AND k.value > 0) OR (k.name = 'distinct' AND k.value < 1e9)")
def kpi_warnings(spark, d):
    return P.warnings(_kpis(_docs(spark, d), "text"), [("null_text", ">", 0, "texts are missing"), ("distinct", "<", 1e9, "texts repeat")])


_FP = "SELECT split, sha256(string_agg(dg, '' ORDER BY b)) AS digest, sum(n)::BIGINT AS n FROM (SELECT split, substr(h, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS dg, count(*) AS n FROM (SELECT DISTINCT split, sha256(task_id) AS h FROM t WHERE split IS NOT NULL) GROUP BY ALL) GROUP BY split"


@C.add(over("tasks") + _FP)
def ordered_fingerprint(spark, d):
    return P.fingerprint(tasks(spark, d).where("split is not null").select("split", "task_id"), "task_id", ["split"])


@C.add("SELECT 'lang' AS field, count(lang) AS n FROM documents UNION ALL SELECT 'text', count(text) FROM documents UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'patient_id', count(patient_id) FROM documents")
def non_null_counts(spark, d):
    return N.field_counts(_docs(spark, d).select("lang", "text", "source", "patient_id"))


_BOXES = "coalesce(list_filter(targets, lambda x: len(x.bbox) = 4 AND len(list_filter(x.bbox, lambda v: v IS NULL)) = 0), [])"


@C.add(f"""SELECT schema_version, dataset, record_id, split, task, image_id, NULL::VARCHAR AS image_size, patient_id, question, answer, answer AS answers, {_sql_question("question", "task = 'grounding'")} AS answer_type, boxes, CASE WHEN boxes = '' THEN NULL WHEN contains(lower(coalesce(region, '')), 'whole body') THEN 'whole_body'
  WHEN regexp_matches(lower(coalesce(region, '')), 'lesion|metast|hotspot|focus') THEN 'lesion_or_metastasis' ELSE 'anatomical_region' END AS target_granularity, region, NULL::VARCHAR AS view, row_index FROM (
  SELECT '1.0' AS schema_version, 'own' AS dataset, coalesce(nullif(trim(task_id), ''), 'own:' || row_index) AS record_id, nullif(trim(split), '') AS split, CASE task_type WHEN 'grounded_vqa' THEN 'grounded_vqa' WHEN 'grounding' THEN 'grounding' ELSE 'vqa' END AS task, nullif(trim(images[1].image), '') AS image_id, nullif(trim(patient_id), '') AS patient_id,
    nullif(trim(prompt), '') AS question, coalesce(nullif(trim(answer), ''), nullif(trim(answer_label), ''), nullif(trim(label), '')) AS answer, nullif(trim(label), '') AS region, row_index,
    array_to_string(list_transform({_BOXES}, lambda x: coalesce(x.view, '') || ':' || coalesce(nullif(trim(images[1].image), ''), '') || ':' || array_to_string(list_transform(x.bbox, lambda v: v::BIGINT), ',')), ' ') AS boxes FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS row_index FROM multitask))""")
def standardise_rows(spark, d):
    s = N.standardise(table(spark, d, "multitask").drop("required_outputs"), "own", order=["row_id"])
    part = lambda b: F.concat_ws(":", F.coalesce(F.trim(b["view"]), F.lit("")), F.coalesce(b["image_id"], F.lit("")), F.array_join(F.transform(b["bbox"], lambda v: v.cast("bigint").cast("string")), ","))
    return s.select(*[c for c in s.columns if c not in ("target_boxes", "source", "answers", "image_size")], F.array_join("image_size", "x").alias("image_size"), F.nullif(F.array_join("answers", "|"), F.lit("")).alias("answers"), F.array_join(F.transform("target_boxes", part), " ").alias("boxes"), "source.row_index")


@C.add(over("tasks") + "SELECT coalesce(nullif(trim(answer_label), ''), nullif(trim(regexp_replace(lower(answer), '[^\\p{L}\\p{N}<>\\-'']+', ' ', 'g')), ''), 'missing') AS label, count(*) AS n FROM t GROUP BY 1")
def answer_label_chain(spark, d):
    t = tasks(spark, d)
    return t.groupBy(N.answer_label(t).alias("label")).agg(F.count("*").alias("n"))


_KV = r"regexp_extract(props, '\"k\": *(-?[0-9]+)', 1)"


@C.add(f"SELECT event_type, count(*) AS n, sum(try_cast({_KV} AS BIGINT))::BIGINT AS k_sum, count(DISTINCT try_cast({_KV} AS BIGINT)) AS k_values FROM events GROUP BY 1")
def json_field_counts(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.count_distinct(k).alias("k_values"))


@C.add(None)
def rouge_l_answers(spark, d):
    """Mean ROUGE-L of each answer against the most frequent answer of its task type, region and class."""
    t = tasks(spark, d).where("answer is not null")
    keys = ["task_type", "label", "answer_label"]
    common = P.mode(t.where("split = 'train'"), keys, "answer").select(*keys, F.col("answer").alias("reference"))
    rows = t.where("split = 'test'").join(common, keys)
    return rows.withColumn("r", Q.rouge_l(F.col("reference"), F.col("answer"))).groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("rouge_l"))


def _gram(w: str, n: int) -> str:
    return f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


_HITS = ", ".join(f"sum(coalesce(list_sum(list_transform(list_distinct({_gram('c', n)}), lambda g: least(len(list_filter({_gram('c', n)}, lambda x: x = g)), len(list_filter({_gram('r', n)}, lambda x: x = g))))), 0))::BIGINT AS hit{n}, sum(len({_gram('c', n)}))::BIGINT AS all{n}" for n in (1, 2, 3, 4))
_BLEU = f"""SELECT *, round(CASE WHEN least(hit1, hit2, hit3, hit4) = 0 THEN 0.0 ELSE (CASE WHEN cand_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len::DOUBLE / cand_len) END) * exp((ln(hit1::DOUBLE / all1) + ln(hit2::DOUBLE / all2) + ln(hit3::DOUBLE / all3) + ln(hit4::DOUBLE / all4)) / 4) END, 5) AS bleu
  FROM (SELECT task_type, sum(len(r))::BIGINT AS ref_len, sum(len(c))::BIGINT AS cand_len, {_HITS} FROM rw GROUP BY task_type)"""
_SP = r"string_split_regex(trim(lower({0})), '\s+')"


@C.add(over("tasks", "md AS (SELECT task_type, label, answer_label, arg_min(answer, (-n, answer)) AS reference FROM (SELECT task_type, label, answer_label, answer, count(*) AS n FROM t WHERE split = 'train' AND answer IS NOT NULL GROUP BY ALL) GROUP BY ALL)",
    f"rw AS (SELECT t.task_type, {_SP.format('reference')} AS r, {_SP.format('answer')} AS c FROM t JOIN md ON t.task_type = md.task_type AND t.label = md.label AND t.answer_label = md.answer_label WHERE split = 'test' AND answer IS NOT NULL)")
  + _BLEU)
def bleu_answers(spark, d):
    """Corpus BLEU of answers against the most frequent answer of their task type, region and class, with its counts."""
    t = tasks(spark, d).where("answer is not null")
    keys = ["task_type", "label", "answer_label"]
    common = P.mode(t.where("split = 'train'"), keys, "answer").select(*keys, F.col("answer").alias("reference"))
    return Q.bleu(t.where("split = 'test'").join(common, keys), ["task_type"], F.col("reference"), F.col("answer")).withColumn("bleu", F.round("bleu", 5))


@C.add(None)
def feature_pca_kmeans(spark, d):
    return P.counts(V.pca_clusters(table(spark, d, "embeddings"), "embedding"), ["cluster", "label"])


@C.add(None)
def tfidf_text_clusters(spark, d):
    return V.composition(V.text_clusters(_docs(spark, d).withColumn("source", clean_category("source")), "text"), "cluster", "source")


@C.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def incremental_last_wins(spark, d):
    return last_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "ts"])


@C.add(over("tasks") + f"SELECT task_id FROM t WHERE {unit('done', 'task_id')} % 3 <> 0")
def resume_anti_join(spark, d):
    t = tasks(spark, d).select("task_id")
    done = t.where(F.pmod(hash_bits("done", "task_id", digits=8), F.lit(3)) == 0)
    return t.join(done, "task_id", "left_anti")


@C.add("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@C.add("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL 30 MINUTE GROUP BY user_id")
def session_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))


QUERIES, ORACLE = C.queries, C.sql
