"""The registered queries of the document-analytics operators, each with the DuckDB SQL of the same rows.

Roles of the tables: documents is the labelled collection (lang is the class), labels has two binary tasks, pages has HTML,
embeddings stands for image features, conversations for documents of several pages (turns).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import nested, num, subwords, text
from foliant.operators import bayes, dedup, loop, metrics, quality, scoring, split, training
from foliant.operators.tables import dimension
from foliant.plans import dashboard
from foliant.session import shared_dir, ship

CLASSES = ["en", "fr", "de", "es"]
MODELS = ["lexicon", "charset"]
VOCABULARY = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space as in functions.text.WHITE, for DuckDB.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({c}, ''), chr(0), ' '), '{_WS}', ' ', 'g'), ' ')"


def _values(names: list[str], column: str, index: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f"({i + 1}, '{n}')" for i, n in enumerate(names))}) AS t({index}, {column}))"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/documents.parquet")
    return df.select(*columns) if columns else df


# ---------------------------------------------------------------- text and quality


@query(f"SELECT doc_id, sha256(c) AS clean_sha, length(c) AS text_length, sha256(substring(c, 1, 1000)) AS preview_sha FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)")
def q_clean_text(spark, d):
    c = docs(spark, d, "doc_id", "text").withColumn("c", text.clean_text(F.col("text")))
    return c.select("doc_id", F.sha2("c", 256).alias("clean_sha"), F.length("c").cast("bigint").alias("text_length"), F.sha2(text.preview(F.col("c")), 256).alias("preview_sha"))


_HTML = f"trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), chr(0), ' '), '{_WS}', ' ', 'g'), ' ')"


@query(f"SELECT page_id, sha256(c) AS text_sha, length(c) AS text_length FROM (SELECT page_id, {_HTML} AS c FROM pages)")
def q_strip_html(spark, d):
    c = spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.strip_html(F.col("html")).alias("c"))
    return c.select("page_id", F.sha2("c", 256).alias("text_sha"), F.length("c").cast("bigint").alias("text_length"))


@query(f"SELECT doc_id, lang, n AS text_length, CASE WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'short' END AS issue FROM (SELECT doc_id, lang, length({_clean('text')}) AS n FROM documents)")
def q_text_quality_flags(spark, d):
    return quality.with_quality(docs(spark, d, "doc_id", "lang", "text")).select("doc_id", "lang", F.col("text_length").cast("bigint").alias("text_length"), "issue")


@query(
    f"WITH t AS (SELECT lang, length({_clean('text')}) AS n FROM documents) SELECT x.class_idx, x.label, count(t.n) AS documents, CAST(coalesce(sum(CASE WHEN n < 20 THEN 1 ELSE 0 END) FILTER (WHERE n IS NOT NULL), 0) AS BIGINT) AS short_texts, round(coalesce(avg(n), 0.0), 6) AS mean_length "
    f"FROM {_values([*CLASSES, 'it'], 'label', 'class_idx')} x LEFT JOIN t ON t.lang = x.label GROUP BY 1, 2"
)
def q_quality_summary_by_label(spark, d):
    out = quality.summary_by_label(docs(spark, d, "lang", "text"), [*CLASSES, "it"], "lang")
    return out.withColumn("mean_length", F.round("mean_length", 6)).withColumn("documents", F.col("documents").cast("bigint")).withColumn("short_texts", F.col("short_texts").cast("bigint"))


@query(f"SELECT doc_id, lang, n AS text_length FROM (SELECT doc_id, lang, length({_clean('text')}) AS n FROM documents) WHERE n < 20")
def q_failed_extraction_report(spark, d):
    return quality.failed_extraction(docs(spark, d, "doc_id", "lang", "text")).select("doc_id", "lang", F.col("text_length").cast("bigint").alias("text_length"))


@query(
    f"WITH t AS (SELECT d.lang, l.doc_id AS have, length({_clean('d.text')}) AS n FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT issue, count(*) AS documents FROM "
    "(SELECT CASE WHEN lang IS NULL OR lang NOT IN ('en', 'fr', 'de') THEN 'invalid_label' WHEN have IS NULL THEN 'missing_file' WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'short' END AS issue FROM t) WHERE issue IS NOT NULL GROUP BY 1"
)
def q_issue_counts(spark, d):
    have = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(True).alias("have"))
    joined = docs(spark, d, "doc_id", "lang", "text").join(have, "doc_id", "left")
    return quality.issue_counts(quality.issues(joined, CLASSES[:3], "doc_id", "lang", "text", F.coalesce("have", F.lit(False))))


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr', 'de') OR lang IS NULL")
def q_invalid_label_anti(spark, d):
    return quality.invalid_labels(docs(spark, d, "doc_id", "lang"), CLASSES[:3], "lang").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_missing_artifacts(spark, d):
    return quality.missing_artifacts(docs(spark, d, "doc_id"), spark.read.parquet(f"{d}/labels.parquet"), "doc_id")


@query(f"SELECT doc_id AS id, lang AS label, list_position(['en', 'fr', 'de'], lang) - 1 AS label_id, sha256(text) AS text_sha, length(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'), ' ')) AS text_length FROM documents WHERE lang IN ('en', 'fr', 'de')")
def q_prepared_rows(spark, d):
    out = quality.prepared_rows(docs(spark, d, "doc_id", "lang", "text"), CLASSES[:3], "doc_id", "lang", "text")
    return out.select("id", "label", "label_id", F.sha2("text", 256).alias("text_sha"), F.col("text_length").cast("bigint").alias("text_length"))


@query(f"SELECT doc_id, lang, sha256(t) AS text_sha, length(t) AS text_length FROM (SELECT doc_id, lang, CASE WHEN length({_clean('text')}) < 20 THEN 'retried ' || coalesce(text, '') ELSE text END AS t FROM documents)")
def q_retry_upsert(spark, d):
    """Whole texts; the refreshed rows are those of which the extraction failed, and a prefix stands for the new extraction."""
    base = docs(spark, d, "doc_id", "lang", "text")
    fresh = quality.failed_extraction(base).select("doc_id", F.concat(F.lit("retried "), F.coalesce("text", F.lit(""))).alias("text"))
    out = quality.retry(base, fresh, "doc_id", ["text"])
    return out.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"), F.length("text").cast("bigint").alias("text_length"))


# ---------------------------------------------------------------- numbering, splits, duplicates


@query(
    "SELECT doc_id, seq AS sequence, printf('%s_%04d', lang, seq) AS id, 'data/texts/' || lang || '/' || printf('%s_%04d', lang, seq) || '.txt' AS text_path FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) AS seq FROM documents)"
)
def q_surrogate_ids(spark, d):
    out = split.number_by_label(docs(spark, d, "doc_id", "lang", "source"), "lang", [F.col("source"), F.col("doc_id")])
    return out.select("doc_id", F.col("sequence").cast("bigint").alias("sequence"), "id", text.artifact_path("data/texts", F.col("lang"), F.col("id"), ".txt").alias("text_path"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, string_agg(CAST(doc_id AS VARCHAR), ' | ' ORDER BY doc_id) AS paths FROM documents GROUP BY 1")
def q_hash_index(spark, d):
    out = dedup.hash_index(dedup.with_hash(docs(spark, d, "doc_id", "text"), "text").select("doc_id", "sha256"), "doc_id")
    return out.select("sha256", F.size("paths").cast("bigint").alias("copies"), F.array_join(F.transform("paths", lambda p: p.cast("string")), " | ").alias("paths"))


def external_internal(spark, d, *columns: str) -> tuple[DataFrame, DataFrame]:
    """One document in five is external, the others are internal."""
    every = dedup.with_hash(docs(spark, d, "doc_id", "lang", "text"), "text")
    return every.where("doc_id % 5 = 0").select("doc_id", "lang", "sha256", *columns), every.where("doc_id % 5 <> 0").select("doc_id", "sha256")


_KEPT = "(SELECT doc_id, lang, text FROM documents WHERE doc_id % 5 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL))"


@query(f"SELECT doc_id, lang FROM {_KEPT}")
def q_dedup_kept(spark, d):
    return dedup.exclude(*external_internal(spark, d)).select("doc_id", "lang")


@query(
    "WITH i AS (SELECT sha256(text) AS h, string_agg(CAST(doc_id AS VARCHAR), ' | ' ORDER BY doc_id) AS matching_raw_paths FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1) SELECT doc_id, lang, h AS sha256, matching_raw_paths FROM documents JOIN i ON h = sha256(text) WHERE doc_id % 5 = 0"
)
def q_dedup_excluded(spark, d):
    external, internal = external_internal(spark, d)
    return dedup.excluded(external, internal, "doc_id").select("doc_id", "lang", "sha256", "matching_raw_paths")


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM {_KEPT}) WHERE n <= 5")
def q_limit_per_class(spark, d):
    return split.limit_per_class(dedup.exclude(*external_internal(spark, d)), 5, "lang", [F.col("doc_id")]).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 10")
def q_smoke_sample(spark, d):
    return split.sample_per_class(docs(spark, d, "doc_id", "lang"), 10, "lang", "doc_id").select("doc_id", "lang")


_SPLIT = """(WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY lang) AS c FROM documents),
s AS (SELECT *, greatest(1, CAST(floor(CAST(0.70 AS DOUBLE) * c) AS BIGINT)) AS t, greatest(1, CAST(floor(CAST(0.15 AS DOUBLE) * c) AS BIGINT)) AS v FROM r),
u AS (SELECT doc_id, lang, n, CASE WHEN t + v >= c THEN c - 2 ELSE t END AS t, CASE WHEN t + v >= c THEN 1 ELSE v END AS v FROM s)
SELECT doc_id, lang, CASE WHEN n <= t THEN 'train' WHEN n <= t + v THEN 'validation' ELSE 'test' END AS split FROM u)"""


@query(f"SELECT * FROM {_SPLIT}")
def q_stratified_split(spark, d):
    return split.stratified_split(docs(spark, d, "doc_id", "lang"), "lang", "doc_id")


@query(f"SELECT lang, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'validation') AS validation, count(*) FILTER (WHERE split = 'test') AS test FROM {_SPLIT} GROUP BY lang")
def q_split_counts(spark, d):
    return split.split_counts(split.stratified_split(docs(spark, d, "doc_id", "lang"), "lang", "doc_id"), "lang")


@query(f"SELECT doc_id, class_idx, map_extract(MAP {{'1': 'en', '2': 'fr', '3': 'de', '4': 'es'}}, CAST(class_idx AS VARCHAR))[1] AS label FROM documents JOIN {_values(CLASSES, 'lang', 'class_idx')} USING (lang)")
def q_label_lookup(spark, d):
    forward = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.array(*(F.lit(str(i + 1)) for i in range(len(CLASSES)))))
    out = docs(spark, d, "doc_id", "lang").join(F.broadcast(dimension(spark, CLASSES, "lang")), "lang")
    return out.select("doc_id", "class_idx", F.element_at(nested.invert_map(forward), F.col("class_idx").cast("string")).alias("label"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def q_label_join_quality(spark, d):
    return docs(spark, d, "doc_id", "lang").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic"), "doc_id").select("doc_id", "lang", "quality", "toxic")


# ---------------------------------------------------------------- scoring


def kept_texts(spark, d) -> DataFrame:
    """External documents without internal copies; the anti join stands below all scoring."""
    return dedup.exclude(*external_internal(spark, d, "text"))


def predictions(spark, d) -> DataFrame:
    """Both text models over all documents."""
    return scoring.score_texts(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "lang", "text", CLASSES)


def external_predictions(spark, d) -> DataFrame:
    return scoring.score_texts(kept_texts(spark, d), "doc_id", "lang", "text", CLASSES)


def _logits(model: str, c: str) -> list[str]:
    if model == "lexicon":
        words = f"string_split(lower({_clean(c)}), ' ')"
        return [f"CAST(len(list_filter({words}, lambda w: w IN ({', '.join(repr(w) for w in scoring.LEXICON[x])}))) AS DOUBLE)" for x in CLASSES]
    found = "CASE " + " ".join(f"WHEN regexp_matches({c}, '{letters}') THEN '{x}'" for x, letters in scoring.CHARSET) + " ELSE 'en' END"
    return [f"CASE WHEN ({found}) = '{x}' THEN 2.0 ELSE 0.0 END" for x in CLASSES]


def _records(model: str, table: str) -> str:
    logits = ", ".join(f"{e} AS l{i}" for i, e in enumerate(_logits(model, "text")))
    top = "greatest(l0, l1, l2, l3)"
    z = " + ".join(f"exp(l{i} - {top})" for i in range(4))
    p = ", ".join(f"CASE WHEN ok THEN exp(l{i} - {top}) / ({z}) END AS prob_{c}" for i, c in enumerate(CLASSES))
    pick = "CASE " + " ".join(f"WHEN l{i} = {top} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    return (
        f"SELECT '{model}' AS model, doc_id AS document, lang AS true_label, CASE WHEN ok THEN {pick} END AS predicted_label, CASE WHEN ok THEN 1.0 / ({z}) END AS confidence, "
        f"CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT ok THEN 'text is too short' END AS error_message, {p} FROM (SELECT doc_id, lang, length({_clean('text')}) >= 20 AS ok, {logits} FROM {table})"
    )


_PREDICTIONS = f"({_records('lexicon', 'documents')} UNION ALL {_records('charset', 'documents')})"
_EXTERNAL = f"(WITH kept AS MATERIALIZED {_KEPT} {_records('lexicon', 'kept')} UNION ALL {_records('charset', 'kept')})"
_PROBS = ", ".join(f"round(prob_{c}, 6) AS prob_{c}" for c in CLASSES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("document", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"), "status", "error_message", *(F.round(f"prob_{c}", 6).alias(f"prob_{c}") for c in CLASSES))


def _scored(model: str) -> str:
    return f"SELECT document, true_label, predicted_label, round(confidence, 6) AS confidence, status, error_message, {_PROBS} FROM ({_records(model, 'documents')})"


@query(_scored("lexicon"))
def q_score_lexicon(spark, d):
    return _rounded(scoring.score_lexicon(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "lang", "text", CLASSES))


@query(_scored("charset"))
def q_score_charset(spark, d):
    return _rounded(scoring.score_charset(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "lang", "text", CLASSES))


VECTOR_CLASSES = [str(i) for i in range(10)]


@query("""
WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings),
m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS c FROM x GROUP BY 1, 2),
s AS (SELECT x.vec_id, x.label AS truth, m.label, -sum((CAST(v AS DOUBLE) - c) * (CAST(v AS DOUBLE) - c)) AS logit FROM x JOIN m USING (i) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, label) AS n, max(logit) OVER (PARTITION BY vec_id) AS top FROM s)
SELECT vec_id AS document, CAST(any_value(truth) AS VARCHAR) AS true_label, CAST(max(label) FILTER (WHERE n = 1) AS VARCHAR) AS predicted_label, round(1.0 / sum(exp(logit - top)), 6) AS confidence FROM r GROUP BY vec_id
""")
def q_score_centroid(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return scoring.score_centroid(e, "vec_id", "label", "embedding", VECTOR_CLASSES).select("document", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"))


@query(
    f"WITH p AS (SELECT * FROM ({_records('lexicon', 'documents')}) WHERE status = 'success'), l AS (" + " UNION ALL ".join(f"SELECT model, document, {i} AS i, '{c}' AS class, prob_{c} AS p FROM p" for i, c in enumerate(CLASSES)) + ") "
    "SELECT model, document, CAST(row_number() OVER (PARTITION BY model, document ORDER BY p DESC, i) AS INTEGER) AS rank, class, round(p, 6) AS probability FROM l"
)
def q_rank_probabilities(spark, d):
    scored = scoring.score_lexicon(docs(spark, d, "doc_id", "lang", "text"), "doc_id", "lang", "text", CLASSES)
    return scoring.ranked(scored, CLASSES).select("model", "document", F.col("rank").cast("int").alias("rank"), "class", F.round("probability", 6).alias("probability"))


@query(f"SELECT model, document, true_label, predicted_label, round(confidence, 6) AS confidence, status, error_message, {_PROBS} FROM {_PREDICTIONS}")
def q_all_predictions(spark, d):
    p = predictions(spark, d)
    return p.select("model", "document", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"), "status", "error_message", *(F.round(f"prob_{c}", 6).alias(f"prob_{c}") for c in CLASSES))


_AXIS = f"(SELECT model, class_idx, label FROM {_values(MODELS, 'model', 'model_idx')} CROSS JOIN {_values(CLASSES, 'label', 'class_idx')})"


def _confusion(source: str) -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE predicted_label = '{c}') AS {c}" for c in CLASSES)
    return f"SELECT a.model, a.class_idx, a.label AS true_label, {', '.join(f'coalesce({c}, 0) AS {c}' for c in CLASSES)} FROM {_AXIS} a LEFT JOIN (SELECT model, true_label, {cells} FROM {source} WHERE status = 'success' GROUP BY 1, 2) c ON c.model = a.model AND c.true_label = a.label"


@query(_confusion(_PREDICTIONS))
def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(metrics.pair_counts(predictions(spark, d)), CLASSES, MODELS)


_SETS = f"(SELECT *, CASE WHEN document % 5 = 0 THEN 'external' ELSE 'internal' END AS test_set FROM {_PREDICTIONS} WHERE status = 'success')"


@query(
    f"WITH p AS MATERIALIZED {_SETS}, g AS (SELECT DISTINCT test_set, model FROM (SELECT test_set, model FROM p GROUP BY GROUPING SETS ((test_set, model), (test_set), (model), ()))), c AS {_values(CLASSES, 'true_label', 'class_idx')} "
    f"SELECT g.test_set, g.model, c.class_idx, c.true_label, {', '.join(f"(SELECT count(*) FROM p WHERE p.true_label = c.true_label AND predicted_label = '{x}' AND coalesce(g.test_set, p.test_set) = p.test_set AND coalesce(g.model, p.model) = p.model) AS {x}" for x in CLASSES)} FROM g CROSS JOIN c"
)
def q_confusion_by_set(spark, d):
    """Both models over both test sets, with totals, from one pass over the predictions."""
    own = predictions(spark, d).withColumn("test_set", F.when(F.pmod("document", F.lit(5)) == 0, "external").otherwise("internal"))
    return metrics.confusion_by_set(own, CLASSES)


def _class_metrics(source: str) -> str:
    return f"""(WITH p AS (SELECT * FROM {source} WHERE status = 'success'),
c AS (SELECT a.model, a.class_idx, a.label, count(*) FILTER (WHERE p.true_label = a.label AND p.predicted_label = a.label) AS tp, count(*) FILTER (WHERE p.predicted_label = a.label) AS pr, count(*) FILTER (WHERE p.true_label = a.label) AS support
 FROM {_AXIS} a LEFT JOIN p ON p.model = a.model GROUP BY 1, 2, 3),
m AS (SELECT *, {_ratio('tp', 'pr')} AS precision, {_ratio('tp', 'support')} AS recall FROM c)
SELECT model, class_idx, label, precision, recall, {_ratio('2 * precision * recall', 'precision + recall')} AS f1, support FROM m)"""


_ROUND3 = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query(f"SELECT model, class_idx, label, {_ROUND3}, support FROM {_class_metrics(_PREDICTIONS)}")
def q_class_metrics(spark, d):
    out = metrics.class_metrics(metrics.pair_counts(predictions(spark, d)), CLASSES, MODELS)
    return out.select("model", "class_idx", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def _macro(source: str) -> str:
    return f"""(SELECT m.model, m.macro_precision, m.macro_recall, m.macro_f1, {_ratio('hits', 'ok')} AS accuracy, coalesce(ok, 0) AS documents_processed, coalesce(total - ok, 0) AS documents_failed, coalesce(total, 0) AS documents_total FROM
(SELECT model, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM {_class_metrics(source)} GROUP BY 1) m LEFT JOIN
(SELECT model, count(*) FILTER (WHERE status = 'success') AS ok, count(*) AS total, count(*) FILTER (WHERE status = 'success' AND true_label = predicted_label) AS hits FROM {source} GROUP BY 1) c USING (model))"""


_MACRO_ROUND = "round(accuracy, 6) AS accuracy, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, documents_processed, documents_failed, documents_total"


def _macro_select(df: DataFrame) -> DataFrame:
    return df.select("model", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")), *(F.col(c).cast("bigint").alias(c) for c in ("documents_processed", "documents_failed", "documents_total")))


@query(f"SELECT model, {_MACRO_ROUND} FROM {_macro(_PREDICTIONS)}")
def q_macro_metrics(spark, d):
    return _macro_select(metrics.macro_metrics(predictions(spark, d), CLASSES, MODELS))


_BINARY = """(SELECT task AS model, doc_id AS document, CAST(truth AS VARCHAR) AS true_label, CAST(guess AS VARCHAR) AS predicted_label, 'success' AS status FROM (
SELECT 'quality' AS task, doc_id, quality AS truth, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT 'toxic', doc_id, toxic, CASE WHEN regexp_matches(lower(text), 'idiot|scum|trash|clown') THEN 1 ELSE 0 END FROM labels JOIN documents USING (doc_id)))"""


@query(
    f"SELECT x.model, x.label, {_ROUND3}, support FROM (WITH p AS (SELECT * FROM {_BINARY}), a AS (SELECT model, label FROM (VALUES ('quality'), ('toxic')) m(model), (VALUES ('0'), ('1')) l(label)), "
    "c AS (SELECT a.model, a.label, count(*) FILTER (WHERE p.true_label = a.label AND p.predicted_label = a.label) AS tp, count(*) FILTER (WHERE p.predicted_label = a.label) AS pr, count(*) FILTER (WHERE p.true_label = a.label) AS support FROM a LEFT JOIN p ON p.model = a.model GROUP BY 1, 2), "
    f"m AS (SELECT *, {_ratio('tp', 'pr')} AS precision, {_ratio('tp', 'support')} AS recall FROM c) SELECT model, label, precision, recall, {_ratio('2 * precision * recall', 'precision + recall')} AS f1, support FROM m) x"
)
def q_binary_quality_metrics(spark, d):
    both = docs(spark, d, "doc_id", "text", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rude = F.lower("text").rlike("idiot|scum|trash|clown")
    rows = both.select("doc_id", F.inline(F.array(F.struct(F.lit("quality").alias("model"), F.col("quality").cast("string").alias("true_label"), F.when(F.col("n_chars") >= 500, "1").otherwise("0").alias("predicted_label")), F.struct(F.lit("toxic").alias("model"), F.col("toxic").cast("string").alias("true_label"), F.when(rude, "1").otherwise("0").alias("predicted_label")))))
    out = metrics.class_metrics(metrics.pair_counts(rows.withColumn("status", F.lit("success"))), ["0", "1"], ["quality", "toxic"])
    return out.select("model", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


# ---------------------------------------------------------------- comparison, agreement, dashboard


@query(
    f"SELECT m.model_idx, x.model, {_MACRO_ROUND}, CASE WHEN row_number() OVER (ORDER BY macro_f1 DESC, model_idx) = 1 THEN 'best macro F1' ELSE '' END AS tag FROM {_macro(_PREDICTIONS)} x JOIN {_values(MODELS, 'model', 'model_idx')} m ON m.model = x.model"
)
def q_model_comparison(spark, d):
    out = dashboard.model_comparison(metrics.macro_metrics(predictions(spark, d), CLASSES, MODELS), MODELS)
    return out.select("model_idx", *_macro_select(out).columns, "tag").select("model_idx", "model", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1")), *(F.col(c).cast("bigint").alias(c) for c in ("documents_processed", "documents_failed", "documents_total")), "tag")


_INTERNAL = f"(WITH own AS MATERIALIZED (SELECT doc_id, lang, text FROM documents WHERE doc_id % 5 <> 0) {_records('lexicon', 'own')} UNION ALL {_records('charset', 'own')})"


def internal_predictions(spark, d) -> DataFrame:
    return scoring.score_texts(docs(spark, d, "doc_id", "lang", "text").where("doc_id % 5 <> 0"), "doc_id", "lang", "text", CLASSES)


@query(
    f"""WITH j AS (SELECT m.model_idx, i.model, i.accuracy AS internal_accuracy, e.accuracy AS external_accuracy, i.accuracy - e.accuracy AS accuracy_drop, i.macro_f1 AS internal_macro_f1, e.macro_f1 AS external_macro_f1, i.macro_f1 - e.macro_f1 AS macro_f1_drop
FROM {_macro(_INTERNAL)} i JOIN {_macro(_EXTERNAL)} e ON e.model = i.model JOIN {_values(MODELS, 'model', 'model_idx')} m ON m.model = i.model),
r AS (SELECT *, row_number() OVER (ORDER BY internal_macro_f1 DESC, model_idx) AS a, row_number() OVER (ORDER BY external_macro_f1 DESC, model_idx) AS b, row_number() OVER (ORDER BY macro_f1_drop, model_idx) AS c FROM j)
SELECT model_idx, model, round(internal_accuracy, 6) AS internal_accuracy, round(external_accuracy, 6) AS external_accuracy, round(accuracy_drop, 6) AS accuracy_drop, round(internal_macro_f1, 6) AS internal_macro_f1, round(external_macro_f1, 6) AS external_macro_f1, round(macro_f1_drop, 6) AS macro_f1_drop,
concat_ws(', ', CASE WHEN a = 1 THEN 'best internal' END, CASE WHEN b = 1 THEN 'best external' END, CASE WHEN c = 1 THEN 'smallest drop' END) AS tags FROM r"""
)
def q_internal_vs_external(spark, d):
    inside = metrics.macro_metrics(internal_predictions(spark, d), CLASSES, MODELS)
    outside = metrics.macro_metrics(external_predictions(spark, d), CLASSES, MODELS)
    out = dashboard.final_comparison(inside, outside, MODELS)
    return out.select("model_idx", "model", *(F.round(c, 6).alias(c) for c in ("internal_accuracy", "external_accuracy", "accuracy_drop", "internal_macro_f1", "external_macro_f1", "macro_f1_drop")), "tags")


@query(
    f"""WITH j AS (SELECT m.model_idx, i.model, i.macro_f1 AS a, e.macro_f1 AS b, i.macro_f1 - e.macro_f1 AS c FROM {_macro(_INTERNAL)} i JOIN {_macro(_EXTERNAL)} e ON e.model = i.model JOIN {_values(MODELS, 'model', 'model_idx')} m ON m.model = i.model)
SELECT (SELECT model FROM j ORDER BY a DESC, model_idx LIMIT 1) AS best_internal, (SELECT model FROM j ORDER BY b DESC, model_idx LIMIT 1) AS best_external, (SELECT model FROM j ORDER BY c, model_idx LIMIT 1) AS smallest_drop, (SELECT string_agg(model, ' and ' ORDER BY c DESC, model_idx) FROM (SELECT * FROM j ORDER BY c DESC, model_idx LIMIT 2)) AS largest_drops"""
)
def q_comparison_narrative(spark, d):
    inside = metrics.macro_metrics(internal_predictions(spark, d), CLASSES, MODELS)
    outside = metrics.macro_metrics(external_predictions(spark, d), CLASSES, MODELS)
    return dashboard.narrative_facts(dashboard.final_comparison(inside, outside, MODELS)).drop("summary")


@query(f"SELECT document, count(DISTINCT predicted_label) AS answers, count(*) AS models, count(DISTINCT predicted_label) = 1 AS agree FROM {_PREDICTIONS} WHERE status = 'success' GROUP BY 1")
def q_model_agreement(spark, d):
    return metrics.agreement(predictions(spark, d))


@query(f"WITH l AS ({' UNION ALL '.join(f'SELECT document, model, {i + 1} AS class_idx, {c!r} AS class, prob_{c} AS p FROM {_PREDICTIONS} WHERE status = {"success"!r}' for i, c in enumerate(CLASSES))}) SELECT document, class_idx, class, round(coalesce(max(p) FILTER (WHERE model = 'lexicon'), 0.0), 6) AS lexicon, round(coalesce(max(p) FILTER (WHERE model = 'charset'), 0.0), 6) AS charset FROM l GROUP BY 1, 2, 3")
def q_prob_matrix(spark, d):
    out = metrics.probability_matrix(predictions(spark, d), CLASSES, MODELS)
    return out.select("document", "class_idx", "class", *(F.round(m, 6).alias(m) for m in MODELS))


@query(f"SELECT CASE model WHEN 'lexicon' THEN 'Word lists' ELSE model END AS shown, document, true_label, coalesce(predicted_label, '') AS predicted, round(confidence, 6) AS confidence, status FROM {_PREDICTIONS} WHERE true_label IN ('en', 'fr') AND true_label <> coalesce(predicted_label, '')")
def q_prediction_browser(spark, d):
    out = dashboard.browse(predictions(spark, d), {"lexicon": "Word lists"}, labels=["en", "fr"], only_success=False, only_wrong=True)
    return out.select("shown", "document", "true_label", "predicted", F.round("confidence", 6).alias("confidence"), "status")


@query("SELECT DISTINCT lang AS true_label FROM documents")
def q_filter_menu(spark, d):
    return dashboard.menu(docs(spark, d, "lang").withColumnRenamed("lang", "true_label"), "true_label")


@query(f"SELECT m.model_idx, m.model, x.accuracy IS NULL AS missing, coalesce(printf('%.4f', round(x.accuracy, 4)), 'missing') AS accuracy FROM {_values(['lexicon', 'charset', 'neural'], 'model', 'model_idx')} m LEFT JOIN {_macro(_PREDICTIONS)} x ON x.model = m.model")
def q_metrics_missing_placeholder(spark, d):
    out = dashboard.internal_table(metrics.macro_metrics(predictions(spark, d), CLASSES, MODELS), ["lexicon", "charset", "neural"])
    return out.select("model_idx", "model", F.col("accuracy").isNull().alias("missing"), F.when(F.col("accuracy").isNull(), "missing").otherwise(F.format_string("%.4f", F.round("accuracy", 4))).alias("accuracy"))


_CELLS = " UNION ALL ".join(f"SELECT model, true_label, '{c}' AS predicted_label, {c} AS value FROM cm" for c in CLASSES)


@query(
    f"WITH cm AS ({_confusion(_PREDICTIONS)}), l AS ({_CELLS}), t AS (SELECT *, CASE WHEN max(value) OVER (PARTITION BY model) = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) / max(value) OVER (PARTITION BY model) END AS t FROM l) "
    "SELECT model, true_label, predicted_label, value, round(t, 6) AS intensity, CAST(trunc(255 - 170 * t) AS INTEGER) AS red, CAST(trunc(255 - 170 * t) + trunc(35 * (1 - t)) AS INTEGER) AS green, 255 AS blue, CASE WHEN t > 0.65 THEN 'white' ELSE 'black' END AS text_colour FROM t"
)
def q_heatmap_cells(spark, d):
    out = metrics.heatmap_cells(metrics.confusion_matrix(metrics.pair_counts(predictions(spark, d)), CLASSES, MODELS), CLASSES)
    return out.select("model", "true_label", "predicted_label", "value", F.round("intensity", 6).alias("intensity"), "red", "green", "blue", "text_colour")


@query("SELECT model, round(avg(-ln(CASE true_label " + " ".join(f"WHEN '{c}' THEN prob_{c}" for c in CLASSES) + f" END)), 6) AS loss, count(*) AS documents FROM {_PREDICTIONS} WHERE status = 'success' GROUP BY 1")
def q_log_loss(spark, d):
    return metrics.log_loss(predictions(spark, d), CLASSES).select("model", F.round("loss", 6).alias("loss"), "documents")


@query(f"SELECT model, class_idx, label, {_ROUND3}, support, round(100 * f1, 4) AS f1_percent FROM {_class_metrics(_PREDICTIONS)} WHERE model = 'lexicon'")
def q_class_detail(spark, d):
    out = dashboard.class_detail(metrics.class_metrics(metrics.pair_counts(predictions(spark, d)), CLASSES, MODELS), "lexicon")
    return out.select("model", "class_idx", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support", F.round("f1_percent", 4).alias("f1_percent"))


@query(f"WITH p AS (SELECT * FROM {_PREDICTIONS} WHERE status = 'success'), m AS (SELECT model, avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY 1) SELECT model, 'accuracy' AS measure, round(100 * accuracy, 4) AS percent FROM m")
def q_chart_unpivot(spark, d):
    out = dashboard.chart_rows(metrics.macro_metrics(predictions(spark, d), CLASSES, MODELS), ["accuracy"])
    return out.select("model", "measure", F.round("percent", 4).alias("percent"))


_SHARE = f"SELECT predicted_label AS class, count(*) / sum(count(*)) OVER () AS p FROM {_PREDICTIONS} WHERE status = 'success' AND model = "


@query(f"SELECT class, round(coalesce(a.p, 0.0), 6) AS first, round(coalesce(b.p, 0.0), 6) AS second FROM ({_SHARE}'lexicon' GROUP BY 1) a FULL JOIN ({_SHARE}'charset' GROUP BY 1) b USING (class)")
def q_two_model_outer(spark, d):
    """From one pass over the predictions of both models."""
    out = metrics.compare_shares(predictions(spark, d), "lexicon", "charset")
    return out.select("class", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


# ---------------------------------------------------------------- boxes, payloads, wrapping


def word_box(position: Column, word: Column) -> list[Column]:
    """The corners, from 0 to 1000, of a word on a page of twelve words a line."""
    left, top = position % 12 * 90 + 60, F.floor(position / 12).cast("int") * 36 + 60
    return nested.scaled_corners([left, top, left + F.length(word) * 7, top + 28], F.lit(nested.PAGE_WIDTH), F.lit(nested.PAGE_HEIGHT))


@query(
    f"""WITH w AS (SELECT doc_id, unnest(string_split(c, ' ')) AS word, unnest(range(0, len(string_split(c, ' ')))) AS i FROM (SELECT doc_id, {_clean('text')} AS c FROM documents) WHERE c <> ''),
b AS (SELECT doc_id, i, word, (i % 12) * 90 + 60 AS x1, (i // 12) * 36 + 60 AS y1, (i % 12) * 90 + 60 + 7 * length(word) AS x2, (i // 12) * 36 + 88 AS y2 FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS position, word, CAST(greatest(0, least(1000, round_even(CAST(1000 * x1 AS DOUBLE) / 1200, 0))) AS INTEGER) AS x1, CAST(greatest(0, least(1000, round_even(CAST(1000 * y1 AS DOUBLE) / 1600, 0))) AS INTEGER) AS y1, CAST(greatest(0, least(1000, round_even(CAST(1000 * x2 AS DOUBLE) / 1200, 0))) AS INTEGER) AS x2, CAST(greatest(0, least(1000, round_even(CAST(1000 * y2 AS DOUBLE) / 1600, 0))) AS INTEGER) AS y2 FROM b"""
)
def q_word_boxes(spark, d):
    """Words become rows first; the corners are plain columns then."""
    words = docs(spark, d, "doc_id", "text").select("doc_id", F.posexplode(nested.tokens(F.col("text"), None)).alias("position", "word"))
    corners = word_box(F.col("position"), F.col("word"))
    return words.select("doc_id", "position", "word", *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))


@query(
    f"""SELECT conv_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS words, sha256(string_agg(c, ' ' ORDER BY turn) FILTER (WHERE c <> '')) AS text_sha FROM
(SELECT conv_id, turn, {_clean('text')} AS c, CASE WHEN {_clean('text')} = '' THEN 0 ELSE len(string_split({_clean('text')}, ' ')) END AS n FROM conversations) GROUP BY 1"""
)
def q_ocr_payload_merge(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("int").alias("page"), F.split(F.coalesce("text", F.lit("")), text.WHITE).alias("raw"))
    zero = F.transform("raw", lambda w: F.lit(0))
    page = turns.withColumn("payload", nested.assemble_payload(F.lit("page"), F.col("raw"), zero, zero, F.transform("raw", F.length), F.transform("raw", lambda w: F.lit(10)), F.transform("raw", lambda w: F.lit("96.5")), F.col("page")))
    pages = page.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("page", "payload"))).alias("p"))
    whole = pages.select("conv_id", F.size("p").cast("bigint").alias("pages"), nested.merge_payloads(F.lit("page"), F.transform("p", lambda x: x["payload"])).alias("m"))
    return whole.select("conv_id", "pages", F.size("m.words").cast("bigint").alias("words"), F.sha2(nested.payload_text(F.col("m")), 256).alias("text_sha"))


# ---------------------------------------------------------------- models as tables


def _bayes_sql(model: str, words: str) -> str:
    """Records of a naive Bayes model over the rows (doc_id, w) of ``words``, trained on the documents of split train."""
    split_of = f"(SELECT s.doc_id, s.lang, s.split FROM {_SPLIT} s)"
    logits = ", ".join(f"p{i} + sum(CASE WHEN w IS NULL THEN 0.0 ELSE k * ln((coalesce(c{i}, 0) + 1.0) / (n{i} + v)) END) AS l{i}" for i in range(4))
    top, z = "greatest(l0, l1, l2, l3)", " + ".join(f"exp(l{i} - greatest(l0, l1, l2, l3))" for i in range(4))
    p = ", ".join(f"CASE WHEN ok THEN round(exp(l{i} - {top}) / ({z}), 6) END AS prob_{c}" for i, c in enumerate(CLASSES))
    pick = "CASE " + " ".join(f"WHEN l{i} = {top} THEN '{c}'" for i, c in enumerate(CLASSES)) + " END"
    return (
        f"WITH s AS MATERIALIZED {split_of}, w AS MATERIALIZED ({words}), "
        f"c AS MATERIALIZED (SELECT w, {', '.join(f"count(*) FILTER (WHERE lang = '{x}') AS c{i}" for i, x in enumerate(CLASSES))} FROM w JOIN s USING (doc_id) WHERE split = 'train' AND w IS NOT NULL GROUP BY 1), "
        f"n AS (SELECT count(*) AS v, {', '.join(f'sum(c{i}) AS n{i}' for i in range(4))} FROM c), "
        f"d AS (SELECT {', '.join(f"ln((count(*) FILTER (WHERE lang = '{x}') + 1.0) / (count(*) + 4.0)) AS p{i}" for i, x in enumerate(CLASSES))} FROM s WHERE split = 'train'), "
        f"k AS (SELECT doc_id, w, count(*) AS k FROM w GROUP BY ALL), "
        f"l AS (SELECT doc_id, {logits} FROM k LEFT JOIN c USING (w) CROSS JOIN n CROSS JOIN d GROUP BY doc_id, p0, p1, p2, p3) "
        f"SELECT '{model}' AS model, doc_id AS document, lang AS true_label, CASE WHEN ok THEN {pick} END AS predicted_label, CASE WHEN ok THEN round(1.0 / ({z}), 6) END AS confidence, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, "
        f"CASE WHEN NOT ok THEN 'text is too short' END AS error_message, {p} FROM l JOIN (SELECT doc_id, lang, length({_clean('text')}) >= 20 AS ok FROM documents) USING (doc_id)"
    )


_WORDS_OF = f"SELECT doc_id, unnest(CASE WHEN c = '' THEN [NULL] ELSE string_split(c, ' ') END) AS w FROM (SELECT doc_id, lower({_clean('text')}) AS c FROM documents)"
_GRID_OF = (
    f"SELECT doc_id, CASE WHEN word IS NOT NULL THEN ((x1 + x2) * 4 // 2002) || ':' || ((y1 + y2) * 4 // 2002) || ':' || lower(right(word, 2)) END AS w FROM (SELECT doc_id, word, CAST(greatest(0, least(1000, round_even(CAST(1000 * (i % 12 * 90 + 60) AS DOUBLE) / 1200, 0))) AS BIGINT) AS x1, "
    "CAST(greatest(0, least(1000, round_even(CAST(1000 * (i // 12 * 36 + 60) AS DOUBLE) / 1600, 0))) AS BIGINT) AS y1, CAST(greatest(0, least(1000, round_even(CAST(1000 * (i % 12 * 90 + 60 + 7 * length(word)) AS DOUBLE) / 1200, 0))) AS BIGINT) AS x2, "
    "CAST(greatest(0, least(1000, round_even(CAST(1000 * (i // 12 * 36 + 88) AS DOUBLE) / 1600, 0))) AS BIGINT) AS y2 FROM "
    f"(SELECT doc_id, unnest(CASE WHEN c = '' THEN [NULL] ELSE string_split(c, ' ') END) AS word, unnest(CASE WHEN c = '' THEN [0] ELSE range(0, len(string_split(c, ' '))) END) AS i FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)))"
)


def bayes_records(spark, d, name: str, features: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Records of all documents by a naive Bayes model that learns from those of split train. features: rows of doc_id, text and lang as
    rows of doc_id, lang and a list of features."""
    ship(spark)
    own = docs(spark, d, "doc_id", "lang", "text")
    train = split.stratified_split(docs(spark, d, "doc_id", "lang"), "lang", "doc_id").where("split = 'train'").select("doc_id", "lang")
    model = bayes.fit(features(own.join(train.select("doc_id"), "doc_id", "left_semi")), "lang", train, CLASSES)
    short = F.when(text.clean_length(F.col("text")) < text.MIN_CHARS, scoring.SHORT)
    scored = own.select("doc_id", "lang", short.alias("error")).join(bayes.scores(features(own), "doc_id", model), "doc_id")
    out = scoring.records(scored, name, "doc_id", "lang", F.col("scores"), CLASSES, F.col("error"))
    return _rounded(out).select(F.lit(name).alias("model"), "*")


@query(_bayes_sql("bayes", _WORDS_OF))
def q_score_bayes(spark, d):
    """The text model: naive Bayes over the words of whole texts."""
    return bayes_records(spark, d, "bayes", lambda df: bayes.word_lists(df, "doc_id", "text", "lang"))


def grid_lists(df: DataFrame) -> DataFrame:
    """(doc_id, lang, feature): for each text the list of ``bayes.grid_feature`` of its words in the boxes of ``word_box``, empty for a text without
    words; in Arrow batches, which name each cell and end once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            n, words = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
            offsets = np.concatenate(([0], np.cumsum(n)))
            position = np.arange(len(words)) - np.repeat(offsets[:-1], n)
            left, top = position % 12 * 90 + 60, position // 12 * 36 + 60
            right, low = left + pc.utf8_length(words).to_numpy(zero_copy_only=False) * 7, top + 28
            scale = lambda v, side: np.clip(np.rint(v * 1000.0 / side), 0, 1000)
            at = lambda u, v, side: np.floor((scale(u, side) + scale(v, side)) * 4 / 2002).astype(np.int64)
            ends = pc.utf8_slice_codeunits(words, start=-2, stop=None).dictionary_encode()
            code = (ends.indices.to_numpy(zero_copy_only=False) * 4 + at(left, right, nested.PAGE_WIDTH)) * 4 + at(top, low, nested.PAGE_HEIGHT)
            used, place = np.unique(code, return_inverse=True)
            last = [x.lower() for x in ends.dictionary.to_pylist()]
            names = pa.array([f"{c // 4 % 4}:{c % 4}:{last[c // 16]}" for c in used.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(place)))], ["doc_id", "lang", "feature"])

    return df.select("doc_id", "lang", nested.tokens(F.col("text"), None)).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang string, feature array<string>")


@query(_bayes_sql("layout", _GRID_OF))
def q_score_layout(spark, d):
    """The layout model: naive Bayes over the ends of words in the cells of a grid over the page."""
    return bayes_records(spark, d, "layout", grid_lists)


# ---------------------------------------------------------------- model inputs


@query(None)
def q_subword_tokens(spark, d):
    """The model input of every whole text: ids between a first and a last token; the cut to 512 is the feature, all_tokens is before it."""
    ship(spark)
    path = public_tokenizers.path(VOCABULARY)
    own = subwords.subword_tokens(docs(spark, d, "doc_id", "text"), path, longest=None).select("doc_id", "tokens")
    kept = F.when(F.size("tokens") <= subwords.LONGEST, F.col("tokens")).otherwise(F.concat(F.slice("tokens", 1, subwords.LONGEST - 1), F.slice("tokens", -1, 1)))
    return own.select("doc_id", F.size("tokens").cast("bigint").alias("all_tokens"), F.size(kept).cast("bigint").alias("tokens"), F.sha2(F.array_join(kept, ","), 256).alias("ids_sha"))


def _first_ids():
    """A batch model that stands in for a neural one: shares of the ids by class of their remainder, over padded inputs."""
    import numpy as np

    def score(rows):
        ids, mask = subwords.padded([np.array(r, np.int32) for r in rows], 0)
        return [[float(((i % len(CLASSES) == c) * m).sum()) / max(1, int(m.sum())) for c in range(len(CLASSES))] for i, m in zip(ids, mask, strict=True)]

    return score


@query(None)
def q_batch_inference(spark, d):
    """A provider that takes padded batches of subword ids, over all documents."""
    ship(spark)
    own = subwords.subword_tokens(docs(spark, d, "doc_id", "lang", "text"), public_tokenizers.path(VOCABULARY))
    scored = scoring.score_provider(own, scoring.Provider("batch", _first_ids, 8), "doc_id", "lang", "tokens", CLASSES)
    return scored.select("model", "document", "predicted_label", F.round("confidence", 6).alias("confidence"), "status", "error_message")


# ---------------------------------------------------------------- history, JSON, failures, models

def training_run(spark, d) -> tuple[DataFrame, loop.Run]:
    """The feature rows of all documents, split by language, and a training loop over them. A mini-batch is a sixteenth of the training rows
    (64 at least), so that an epoch has as many steps at every size."""
    ship(spark)
    own = split.stratified_split(docs(spark, d, "doc_id", "lang", "text").where(F.col("lang").isNotNull()), "lang", "doc_id")
    settings = loop.Settings()
    place = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    loop.features(own, "doc_id", "lang", "text", "split", CLASSES, settings.dim).write.parquet(place)
    rows = spark.read.schema(loop.FEATURES).parquet(place)
    size = max(settings.batch, -(-rows.where("split = 'train'").count() // 16))
    return rows, loop.train(rows, CLASSES, replace(settings, batch=size))


@query(None)
def q_training_history(spark, d):
    """One row of measures for each epoch of the training loop over documents."""
    _, run = training_run(spark, d)
    return run.table(spark)


@query(None)
def q_best_epoch(spark, d):
    """Which epochs of the training loop over documents wrote the checkpoint."""
    _, run = training_run(spark, d)
    return training.best_epochs(run.table(spark)).select("epoch", F.col("validation_macro_f1").alias("f1"), "improved")


@query(None)
def q_early_stop(spark, d):
    """When the training loop over documents stops."""
    _, run = training_run(spark, d)
    return training.early_stop(run.table(spark)).select("epoch", "improved", "stale")


@query(None)
def q_trained_test_metrics(spark, d):
    """The best checkpoint of the training loop, loaded again and judged on the test documents."""
    rows, run = training_run(spark, d)
    weights, _ = loop.load_weights(spark, run.best, CLASSES)
    names = F.array(*map(F.lit, CLASSES))
    scored = loop.predict(rows.where("split = 'test'"), weights).select("document", names[F.col("y")].alias("lang"), "scores")
    return _macro_select(metrics.macro_metrics(scoring.records(scored, "loop", "document", "lang", F.col("scores"), CLASSES), CLASSES, ["loop"]))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS DOUBLE) AS k_number, len(json_keys(props)) AS fields FROM events")
def q_json_props(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), num.lenient_double(F.get_json_object("props", "$.k")).alias("k_number"), F.size(F.json_object_keys("props")).cast("bigint").alias("fields"))


_FAIL = "SELECT doc_id AS document, lang AS true_label, "


@query(
    "SELECT 'row' AS model, doc_id AS document, lang AS true_label, CASE WHEN doc_id % 7 <> 0 THEN 'en' END AS predicted_label, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: bad document' END AS error_message FROM documents "
    "UNION ALL SELECT 'load', doc_id, lang, NULL, 'failed', 'OSError: no weights' FROM documents"
)
def q_failure_capture(spark, d):
    own = docs(spark, d, "doc_id", "lang")
    one = scoring.score_provider(own, scoring.Provider("row", _picky_model), "doc_id", "lang", "doc_id", CLASSES)
    two = scoring.score_provider(own, scoring.Provider("load", _missing_model), "doc_id", "lang", "doc_id", CLASSES)
    return one.unionByName(two).select("model", "document", "true_label", "predicted_label", "status", "error_message")


def _picky_model():
    def score(x):
        if int(x) % 7 == 0:
            raise ValueError("bad document")
        return [1.0, 0.0, 0.0, 0.0]

    return score


def _missing_model():
    raise OSError("no weights")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External evaluation: hash, anti join, short texts failed, two scorers, metrics by model in model order."""
    return dashboard.model_comparison(metrics.macro_metrics(external_predictions(spark, sf_dir), CLASSES, MODELS), MODELS)


@query(
    f"SELECT m.model_idx, x.model, {_MACRO_ROUND}, CAST(0.0 AS DOUBLE) AS prediction_time_seconds, CAST(0.0 AS DOUBLE) AS seconds_per_document, CASE WHEN row_number() OVER (ORDER BY macro_f1 DESC, model_idx) = 1 THEN 'best macro F1' ELSE '' END AS tag FROM {_macro(_EXTERNAL)} x JOIN {_values(MODELS, 'model', 'model_idx')} m ON m.model = x.model"
)
def q_external_evaluation(spark, d):
    out = flagship(spark, d)
    return out.select(*(F.round(c, 6).alias(c) if c in ("accuracy", "macro_precision", "macro_recall", "macro_f1") else c for c in out.columns))
