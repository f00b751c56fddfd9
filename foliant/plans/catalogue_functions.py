"""Registered queries over single functions and operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import nested, text
from foliant.operators import metrics, quality, scoring, training
from foliant.plans import dashboard
from foliant.plans.catalogue import _WS, CLASSES, MODELS, _clean, _EXTERNAL, _INTERNAL, _macro, _values, docs, external_predictions, internal_predictions, query

# ---------------------------------------------------------------- text and paths


@query(
    f"SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'), ' ')) AS joined_length, sha256(regexp_replace(regexp_replace(text, '^{_WS}', ''), '{_WS}$', '')) AS stripped_sha, "
    "contains(lower(coalesce(text, '')), 'cuda') AND contains(lower(coalesce(text, '')), 'out of memory') AS out_of_memory FROM documents"
)
def q_text_functions(spark, d):
    c = F.col("text")
    return docs(spark, d, "doc_id", "text").select("doc_id", text.joined_length(c).cast("bigint").alias("joined_length"), F.sha2(text.strip_space(c), 256).alias("stripped_sha"), text.out_of_memory(c).alias("out_of_memory"))


_TYPES = ", ".join(repr(t) for t in text.TEXT_TYPES)


@query(
    r"SELECT *, extension IN (" + _TYPES + r") AS supported FROM (SELECT page_id, lower(regexp_extract(url, '[^\\/.](?:[^\\/]*?)(\.[^.\\/]+)$', 1)) AS extension, "
    r"CASE WHEN starts_with(url, '/') THEN url ELSE '/base/' || url END AS resolved, url AS relative, len(string_split(replace(url, '\', '/'), '/')) AS parts, array_to_string(string_split(replace(url, '\', '/'), '/'), '|') AS place FROM pages)"
)
def q_paths(spark, d):
    c = F.col("url")
    out = spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.extension(c).alias("extension"), text.resolve_path(c, "/base/").alias("resolved"), "url", text.path_order(c).alias("p"))
    return out.select("page_id", "extension", "resolved", text.project_relative(F.col("resolved"), "/base").alias("relative"), F.size("p").cast("bigint").alias("parts"), F.array_join("p", "|").alias("place"), text.supported(c).alias("supported"))


@query("SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_discount * 100) AS percent, printf('%.4f s', l_tax) AS seconds FROM lineitem")
def q_display(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.percent_text(F.col("l_discount")).alias("percent"), text.seconds_text(F.col("l_tax")).alias("seconds"))


@query("SELECT event_id, CAST(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS DOUBLE) AS k, CAST(0.0 AS DOUBLE) AS word FROM events")
def q_numeric(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.concat(F.lit("no number "), "event_type").alias("word"))
    return dashboard.numeric(e, ["k", "word", "absent"])


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de')")
def q_check_labels(spark, d):
    return quality.check_labels(docs(spark, d, "doc_id", "lang"), CLASSES[:3], "lang").select("doc_id", "lang")


# ---------------------------------------------------------------- boxes, payloads, mappings, tokens


def _side(v: str, side: float) -> str:
    return f"CAST(greatest(0, least(1000, round_even(CAST(1000 * ({v}) AS DOUBLE) / {side}, 0))) AS INTEGER)"


@query(
    f"""WITH b AS (SELECT event_id, value AS x1, value AS y1, value + event_id % 5 - 1 AS x2, value + event_id % 7 - 1 AS y2 FROM events),
e AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN '{nested.BOX_SHAPE}' WHEN x2 < x1 OR y2 < y1 THEN '{nested.BOX_ORDER}' END AS error FROM b)
SELECT event_id, error, {", ".join(f"CASE WHEN error IS NULL THEN {_side(v, s)} END AS {v}" for v, s in (("x1", 1200), ("y1", 1600), ("x2", 1200), ("y2", 1600)))} FROM e"""
)
def q_box_checks(spark, d):
    v, n = F.col("value"), F.col("event_id")
    whole = F.array(v, v, v + n % 5 - 1, v + n % 7 - 1)
    box = F.when(n % 11 == 0, F.slice(whole, 1, 3)).otherwise(whole)
    out = spark.read.parquet(f"{d}/events.parquet").select("event_id", nested.normalize_ocr(F.array(F.lit("word")), F.array(box), F.lit(nested.PAGE_WIDTH), F.lit(nested.PAGE_HEIGHT)).alias("o"))
    return out.select("event_id", "o.error", *(F.get(F.get("o.boxes", F.lit(0)), F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))))


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 500.0 ELSE 1000.0 END AS side, string_split_regex(coalesce(text, ''), '{_WS}') AS words FROM conversations),
w AS (SELECT conv_id, turn, side, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM t)
SELECT conv_id, turn, CASE WHEN count(*) FILTER (WHERE word <> '') = 0 THEN '{nested.NO_WORDS}' END AS error, CAST(nullif(count(*) FILTER (WHERE word <> ''), 0) AS INTEGER) AS words,
CAST(sum({_side("i * 10 + length(word)", "side")}) FILTER (WHERE word <> '') AS BIGINT) AS x_total, CAST(sum({_side("i * 5 + 9", 2000)}) FILTER (WHERE word <> '') AS BIGINT) AS y_total FROM w GROUP BY 1, 2, side"""
)
def q_load_ocr(spark, d):
    words = F.split(F.coalesce("text", F.lit("")), text.WHITE)
    boxes = F.transform("words", lambda w, i: F.array(i * 10, i * 5, i * 10 + F.length(w), i * 5 + 9))
    t = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", words.alias("words"))
    json = F.to_json(F.struct("words", boxes.alias("boxes"), F.when(F.col("turn") % 2 == 1, "500").otherwise("wide").alias("image_width")))
    out = t.select("conv_id", "turn", nested.load_ocr(json, F.lit(1000), F.lit(2000)).alias("o"))
    side = lambda i: F.aggregate("o.boxes", F.lit(0).cast("bigint"), lambda s, b: s + F.get(b, F.lit(i)))
    sums = (side(2).alias("x_total"), side(3).alias("y_total"))
    return out.select("conv_id", "turn", "o.error", F.when(F.col("o.error").isNull(), F.size("o.words")).alias("words"), *sums)


@query("SELECT doc_id, lang AS label, 0 AS words, 0 AS boxes, '' AS joined FROM documents")
def q_empty_payload(spark, d):
    empty = nested.empty_payload(F.col("lang"))
    p = docs(spark, d, "doc_id", "lang").select("doc_id", nested.merge_payloads(F.col("lang"), F.array(empty, empty)).alias("p"))
    return p.select("doc_id", "p.label", F.size("p.words").alias("words"), F.size("p.boxes").alias("boxes"), nested.payload_text(F.col("p")).alias("joined"))


@query("SELECT n_regionkey, bool_and(n_nationkey % 10 <> 3) AS consistent, true AS same, CAST(count(*) FILTER (WHERE n_name IN ('FRANCE', 'JAPAN', 'CHINA')) AS INTEGER) AS kept FROM nation GROUP BY 1")
def q_mappings(spark, d):
    named = spark.read.parquet(f"{d}/nation.parquet")
    place, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    maps = named.groupBy("n_regionkey").agg(entries(name, F.col("n_nationkey")).alias("f"), entries(place, F.when(F.col("n_nationkey") % 10 == 3, "odd").otherwise(name)).alias("b"), entries(place, name).alias("g"))
    return maps.select("n_regionkey", nested.mapping_consistent(F.col("f"), F.col("b")).alias("consistent"), nested.mapping_consistent(F.col("f"), F.col("g")).alias("same"), F.size(nested.keep_keys(F.col("f"), ["FRANCE", "JAPAN", "CHINA"])).alias("kept"))


@query(f"SELECT doc_id, len(w) AS tokens, sha256(array_to_string(w, ' ')) AS tokens_sha FROM (SELECT doc_id, CASE WHEN c = '' THEN [] ELSE list_slice(string_split(c, ' '), 1, 512) END AS w FROM (SELECT doc_id, {_clean('text')} AS c FROM documents))")
def q_model_tokens(spark, d):
    """The cut to the model's length is the feature."""
    w = docs(spark, d, "doc_id", "text").select("doc_id", nested.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("tokens"), F.sha2(F.array_join("w", " "), 256).alias("tokens_sha"))


# ---------------------------------------------------------------- scoring, metrics, history


@query("SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0.25 ELSE 0 END AS DOUBLE) AS en, CAST(CASE lang WHEN 'fr' THEN 0.5 ELSE 0 END AS DOUBLE) AS fr, CAST(CASE lang WHEN 'de' THEN 0.5 ELSE 0 END AS DOUBLE) AS de FROM documents")
def q_canonical_probabilities(spark, d):
    """Classes that aren't on the axis are dropped, the last of repeats counts."""
    pair = lambda c, p: F.struct(c.alias("class"), F.lit(p).alias("probability"))
    found = F.array(pair(F.col("lang"), 0.5), pair(F.lit("it"), 0.25), pair(F.when(F.col("lang") == "en", "en").otherwise("none"), 0.25))
    p = docs(spark, d, "doc_id", "lang").select("doc_id", scoring.canonical_probabilities(found, CLASSES[:3]).alias("p"))
    return p.select("doc_id", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(CLASSES[:3])))


@query(
    "WITH r AS (SELECT lang, doc_id / 1024.0 AS s, doc_id % 9 <> 0 AS ok, 'en' AS guess FROM documents) SELECT 'timed' AS model, round(sum(s) FILTER (WHERE ok), 6) AS prediction_time_seconds, round(avg(s) FILTER (WHERE ok), 6) AS seconds_per_document, "
    "count(*) FILTER (WHERE ok) AS documents_processed, count(*) FILTER (WHERE NOT ok) AS documents_failed, round(avg(CASE WHEN lang = guess THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 6) AS accuracy FROM r"
)
def q_metric_times(spark, d):
    own = docs(spark, d, "doc_id", "lang")
    logits = F.array(*(F.lit(1.0 if c == "en" else 0.0) for c in CLASSES))
    r = scoring.records(own, "timed", "doc_id", "lang", logits, CLASSES, F.when(F.col("doc_id") % 9 == 0, "no"), F.col("doc_id") / 1024.0)
    out = metrics.macro_metrics(r, CLASSES, ["timed"])
    return out.select("model", F.round("prediction_time_seconds", 6).alias("prediction_time_seconds"), F.round("seconds_per_document", 6).alias("seconds_per_document"), "documents_processed", "documents_failed", F.round("accuracy", 6).alias("accuracy"))


@query(
    "SELECT l_linenumber AS epoch, round(sum(l_discount * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 6) AS train_loss, round(sum(CAST(l_quantity AS BIGINT) // 2) / sum(CAST(l_quantity AS BIGINT)), 6) AS train_accuracy FROM lineitem GROUP BY 1"
)
def q_weighted_loss(spark, d):
    size = F.col("l_quantity").cast("bigint")
    batches = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("epoch"), F.col("l_discount").alias("loss"), F.floor(size / 2).alias("hits"), size.alias("size"))
    return training.weighted_loss(batches).select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("train_accuracy", 6).alias("train_accuracy"))


@query(
    f"""WITH j AS (SELECT m.model_idx, i.model, i.macro_f1 AS a, e.macro_f1 AS b, i.macro_f1 - e.macro_f1 AS c FROM {_macro(_INTERNAL)} i JOIN {_macro(_EXTERNAL)} e ON e.model = i.model JOIN {_values(MODELS, 'model', 'model_idx')} m ON m.model = i.model)
SELECT 'Best on the internal set: ' || (SELECT model FROM j ORDER BY a DESC, model_idx LIMIT 1) || '. Best on the external set: ' || (SELECT model FROM j ORDER BY b DESC, model_idx LIMIT 1) || '. Smallest drop of macro F1: ' || (SELECT model FROM j ORDER BY c, model_idx LIMIT 1) ||
'. Most sensitive to new sources: ' || (SELECT string_agg(model, ' and ' ORDER BY c DESC, model_idx) FROM (SELECT * FROM j ORDER BY c DESC, model_idx LIMIT 2)) || '.' AS summary"""
)
def q_comparison_sentence(spark, d):
    inside = metrics.macro_metrics(internal_predictions(spark, d), CLASSES, MODELS)
    outside = metrics.macro_metrics(external_predictions(spark, d), CLASSES, MODELS)
    return dashboard.narrative_facts(dashboard.final_comparison(inside, outside, MODELS)).select("summary")


@query("SELECT r.model, EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AND r.model <> 'none' AS available FROM (VALUES ('one'), ('either'), ('none')) r(model)")
def q_availability(spark, d):
    """Region names stand for the files of a model folder."""
    names = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("path"))
    return dashboard.availability(names, {"one": [["ASIA"]], "either": [["ASIA"], ["nowhere", "EUROPE"]], "none": [["ASIA"], ["nowhere"]]})


_GREEDY = "list_reduce(list_transform(string_split(c, ' '), lambda w: {'n': 1, 'cur': length(w), 'best': length(w)}), lambda a, w: CASE WHEN a.cur + 1 + w.cur <= 77 THEN {'n': a.n, 'cur': a.cur + 1 + w.cur, 'best': greatest(a.best, a.cur + 1 + w.cur)} ELSE {'n': a.n + 1, 'cur': w.cur, 'best': greatest(a.best, w.cur)} END)"


@query(f"SELECT doc_id, CASE WHEN c = '' THEN 0 ELSE r.n END AS n_lines, CASE WHEN c <> '' THEN r.best END AS longest FROM (SELECT doc_id, c, {_GREEDY} AS r FROM (SELECT doc_id, {_clean('text')} AS c FROM documents))")
def q_greedy_wrap(spark, d):
    lines = docs(spark, d, "doc_id", "text").select("doc_id", nested.wrap_words(F.col("text"), 77).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.array_max(F.transform("lines", F.length)).alias("longest"))
