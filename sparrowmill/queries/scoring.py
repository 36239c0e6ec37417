"""Scores of consecutive turns and of consecutive event documents; prompts and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.functions.text import first_number, number_value, render_prompt, trim_u
from sparrowmill.operators import json_scores, quota, scores
from sparrowmill.plans import jobs
from sparrowmill.queries.tables import registry, rounded, table

QUERIES, query = registry()


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as prediction, with the next one of its conversation as reference."""
    c = table(spark, sf, "conversations")
    nxt = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("reference"))
    key = F.concat_ws("/", "conv_id", "turn").alias("sample_id")
    return c.join(nxt, (c["conv_id"] == nxt["c2"]) & (c["turn"] == nxt["t2"])).select(key, "role", F.col("text").alias("prediction"), "reference", F.when(F.col("text").isNull(), "no text").alias("error"))


_TURNS = r"""t AS (
  SELECT a.conv_id || '/' || a.turn AS sample_id, a.role, regexp_replace(a.text, '^\s+|\s+$', '', 'g') AS p, regexp_replace(coalesce(b.text, 'None'), '^\s+|\s+$', '', 'g') AS r
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
_SCORED = rf"""WITH {_TURNS}, c AS (SELECT *, list_distinct(regexp_extract_all(p, '(?s).')) AS pc, list_distinct(regexp_extract_all(r, '(?s).')) AS rc FROM t),
s AS (SELECT sample_id, role, CAST(p = r AS INT)::DOUBLE AS exact_match, CAST(contains(p, r) AS INT)::DOUBLE AS contains_,
  CASE WHEN len(pc) = 0 AND len(rc) = 0 THEN 1.0 WHEN len(list_intersect(pc, rc)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(pc, rc)) / (len(pc) + len(rc)) END AS char_f1 FROM c WHERE p IS NOT NULL)"""


@query(_SCORED + """ SELECT role AS group_value, count(*) AS n, round(avg(exact_match), 6) AS exact_match, round(avg(contains_), 6) AS "contains", round(avg(char_f1), 6) AS char_f1
FROM s GROUP BY GROUPING SETS ((), (role)) HAVING grouping(role) = 1 OR role IS NOT NULL""")
def turn_scores_by_role(spark: SparkSession, sf: str) -> DataFrame:
    names = ["exact_match", "contains", "char_f1"]
    return rounded(scores.by_group(scores.score_rows(turns(spark, sf), names), names, "role").drop("whole"), *names)


@query(_SCORED + """ SELECT count(*) AS total, count(*) AS valid, CAST(0 AS BIGINT) AS errors, false AS all_failed, round(avg(char_f1), 6) AS char_f1, CAST(floor(sum(char_f1)) AS BIGINT) AS char_f1_correct FROM s""")
def turn_score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores.summarise(scores.score_rows(turns(spark, sf), ["char_f1"]), ["char_f1"]), "char_f1")


def _bleu_of(pairs: str, key: str) -> str:
    """SQL of (key, bleu1 .. bleu4, bleu) of a table of texts p and r, as common table expressions ending in w."""
    grams = "UNION ALL ".join(f"SELECT {key}, {n} AS n, '{s}' AS s, CASE WHEN length({s}) < {n} THEN {s} ELSE substr({s}, CAST(i AS INT), {n}) END AS g FROM {pairs}, unnest(range(1, greatest(length({s}) - {n} + 1, 1) + 1)) AS u(i) WHERE length({s}) > 0 " for n in range(1, 5) for s in ("p", "r"))
    return f"""g AS ({grams}), k AS (SELECT {key}, n, g, count(*) FILTER (s = 'p') AS cp, count(*) FILTER (s = 'r') AS cr FROM g GROUP BY ALL),
b AS (SELECT {key}, n, sum(least(cp, cr)) / nullif(sum(cp), 0) AS v FROM k GROUP BY ALL),
v AS (SELECT t.{key}, {', '.join(f'coalesce(max(v) FILTER (n = {n}), 0) AS bleu{n}' for n in range(1, 5))}, any_value(length(p)) AS lp, any_value(length(r)) AS lr FROM {pairs} t LEFT JOIN b USING ({key}) GROUP BY t.{key}),
w AS (SELECT {key}, bleu1, bleu2, bleu3, bleu4, least(1, exp(1 - lr / greatest(lp, 1))) * exp(({' + '.join(f'ln(greatest(bleu{n}, 1e-10))' for n in range(1, 5))}) / 4) AS bleu FROM v)"""


_BLEU_NAMES = ["bleu1", "bleu2", "bleu3", "bleu4", "bleu"]


@query(f"WITH {_TURNS}, {_bleu_of('t', 'sample_id')} SELECT sample_id, {', '.join(f'round({n}, 6) AS {n}' for n in _BLEU_NAMES)} FROM w")
def turn_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scores.char_bleu(turns(spark, sf), "sample_id"), "bleu1", "bleu2", "bleu3", "bleu4", "bleu")


def documents_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's props, in text for some types, against those of the user's event before."""
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("reference", before).where("reference is not null")
    said = F.when(F.col("event_type") == "view", F.concat(F.lit("it is "), "props", F.lit(" so"))).when(F.col("event_type") == "error", F.lit("lost")).otherwise(F.col("props"))
    return e.select("event_id", "event_type", said.alias("prediction"), "reference")


_EVENTS = """WITH e AS (SELECT event_id, event_type, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(json_extract_string(props, '$.k') = json_extract_string(r, '$.k') AS INT)::DOUBLE END AS v FROM e WHERE r IS NOT NULL)"""


#: The six metrics by name.
SIX = ["exact_match", "contains", "json_accuracy", "json_exact_match", "char_f1", "bleu"]
_SIX_MEANS = ", ".join(f'round(avg({n}), 6) AS "{n}"' for n in [*SIX, *_BLEU_NAMES[:4]])
_SIX_OF = """f AS (SELECT *, list_distinct(regexp_extract_all(p, '(?s).')) AS pc, list_distinct(regexp_extract_all(r, '(?s).')) AS rc FROM t),
a AS (SELECT f.*, CAST(p = r AS INT)::DOUBLE AS exact_match, CAST(contains(p, r) AS INT)::DOUBLE AS "contains", CASE WHEN len(pc) = 0 AND len(rc) = 0 THEN 1.0 WHEN len(list_intersect(pc, rc)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(pc, rc)) / (len(pc) + len(rc)) END AS char_f1, w.* EXCLUDE (sample_id) FROM f JOIN w USING (sample_id))"""


def _evaluated(spark: SparkSession, pairs: DataFrame, group: str) -> DataFrame:
    """Mean scores by all six metrics, overall and by group, of (sample_id, prediction, reference, error, group)."""
    samples = pairs.select("sample_id", group, F.coalesce("reference", F.lit("None")).alias("output"))
    found = jobs.evaluate(samples, pairs.select("sample_id", "prediction", "error"), SIX, group)
    return rounded(found.groups.drop("whole"), *SIX, *_BLEU_NAMES[:4])


@query(f"""WITH {_TURNS.replace('t AS (', 'every AS (')}, t AS (SELECT * FROM every WHERE p IS NOT NULL), {_bleu_of('t', 'sample_id')}, {_SIX_OF}
SELECT role AS group_value, count(*) AS n, {_SIX_MEANS} FROM (SELECT *, exact_match AS json_accuracy, exact_match AS json_exact_match FROM a) GROUP BY GROUPING SETS ((), (role)) HAVING grouping(role) = 1 OR role IS NOT NULL""")
def evaluate_by_role(spark: SparkSession, sf: str) -> DataFrame:
    """All six metrics of each turn against the next; prose is no JSON, so its metrics compare texts."""
    return _evaluated(spark, turns(spark, sf), "role")


@query(f"""WITH e AS (SELECT event_id AS sample_id, event_type, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, props FROM events),
t AS (SELECT sample_id, event_type, r, CASE event_type WHEN 'view' THEN 'it is ' || props || ' so' WHEN 'error' THEN 'lost' ELSE props END AS p, json_extract_string(props, '$.k') = json_extract_string(r, '$.k') AS same FROM e WHERE r IS NOT NULL), {_bleu_of('t', 'sample_id')}, {_SIX_OF}
SELECT event_type AS group_value, count(*) AS n, {_SIX_MEANS} FROM (SELECT *, CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(same AS INT)::DOUBLE END AS json_accuracy, json_accuracy AS json_exact_match FROM a) GROUP BY GROUPING SETS ((), (event_type))""")
def evaluate_events(spark: SparkSession, sf: str) -> DataFrame:
    """All six metrics of each event's document against the one before it, by event type."""
    pairs = documents_of_events(spark, sf).withColumnRenamed("event_id", "sample_id").withColumn("error", F.lit(None).cast("string"))
    return _evaluated(spark, pairs, "event_type")


@query(_EVENTS + " SELECT event_id, v AS json_accuracy FROM s")
def event_json_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return json_scores.json_accuracy(documents_of_events(spark, sf), "event_id")


@query(_EVENTS + " SELECT 'k' AS field, round(avg(v), 6) AS score, count(*) AS n FROM s WHERE event_type <> 'error'")
def event_field_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(json_scores.field_accuracy(json_scores.json_field_scores(documents_of_events(spark, sf), "event_id")), "score")


@query(_EVENTS + " SELECT event_id, v AS json_exact_match FROM s")
def event_json_exact(spark: SparkSession, sf: str) -> DataFrame:
    return json_scores.json_exact_match(documents_of_events(spark, sf), "event_id")


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE lang END AS i, regexp_replace(coalesce(text, 'None'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN i <> '' THEN '<|im_start|>user' || chr(10) || i || chr(10) || t || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE t END) AS prompt_md5 FROM d""")
def document_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(render_prompt(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.col("text"), "chatml")).alias("prompt_md5"))


@query(r"""SELECT event_id, event_type AS label, CAST(u.i AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS text, event_type = 'click' AS is_sarcastic
FROM events, unnest(CASE WHEN event_type = 'error' THEN []::INT[] ELSE [1, 2] END) AS u(i)""")
def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1)
    one = F.concat(F.lit('[{"text": "1:'), k, F.lit('"}, {"text": "2:'), k, F.lit('"}]'))
    content = F.when(F.col("event_type") == "click", one).when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(F.col("event_type") == "purchase", F.concat(F.lit("Sure: "), one, F.lit(" done"))).when(F.col("event_type") == "signup", F.concat(F.lit('{"samples": '), one, F.lit("}"))).otherwise("none")
    found, _ = quota.parse_responses(table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"), content.alias("content")))
    dim = spark.createDataFrame([(t, t, t == "click") for t in ("click", "view", "purchase", "signup", "error")], "label string, name string, is_sarcastic boolean")
    return quota.fill_defaults(found, dim).select("event_id", "label", "text", "is_sarcastic")


@query(r"""SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS number_text, CAST(p_retailprice AS DOUBLE) AS number, trim(p_name) AS name FROM part""")
def leading_numbers(spark: SparkSession, sf: str) -> DataFrame:
    price = F.concat(F.lit("¥"), F.col("p_retailprice").cast("string"), F.lit("起"))
    return table(spark, sf, "part").select("p_partkey", first_number(price).alias("number_text"), number_value(price).alias("number"), trim_u(F.concat(F.lit(" 　"), "p_name", F.lit("\n"))).alias("name"))
