"""Hygiene, audits, quotas, logs and generated rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.functions.products import describe_full, describe_short, is_high_tier
from sparrowmill.operators import audit, dedup, generators, quota, runlog, seen, windows
from sparrowmill.queries.tables import registry, table
from sparrowmill.sources.arrays import write_arrays
from sparrowmill.sources.samples import read_samples
from sparrowmill.sources.shared import shared_folder

QUERIES, query = registry()
_KEY = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_of_each_text(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "source")


@query(f"SELECT d.lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.source IN ('src0', 'src1') AND {_KEY.replace('text', 's.text')} IS NOT DISTINCT FROM {_KEY.replace('text', 'd.text')}) GROUP BY d.lang")
def unseen_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return dedup.not_seen(d, d.where("source in ('src0', 'src1')"), "text").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.source IN ('src0', 'src1') AND {_KEY.replace('text', 's.text')} IS NOT DISTINCT FROM {_KEY.replace('text', 'd.text')})")
def unseen_in_store(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a stored corpus, made of two sources one after the other, does not hold."""
    d, path = table(spark, sf, "documents").select("doc_id", "text", "source"), shared_folder(spark, "seen")
    seen.make_store(d.where("source = 'src0'"), "text", path, expected=d.count())
    seen.add_to_store(d.where("source = 'src1'").select(seen.key_digest("text").alias("digest")).distinct(), path)
    return seen.unseen_rows(d, "text", path).select("doc_id")


@query(f"""WITH k AS (SELECT source AS file, coalesce({_KEY}, '') AS k FROM documents)
SELECT file, count(*) AS raw, count(DISTINCT k) AS "unique", count(*) - count(DISTINCT k) AS duplicates FROM k GROUP BY GROUPING SETS ((), (file))""")
def counts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.file_counts(table(spark, sf, "documents"), "text", "source")


@query("SELECT coalesce(lang, source, '__unknown__') AS label, count(*) AS n FROM documents GROUP BY 1")
def counts_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.existing_counts(table(spark, sf, "documents"), "lang", "source")


@query("""WITH s AS (SELECT source AS label, count(*) AS n, count(DISTINCT coalesce(text, '')) AS t, max(length(coalesce(text, ''))) - min(length(coalesce(text, ''))) AS w, count(DISTINCT substr(coalesce(text, ''), 1, 5)) AS o FROM documents GROUP BY source)
SELECT label, n, CASE WHEN n < 2 THEN 'pass' WHEN t < n THEN 'duplicate_text' WHEN w < 10 THEN 'narrow_lengths' WHEN o * 2 < n THEN 'repeated_openings' ELSE 'pass' END AS verdict FROM s""")
def diversity_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return audit.diversity(table(spark, sf, "documents"), "source")


_SECTIONS, _UNFLAGGED, _WORDS = ["e", "en"], ["qu"], ["the", "ing"]


@query("""WITH a AS (SELECT lang AS label, NOT (contains(text, 'e') AND contains(text, 'en') AND (lang = 'en' OR contains(text, 'qu'))) AS failed,
  (lang = 'en' AND NOT contains(text, 'the') AND NOT contains(text, 'ing')) OR (contains(text, 'and') AND NOT contains(CASE WHEN NOT contains(text, 'of') THEN substr(text, strpos(text, 'and')) WHEN strpos(text, 'of') > strpos(text, 'and') THEN substr(text, strpos(text, 'and'), strpos(text, 'of') - strpos(text, 'and')) ELSE '' END, ',')) AS warned FROM documents)
SELECT label, count(*) AS total, count(*) FILTER (NOT failed AND NOT warned) AS passed, count(*) FILTER (NOT failed AND warned) AS warned, count(*) FILTER (failed) AS failed FROM a GROUP BY label""")
def section_audit_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("label"), F.col("text").alias("cot"), (F.col("lang") == "en").alias("is_sarcastic"))
    return audit.audit_totals(audit.section_audit(d, _SECTIONS, unflagged=_UNFLAGGED, keywords=_WORDS, span=("and", "of"), quotes=[","]))


@query("""WITH a AS (SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(NOT contains(text, 'the ') AS INT) WHEN lang = 'fr' THEN 0 ELSE CAST(NOT contains(text, 'en') AS INT) END
  + CASE WHEN source = 'src1' THEN CAST(NOT contains(text, 'er') AS INT) + CAST(NOT contains(text, 'on') AS INT) ELSE 0 END + CAST(n_chars IS NULL AS INT) AS n_issues,
  CASE WHEN lang = 'fr' AND contains(text, 'que') THEN 1 ELSE 0 END AS n_warnings FROM documents)
SELECT doc_id, n_issues, n_warnings, n_issues = 0 AS passed FROM a""")
def typed_audit_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("en", "require", "the ", "no the"), ("fr", "warn_forbid", "que", "que"), ("*", "require", "en", "no en")], "type string, kind string, needle string, message string")
    tasks = spark.createDataFrame([("src1", "er", "on")], "id string, name string, output_field string")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("cot"), F.col("lang").alias("bridge_type"), F.col("source").alias("task_id"), F.col("n_chars").cast("string").alias("task_output"))
    out = audit.typed_audit(d, rules, tasks, headings=("{}",))
    return out.select("doc_id", F.size("issues").alias("n_issues"), F.size("warnings").alias("n_warnings"), "passed")


_QUOTA = "q AS (SELECT source AS label, count(*) AS target FROM documents GROUP BY source), h AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source)"


def _needs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    quotas = d.groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("target"))
    return quota.remaining(quotas, dedup.existing_counts(d.where("lang = 'en'"), "source"))


@query(f"WITH {_QUOTA} SELECT label, target, coalesce(n, 0) AS have, greatest(0, target - coalesce(n, 0)) AS need FROM q LEFT JOIN h ON label = source")
def quota_needs(spark: SparkSession, sf: str) -> DataFrame:
    return _needs(spark, sf)


@query(f"WITH {_QUOTA}, r AS (SELECT label, target - coalesce(n, 0) AS need FROM q LEFT JOIN h ON label = source) SELECT label, CAST(b AS INT) AS batch, CAST(least(5, need - b * 5) AS INT) AS batch_size FROM r, unnest(range(0, CAST(ceil(need / 5.0) AS INT))) AS u(b) WHERE need > 0")
def quota_batches(spark: SparkSession, sf: str) -> DataFrame:
    return windows.batches(quota.unfinished(_needs(spark, sf)), 5).select("label", "batch", "batch_size")


@query("""WITH i AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id, ['s0','s1','s2','s3','s4','s5','s6','s7','s8'][1 + i % 9] AS scene, CASE WHEN lang = 'en' THEN ['mild','medium','strong'][1 + i % 3] END AS intensity, ['c0','c1','c2','c3','c4','c5','c6','c7'][1 + i % 8] AS category, ['short','middle','long'][1 + (i + i // 72) % 3] AS length FROM i""")
def rotated_specs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("lang") == "en").alias("f"))
    out = quota.rotated(d, {"scene": [f"s{i}" for i in range(9)], "intensity": ["mild", "medium", "strong"], "category": [f"c{i}" for i in range(8)]}, ["short", "middle", "long"], "f", "intensity", ["lang"], "doc_id")
    return out.select("doc_id", "scene", "intensity", "category", "length")


@query("""WITH l AS (SELECT lang AS label, bool_or(source = 'src3') AS flagged FROM documents GROUP BY lang), t AS (SELECT DISTINCT source AS task FROM documents), k AS (SELECT * FROM (VALUES ('S', 50), ('N', 30), ('C', 30)) v(type, target))
SELECT 'BX-' || label || '-' || task || '-' || type AS combined, target FROM l, t, k WHERE CASE WHEN type = 'S' THEN flagged ELSE NOT flagged END""")
def label_combinations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    labels = d.groupBy(F.col("lang").alias("label")).agg(F.bool_or(F.col("source") == "src3").alias("flagged"))
    types = spark.createDataFrame([("S", 50), ("N", 30), ("C", 30)], "type string, target int")
    return quota.combinations(labels, d.select(F.col("source").alias("task")).distinct(), types).select("combined", "target")


@query("""WITH s AS (SELECT CAST(quality AS VARCHAR) AS label, doc_id, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS n FROM labels WHERE quality IS NOT NULL)
SELECT label, string_agg(doc_id, ',' ORDER BY doc_id) AS seeds FROM s WHERE n <= 3 GROUP BY label""")
def seeds_by_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("label"), F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("text"))
    return quota.seeds_of(rows).select("label", F.array_join("seeds", ",").alias("seeds"))


@query("""WITH q AS (SELECT source AS label, count(*) AS need FROM documents GROUP BY source), s AS (SELECT source, string_agg(doc_id, chr(10) ORDER BY doc_id) AS seeds FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3 GROUP BY source)
SELECT label, CAST(b AS INT) AS batch, CAST(least(20, need - b * 20) AS INT) AS batch_size, least(20, need - b * 20) || ' like ' || upper(label) || ': ' || seeds AS request FROM q JOIN s ON label = source, unnest(range(0, CAST(ceil(need / 20.0) AS INT))) AS u(b)""")
def request_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    quotas = d.groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("need"))
    dim = d.select(F.col("source").alias("label")).distinct().select("label", F.upper("label").alias("name"), F.lit("").alias("description"))
    seeds = d.select(F.col("source").alias("label"), F.col("doc_id").alias("line"), F.col("doc_id").cast("string").alias("text"))
    return quota.requests(quotas, dim, seeds, "{count} like {name}: {seeds}", 20)


@query("""WITH q AS (SELECT source AS label, count(*) AS need FROM documents GROUP BY source), i AS (SELECT label, need, i, (i + i // 72) % 3 AS l FROM q, unnest(range(0, need)) AS u(i)),
c AS (SELECT label, i // 20 AS b, least(20, any_value(need) - i // 20 * 20) AS n, string_agg((i % 20 + 1) || '. s' || i % 9 || ' c' || i % 8 || ' ' || ['short','middle','long'][1 + l] || ' ' || [20, 50, 100][1 + l] || '-' || [50, 100, 200][1 + l], chr(10) ORDER BY i) AS c FROM i GROUP BY label, i // 20)
SELECT label, CAST(b AS INT) AS batch, CAST(n AS INT) AS batch_size, n || ' of ' || label || chr(10) || c AS request FROM c""")
def request_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that name a scene, a category and a length for each sample of their batch."""
    d = table(spark, sf, "documents")
    quotas = d.groupBy(F.col("source").alias("label")).agg(F.count(F.lit(1)).alias("need"))
    lengths = [("short", 20, 50), ("middle", 50, 100), ("long", 100, 200)]
    specs = quota.rotated(quota.batch_slots(quotas, 20), {"scene": [f"s{i}" for i in range(9)], "category": [f"c{i}" for i in range(8)]}, lengths, kind=["label"])
    line = F.concat_ws(" ", "scene", "category", "length", F.concat_ws("-", "min_len", "max_len"))
    no_seeds = spark.createDataFrame([], "label string, line long, text string")
    dim = quotas.select("label", F.col("label").alias("name"), F.lit("").alias("description"))
    return quota.requests(quotas, dim, no_seeds, "{count} of {label}\n{constraints}", 20, constraints=quota.constraint_lines(specs, ["label", "batch"], "slot", line))


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.lit("all").alias("run"), F.col("user_id").alias("task"), F.regexp_extract("props", r"(\d)\D*$", 1).alias("step"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("line"))


_ROLL = r"""WITH a AS (SELECT user_id AS task, regexp_extract(props, '(\d)\D*$', 1) AS step, event_type <> 'error' AS ok, event_id FROM events),
s AS (SELECT task, step, count(*) AS tries, count(*) FILTER (ok) AS good, arg_max(ok, event_id) AS fine FROM a GROUP BY ALL),
r AS (SELECT 'all' AS run, task, count(*) AS steps, CAST(sum(tries) AS BIGINT) AS attempts, CAST(sum(good) AS BIGINT) AS passes, CAST(sum(tries - good) AS BIGINT) AS failures, count(*) FILTER (NOT fine) AS exhausted, CASE WHEN count(*) FILTER (NOT fine) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM s GROUP BY task)"""


@query(_ROLL + " SELECT * FROM r")
def attempts_by_task(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_rollup(_attempts(spark, sf))


@query(_ROLL + " SELECT count(*) AS tasks, count(*) FILTER (status = 'FAIL') AS failed, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM r")
def attempts_overall(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.overall(runlog.run_rollup(_attempts(spark, sf)))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of a log, a run for each user; some are headings."""
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("── TASK: day "), F.to_date("ts").cast("string"), F.lit(" ──"))).otherwise(F.concat(F.lit("[10:00:00] INFO "), "event_type"))
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("line"), text.alias("text"))


@query("""WITH l AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN 'day ' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS h FROM events)
SELECT event_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS task FROM l""")
def carried_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.carry_task(runlog.parse_lines(_lines(spark, sf))).select(F.col("line").alias("event_id"), "task")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'day ' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS h FROM events)
SELECT event_id, last_value(h IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS task FROM l""")
def carried_over_one_run(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of all users as one run: what is carried passes from range to range."""
    return runlog.carry_task(runlog.parse_lines(_lines(spark, sf).withColumn("run", F.lit("all")))).select(F.col("line").alias("event_id"), "task")


def products(spark: SparkSession, sf: str) -> DataFrame:
    price = F.concat(F.lit("¥"), F.col("p_retailprice").cast("string"), F.lit("起"))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("company"), F.col("p_type").alias("category"), F.col("p_size").cast("string").alias("series"), F.col("p_brand").alias("sub_series"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"),
        F.split("p_name", " ").alias("alias"), F.array("p_type", F.concat("p_brand", F.lit("/"), "p_size")).alias("positioning"), F.array("p_name", F.concat(F.col("p_size").cast("string"), F.lit("g light"))).alias("talking_points"),
        F.when(F.col("p_size") > 25, "new").otherwise("old").alias("generation"), price.alias("price"), F.when(F.col("p_size") % 2 == 0, "在售").otherwise("即将发布").alias("status"), F.col("p_partkey").alias("ord"),
    )


_P = "p AS (SELECT *, p_name || ' ' || p_partkey AS name, '¥' || CAST(p_retailprice AS VARCHAR) || '起' AS price, p_retailprice AS v FROM part)"
_SHORT = "name || ', ' || p_brand || p_type || ', ' || p_name || '、' || p_size || 'g light, ' || price || '。'"


@query(f"""WITH {_P} SELECT p_partkey, name || '是' || p_brand || '的一款' || p_type || '，属于' || p_size || '，' || p_type || '、' || p_brand || '/' || p_size || '，主打' || p_name || '、' || p_size || 'g light，售价' || price || CASE WHEN p_size % 2 = 0 THEN '，目前在售' ELSE '，目前尚未发布' END || '。' AS full_text,
{_SHORT} AS short_text, v > 8000 OR (position('.' IN CAST(v AS VARCHAR)) > 0 AND CAST(regexp_extract(CAST(v AS VARCHAR), '\\.(\\d+)', 1) AS BIGINT) > 8000) AS high FROM p""".replace("\\\\", "\\"))
def product_texts(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(F.col("ord").alias("p_partkey"), describe_full().alias("full_text"), describe_short().alias("short_text"), is_high_tier(F.col("price")).alias("high"))


#: (question, answer) by generator and case, for the queries below.
_TEMPLATES = [
    ("alias_resolve", None, "what is {alias}", "{alias} is {name}"), ("intro", None, "tell me of {name}", "{short}"), ("category_list", None, "which {group}", "{names}"), ("series_list", None, "which series {group}", "{company}: {names}"),
    ("price_ask", None, "price of {name}", "{price} {tier}"), ("reverse_lookup", "point", "who does {point}", "{name}"), ("reverse_lookup", "positioning", "who is {positioning}", "{name}"), ("compare", None, "{a_name} or {b_name}", "{series}"),
    ("superlative", "weight", "who has {weight}", "{name}"), ("superlative", "cheapest", "cheapest {category}", "{name} {price}"), ("superlative", "priciest", "priciest {category}", "{name} {price}"), ("status_ask", "在售", "{name} sold?", "{status}"), ("status_ask", "即将发布", "{name} when?", "{generation}"),
    ("alias_direct", None, "which is {alias}", ""), ("alias_sentence", None, "got {alias}", ""), ("reverse_positioning", None, "phones of {positioning}", "{names}"), ("reverse_point", None, "with {point}", ""), ("price_query", None, "cost of {name}", ""), ("enumeration", "category", "list {group}", "{names}"),
    ("enumeration", "series", "list series {group}", "{names}"), ("status_query", "在售", "{name} on sale?", ""), ("generation_query", "new", "{name} latest?", ""), ("comparison", None, "{a_name} vs {b_name}", ""), ("extremes", "cheapest", "least {category}", "{name}"),
]


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, i, c, q, a) for i, (g, c, q, a) in enumerate(_TEMPLATES)], "generator string, variant int, case string, question string, answer string")


def _one(name: str, registry_: dict, spark: SparkSession, sf: str) -> DataFrame:
    return generators.generate(products(spark, sf), _templates(spark), registry_, name).select("instruction", "output")


_WORDS_OF = "unnest(string_split(p_name, ' ')) AS u(a)"
_LIST = "SELECT {g} AS g, string_agg(name, '、' ORDER BY p_partkey) FILTER (n <= {k}) AS names, arg_min(p_brand, p_partkey) AS company, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY p_partkey) AS n FROM p) GROUP BY {g}"
_PRICED = "(SELECT *, name || '(' || price || ')' AS shown FROM p)"
_PAIRS = "FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"
_ENDS = "SELECT p_type, arg_min(name, (v, p_partkey)) AS lo, arg_max(name, (v, p_partkey)) AS hi, arg_min(price, (v, p_partkey)) AS lop, arg_max(price, (v, p_partkey)) AS hip, count(*) AS c FROM p GROUP BY p_type"
_GENERATED = {
    "alias_resolve": f"SELECT 'what is ' || a AS instruction, a || ' is ' || name AS output FROM p, {_WORDS_OF}",
    "intro": f"SELECT 'tell me of ' || name AS instruction, {_SHORT} AS output FROM p",
    "category_list": f"SELECT 'which ' || g AS instruction, names AS output FROM ({_LIST.format(g='p_type', k=12).replace('string_agg(name', 'string_agg(shown').replace('FROM p)', f'FROM {_PRICED})')})",
    "series_list": f"SELECT 'which series ' || g AS instruction, company || ': ' || names AS output FROM ({_LIST.format(g='p_size', k=8)}) WHERE c >= 2",
    "price_ask": "SELECT 'price of ' || name AS instruction, price || ' ' || CASE WHEN v > 8000 THEN 'high' ELSE 'middle' END AS output FROM p",
    "reverse_lookup": "SELECT 'who does ' || p_name AS instruction, name AS output FROM p UNION ALL SELECT 'who is ' || u.x, name FROM p, unnest([p_type, p_brand || '/' || p_size]) AS u(x)",
    "compare": f"SELECT a.name || ' or ' || b.name AS instruction, CAST(a.p_size AS VARCHAR) AS output {_PAIRS}",
    "superlative": f"SELECT 'who has ' || p_size || 'g' AS instruction, name AS output FROM p UNION ALL SELECT 'cheapest ' || p_type, lo || ' ' || lop FROM ({_ENDS}) WHERE c >= 2 AND lo <> hi UNION ALL SELECT 'priciest ' || p_type, hi || ' ' || hip FROM ({_ENDS}) WHERE c >= 2 AND lo <> hi",
    "status_ask": "SELECT CASE WHEN p_size % 2 = 0 THEN name || ' sold?' ELSE name || ' when?' END AS instruction, CASE WHEN p_size % 2 = 0 THEN '在售' WHEN p_size > 25 THEN 'new' ELSE 'old' END AS output FROM p",
    "alias_direct": f"SELECT 'which is ' || a AS instruction, '' AS output FROM p, {_WORDS_OF}",
    "alias_sentence": f"SELECT 'got ' || a AS instruction, '' AS output FROM p, {_WORDS_OF}",
    "reverse_positioning": f"SELECT 'phones of ' || x AS instruction, string_agg(name, '、' ORDER BY p_partkey) AS output FROM p, unnest([p_type, p_brand || '/' || p_size]) AS u(x) GROUP BY x HAVING count(*) <= 5",
    "reverse_point": "SELECT 'with ' || p_name AS instruction, '' AS output FROM p",
    "price_query": "SELECT 'cost of ' || name AS instruction, '' AS output FROM p",
    "enumeration": f"SELECT 'list ' || g AS instruction, names AS output FROM ({_LIST.format(g='p_type', k=10)}) UNION ALL SELECT 'list series ' || g, names FROM ({_LIST.format(g='p_size', k=8)})",
    "status_query": "SELECT name || ' on sale?' AS instruction, '' AS output FROM p WHERE p_size % 2 = 0",
    "generation_query": "SELECT name || ' latest?' AS instruction, '' AS output FROM p WHERE p_size > 25",
    "comparison": f"SELECT a.name || ' vs ' || b.name AS instruction, '' AS output {_PAIRS}",
    "extremes": f"SELECT 'least ' || p_type AS instruction, lo AS output FROM ({_ENDS}) WHERE lo <> hi",
}
for _name, _body in _GENERATED.items():
    _registry = generators.TRAINING if _name in generators.TRAINING else generators.EVALUATION
    QUERIES[f"gen_{_name}"] = (partial(_one, _name, _registry), f"WITH {_P} {_body}")


@query(f"""WITH {_P}, hit AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS n FROM p WHERE contains(p_brand || '/' || p_size, '#2/1') OR contains(p_brand, '#2/1'))
SELECT string_agg(name || '(' || price || ')', '、' ORDER BY p_partkey) AS names FROM hit WHERE n = 1 HAVING count(*) >= 2""")
def gen_topic(spark: SparkSession, sf: str) -> DataFrame:
    return generators.topic(generators.described(products(spark, sf)), "#2/1").select(F.col("slots")["names"].alias("names"))


@query(f"""WITH {_P}, r AS (SELECT 'got ' || a AS instruction, a AS mention, name AS value, NULL AS name, NULL AS category, NULL AS series, NULL AS price FROM p, {_WORDS_OF}
UNION ALL SELECT 'cost of ' || name, name, price, NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT a.name || ' vs ' || b.name, u.x.name, NULL, u.x.name, u.x.p_type, CAST(u.x.p_size AS VARCHAR), u.x.price FROM p a JOIN p b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey, unnest([a, b]) AS u(x))
SELECT * FROM r""")
def question_entities(spark: SparkSession, sf: str) -> DataFrame:
    """What the questions of three generators mention, a row for each mention."""
    chosen = {n: generators.EVALUATION[n] for n in ("alias_sentence", "price_query", "comparison")}
    rows = generators.generate(products(spark, sf), _templates(spark), chosen)
    return rows.select("instruction", F.explode("entities").alias("mention", "e")).select("instruction", "mention", "e.*")


@query(f"""WITH {_P}, c AS (SELECT 'alias_resolve' AS generator, count(*) AS n FROM p, {_WORDS_OF} UNION ALL SELECT 'intro', count(*) FROM p)
SELECT generator, n, round_even(100.0 * n / (SELECT sum(n) FROM c), 1)::DOUBLE AS percent FROM c""")
def generator_shares(spark: SparkSession, sf: str) -> DataFrame:
    chosen = {n: generators.TRAINING[n] for n in ("alias_resolve", "intro")}
    return generators.generator_shares(generators.generate(products(spark, sf), _templates(spark), chosen))


@query()
def generator_sample(spark: SparkSession, sf: str) -> DataFrame:
    """All generators, each capped by a seeded sample (hash order, so no SQL)."""
    return generators.generate(products(spark, sf), _templates(spark), cap=120).select("generator", "instruction", "output")


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE n <= c - c // 4")
def quota_exact(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    targets = d.groupBy("source").agg((F.count(F.lit(1)) - F.floor(F.count(F.lit(1)) / 4)).alias("target"))
    return windows.exact_quota(d.select("doc_id", "source").join(targets, "source"), ["source"], ["doc_id"], "target").select("doc_id", "source")


@query("SELECT coalesce(source, '') AS instruction, text AS output, lang AS tier, count(*) AS n FROM documents GROUP BY ALL")
def array_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON arrays and read back, with a field that nobody declared."""
    d, path = table(spark, sf, "documents"), shared_folder(spark, "array-samples")
    write_arrays(d.select(F.coalesce("source", F.lit("")).alias("instruction"), F.col("text").alias("output"), F.col("lang").alias("tier")), path)
    rows = read_samples(spark, path, meta="meta").select("instruction", "output", F.col("meta")["tier"].cast("string").alias("tier"))
    return rows.groupBy("instruction", "output", "tier").agg(F.count(F.lit(1)).alias("n"))
