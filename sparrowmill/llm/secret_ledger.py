"""Secret scans over all versions of texts, with a ledger of what has been scanned.

A version's text is a blob, named by its SHA-256. The ledger is one table of (blob, rules scanned with,
findings), appended in one commit, so a run that dies leaves nothing half done. A run scans only the
pairs of blob and rule version that the ledger lacks, each blob once however many paths and versions
hold it, and joins the findings of its rules back to every path. Texts aren't shuffled while what tells
the rows to scan apart is few enough to be broadcast: repeated and known blobs, or the ones to scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.storage import giving_back, materialize, new_folder, sliced

#: Blobs that may be broadcast; more go through a shuffle join.
BROADCAST_BLOBS = 500_000
#: Bytes of text that are scanned together.
SCAN_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """Spans of a kind: matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least``
    characters or more; shorter ones are matched and then dropped. A change of any of them needs a new
    version. ``hint`` is found in every text with a match; patterns have no look-around or references.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    hint: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base rules, then public formats of keys and tokens.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, rf"""({_NAMES})["']?\x20*[:=]"""),
    Rule("access", "AKIA[A-Z0-9]+", 20, 0, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]+", 24, 0, "[0-9a-f]{24}"),
)
RULES = (
    *BASE,
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)

_LEDGER = "blob binary, rules array<string>, findings array<struct<rule:string,start:int,end:int>>"


def content(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def blob_id(text: str) -> Column:
    """The SHA-256 of a text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(content(text), 256))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of a ledger; one that isn't there yet has none."""
    try:
        return spark.read.schema(_LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def scan_texts(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A ledger row for each (blob, text, todo): todo has a bit for each rule to scan with."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SCAN_BYTES):
            blobs, todo, texts = batch.column("blob").to_pylist(), batch.column("todo").to_pylist(), batch.column("text")
            found: list[list] = [[] for _ in blobs]
            for bit, rule in enumerate(rules):
                # One pass of a linear matcher over all texts; only those with a match get their spans.
                hits = pc.indices_nonzero(pc.match_substring_regex(texts, rule.hint or rule.pattern)).to_pylist()
                for i in (i for i in hits if todo[i] >> bit & 1):
                    found[i] += [{"rule": rule.key, "start": a, "end": b} for a, b in rule.spans(texts[i].as_py())]
            done = [[r.key for bit, r in enumerate(rules) if t >> bit & 1] for t in todo]
            first = list(dict(zip(reversed(blobs), reversed(range(len(blobs))), strict=True)).values())  # rows that repeat an id and a version
            yield pa.RecordBatch.from_pylist([{"blob": blobs[i], "rules": done[i], "findings": found[i]} for i in first], schema=shape)

    finding = pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    shape = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("findings", pa.list_(finding))])
    return rows.select("blob", "text", "todo").mapInArrow(giving_back(scan), _LEDGER)


def unseen(versions: DataFrame, addressed: DataFrame, known: DataFrame, every: int, text: str) -> DataFrame:
    """(blob, text, todo) of the rows to scan: of each blob the first version by (path, version), with the
    bits of the rules that ``known`` (blob, done) lacks."""
    blobs = addressed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("first"), F.count(F.lit(1)).alias("n")).join(known, "blob", "left")
    blobs = materialize(blobs.select("blob", "first", "n", F.lit(every).bitwiseAND(F.bitwise_not(F.coalesce("done", F.lit(0).cast("long")))).alias("todo")), "blobs")
    special, wanted = blobs.where((F.col("n") > 1) | (F.col("todo") != every)), blobs.where("todo != 0")
    rows = versions.select(F.struct("path", "version").alias("at"), content(text).alias("text"), blob_id(text).alias("blob"))
    # Rows without a special blob are scanned with every rule.
    left = special.select("blob", "first", F.col("todo").alias("some"))
    todo = F.when(F.col("first").isNull(), F.lit(every)).when(F.col("first") == F.col("at"), F.col("some")).otherwise(F.lit(0)).cast("long")
    if special.count() <= BROADCAST_BLOBS:
        return rows.join(F.broadcast(left), "blob", "left").select("blob", "text", todo.alias("todo")).where("todo != 0")
    wanted = wanted.select("blob", F.col("first").alias("of"), "todo")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_BLOBS else wanted
    return rows.join(wanted, "blob").where(F.col("of") == F.col("at")).select("blob", "text", "todo")


def scan_versions(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, path: str = "path", version: str = "version", text: str = "text") -> DataFrame:
    """(path, version, blob, findings) of each row of ``versions``; findings are structs (start, rank, end,
    kind) by start, then by the place of their rule, with positions in code points, end exclusive.

    ``ledger`` is a folder in shared storage, made if it isn't there; what this run scans is added to it.
    Findings of rule versions that aren't asked for are left out. Null texts count as empty; null and
    repeated paths and versions are allowed, and every row gets its row. An empty table scans nothing.
    Very long texts are scanned whole. Other columns are ignored.
    """
    if len(rules) > 62 or len({r.kind for r in rules}) < len(rules):
        raise ValueError("at most 62 rules, each of a kind of its own")
    spark = versions.sparkSession
    versions = versions.select(F.col(path).alias("path"), F.col(version).alias("version"), F.col(text).alias("text"))
    # In a struct "=" of nulls is equality, so versions without a path or number keep their place.
    addressed = materialize(versions.select("path", "version", blob_id("text").alias("blob")), "addressed")
    bits = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(1 << i).cast("long"))])
    known = read_ledger(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.bit_or(F.coalesce(F.try_element_at(bits, "rule"), F.lit(0).cast("long"))).alias("done"))
    scan_texts(unseen(versions, addressed, known, (1 << len(rules)) - 1, "text"), rules).write.mode("append").parquet(ledger)

    keys = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("rank"), F.lit(r.kind).alias("kind")))])
    asked = read_ledger(spark, ledger).where(F.size("findings") > 0).select("blob", F.filter("findings", lambda x: F.map_contains_key(keys, x["rule"])).alias("f")).where(F.size("f") > 0)
    named = lambda x: F.struct(x["start"].alias("start"), keys[x["rule"]]["rank"].alias("rank"), x["end"].alias("end"), keys[x["rule"]]["kind"].alias("kind"))
    found = asked.groupBy("blob").agg(F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("f")), named))).alias("findings"))
    found = materialize(found.join(addressed.select("blob").distinct(), "blob", "left_semi"), "blob-findings")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = F.broadcast(found) if found.count() <= BROADCAST_BLOBS else found
    return addressed.join(found, "blob", "left").select("path", "version", "blob", F.coalesce("findings", none).alias("findings"))


def span_text(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = scan_versions(docs, new_folder(spark, "secret-ledger"))
    of = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda x: x["rank"] < len(BASE))
    return found.select(F.col("path").alias("doc_id"), *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("findings")).alias("spans"))


def _sql() -> str:
    def spans(rank: int, rule: Rule) -> str:
        p, hint = rule.pattern.replace("'", "''"), (rule.hint or rule.pattern).replace("'", "''")
        return f"""SELECT id, '{rule.kind}' AS kind, {rank} AS rank, list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS a, length(m[i]) AS n
FROM (SELECT id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{hint}')), unnest(range(1, len(m) + 1)) AS u(i) WHERE length(regexp_extract(m[i], '{p}', {rule.group})) >= {rule.least}"""

    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    joined = "string_agg(concat_ws(':', kind, CAST(a AS BIGINT), CAST(a + n AS BIGINT)), ',' ORDER BY a, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({joined} FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce({joined} FILTER (rank IS NOT NULL), '') AS spans FROM d LEFT JOIN s USING (id) GROUP BY id"""


NAME, SQL = "op12_secret_ledger", _sql()
