"""Audits of labelled texts by tables of rules, and of the diversity of a label's texts.

A rule says what a text must or must not hold: (type, condition, kind, needle, message). kind is
require or forbid (an issue), warn_require or warn_forbid (a warning). Rules of type null hold for
every type, rules of type * for types that have none of their own. Rules are a written list, so they
are broadcast; each row is audited where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def section_audit(df: DataFrame, sections: list[str], flag: str = "is_sarcastic", text: str = "cot", unflagged: list[str] = (), keywords: list[str] = (), span: tuple[str, str] | None = None, quotes: list[str] = ()) -> DataFrame:
    """``df`` with issues, warnings and passed.

    Every needle of ``sections`` must be there, for rows without the flag those of ``unflagged``
    too. A flagged row with none of ``keywords`` gets a warning, and so does one whose text between
    the two needles of ``span`` (to the end if the second is missing; empty if it comes first) holds
    none of ``quotes``. passed means no issue.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    flagged = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    missing = lambda needles: F.filter(F.array(*[F.lit(n) for n in needles]).cast("array<string>"), lambda n: ~F.contains(t, n))
    issues = F.concat(missing(sections), F.when(~flagged, missing(unflagged)).otherwise(F.array().cast("array<string>")))
    checks = []
    if keywords:
        held = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(t, k))
        checks.append(F.when(flagged & ~held, F.lit("no keyword of reversal")))
    if span:
        first, last = F.instr(t, span[0]), F.instr(t, span[1])
        inside = F.when(last == 0, F.substring(t, first, F.length(t))).when(last > first, F.substring(t, first, last - first)).otherwise("")
        quoted = F.exists(F.array(*[F.lit(q) for q in quotes]), lambda q: F.contains(inside, q))
        checks.append(F.when((first > 0) & ~quoted, F.lit(f"nothing quoted after {span[0]}")))
    warnings = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumns({"issues": issues, "warnings": warnings}).withColumn("passed", F.size("issues") == 0)


def typed_audit(df: DataFrame, rules: DataFrame, tasks: DataFrame, text: str = "cot", kind: str = "bridge_type", task: str = "task_id", output: str = "task_output", headings: list[str] = ("【二、{}分析】", "【三、{}分析】", "【四、{}分析】")) -> DataFrame:
    """``df`` with issues, warnings and passed, by rules of the row's type and its task.

    ``rules`` has (type, kind, needle, message); ``tasks`` (id, name, output_field). A row whose task
    is known must hold one of the headings with the task's name, and its output field; every row
    needs an output that is not empty. Types without rules of their own go by the rules of type *.
    """
    grouped = rules.groupBy("type").agg(F.collect_list(F.struct("kind", "needle", "message")).alias("_rules"))
    own = grouped.where("type <> '*'").withColumnRenamed("type", "_type")
    other = grouped.where("type = '*'").select(F.col("_rules").alias("_other"))
    named = tasks.select(F.col("id").alias("_task"), F.col("name").alias("_name"), F.col("output_field").alias("_field"))
    rows = df.join(F.broadcast(own), F.col(kind) == F.col("_type"), "left").join(F.broadcast(named), F.col(task) == F.col("_task"), "left").join(F.broadcast(other), F.lit(True), "left")  # written lists
    t, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")
    use = F.coalesce("_rules", "_other", F.array().cast("array<struct<kind:string,needle:string,message:string>>"))

    def broken(require: str, forbid: str) -> Column:
        hit = F.filter(use, lambda r: ((r["kind"] == require) & ~F.contains(t, r["needle"])) | ((r["kind"] == forbid) & F.contains(t, r["needle"])))
        return F.transform(hit, lambda r: r["message"])

    headed = F.lit(False)
    for h in headings:
        before, _, after = h.partition("{}")
        headed = headed | F.contains(t, F.concat(F.lit(before), F.col("_name"), F.lit(after)))
    extra = F.array_compact(F.array(
        F.when((F.col("_name") != "") & ~headed, F.concat(F.lit("no section on "), F.col("_name"))),
        F.when((F.col("_field") != "") & ~F.contains(t, F.col("_field")), F.concat(F.lit("no field "), F.col("_field"))),
        F.when(F.coalesce(F.col(output), F.lit("")) == "", F.lit("no output")),
    ))
    out = rows.withColumns({"issues": F.concat(F.coalesce(broken("require", "forbid"), none), extra), "warnings": F.coalesce(broken("warn_require", "warn_forbid"), none)})
    return out.select(*df.columns, "issues", "warnings", (F.size("issues") == 0).alias("passed"))


def audit_totals(audited: DataFrame, label: str = "label") -> DataFrame:
    """(label, total, passed, warned, failed): a row with issues failed, else with warnings warned."""
    failed, warned = F.size("issues") > 0, (F.size("issues") == 0) & (F.size("warnings") > 0)
    return audited.groupBy(F.coalesce(F.col(label), F.lit("__unknown__")).alias("label")).agg(F.count(F.lit(1)).alias("total"), F.count_if(~failed & ~warned).alias("passed"), F.count_if(warned).alias("warned"), F.count_if(failed).alias("failed"))


def diversity(df: DataFrame, label: str = "label", text: str = "text", least_spread: int = 10, prefix: int = 5) -> DataFrame:
    """(label, n, verdict) of each label's texts; the first finding counts.

    pass for fewer than two rows, duplicate_text where texts repeat, narrow_lengths where lengths
    spread over less than ``least_spread``, repeated_openings where distinct prefixes are less than
    half, else pass. Only the first is a failure, the next two are warnings.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    stats = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(t).alias("texts"), (F.max(F.length(t)) - F.min(F.length(t))).alias("spread"), F.countDistinct(F.substring(t, 1, prefix)).alias("openings"))
    verdict = F.when(F.col("n") < 2, "pass").when(F.col("texts") < F.col("n"), "duplicate_text").when(F.col("spread") < least_spread, "narrow_lengths").when(F.col("openings") * 2 < F.col("n"), "repeated_openings").otherwise("pass")
    return stats.select("label", "n", verdict.alias("verdict"))


def require_known(df: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """``df``; an error naming a value of ``column`` that the dimension lacks."""
    unknown = df.join(dimension.select(F.col(key).alias("_known")).distinct(), F.col(column) == F.col("_known"), "left_anti").select(column).first()
    if unknown is not None:
        raise ValueError(f"unknown {column}: {unknown[0]}")
    return df
