"""Roll-up of run logs: tasks, attempts, retries and exhausted steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.operators.windows import carried

LINE = r"^\[(\d\d:\d\d:\d\d)\]\s+(INFO|PASS|FAIL|WARN)\s+(.*)$"
HEADING = r"TASK:\s*(.*?)\s*─*$"


def parse_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` with time, level, message, and heading on lines that open a task."""
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return lines.withColumns({"time": part(LINE, 1), "level": part(LINE, 2), "message": part(LINE, 3), "heading": part(HEADING, 1)})


def carry_task(parsed: DataFrame, run: str = "run", line: str = "line") -> DataFrame:
    """``parsed`` with task, the last heading above a line in its run; runs of any length."""
    return carried(parsed, [run], [line], "heading", "task")


def run_rollup(events: DataFrame, run: str = "run", task: str = "task", step: str = "step", ok: str = "ok", order: str = "line") -> DataFrame:
    """(run, task, steps, attempts, passes, failures, exhausted, status): a task fails if the last
    attempt of one of its steps does."""
    last = events.groupBy(run, task, step).agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col(ok)).alias("good"), F.max_by(ok, order).alias("end"))
    out = last.groupBy(run, task).agg(F.count(F.lit(1)).alias("steps"), F.sum("tries").alias("attempts"), F.sum("good").alias("passes"), F.sum(F.col("tries") - F.col("good")).alias("failures"), F.count_if(~F.col("end")).alias("exhausted"))
    return out.withColumn("status", F.when(F.col("exhausted") > 0, "FAIL").otherwise("PASS"))


def overall(rollup: DataFrame) -> DataFrame:
    """One row: tasks, failed, status."""
    failed = F.count_if(F.col("status") == "FAIL")
    return rollup.agg(F.count(F.lit(1)).alias("tasks"), failed.alias("failed"), F.when(failed > 0, "FAIL").otherwise("PASS").alias("status"))
