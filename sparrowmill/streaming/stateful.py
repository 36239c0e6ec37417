"""Streams whose state goes with each key: first-seen texts, hard quotas, live roll-up of raw log lines.

Processors of transformWithState, which keeps state in RocksDB: on disk, one entry at a time in memory.
``with_state_store`` sets that provider for the session's streams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, TimerValues
from pyspark.sql.types import StructType

from sparrowmill.functions.text import trim_u
from sparrowmill.operators.runlog import parse_lines

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State keys of first-seen texts: each holds the texts whose hash falls to it.
BUCKETS = 1024


def with_state_store(spark: SparkSession) -> None:
    """Stateful streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _plain(stream: DataFrame, order: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """``stream`` with columns c0, c1 ... (pandas rows can't carry every name), those names, and the order's."""
    names = [f"c{i}" for i in range(len(stream.columns))]
    return stream.toDF(*names), names, [names[stream.columns.index(c)] for c in order]


class FirstSeen(StatefulProcessor):
    """Passes a row on if its digest is not in state; each digest stays there for ``kept_ms``."""

    def __init__(self, kept_ms: int | None, columns: list[str], order: list[str]) -> None:
        self.kept_ms, self.columns, self.order = kept_ms, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "digest binary", "one boolean", self.kept_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for part in [pd.concat(rows, ignore_index=True).sort_values(self.order, kind="stable")] if self.order else rows:
            new = []
            for digest in part["digest"]:
                fresh = not self.seen.containsKey((digest,))
                if fresh:
                    self.seen.updateValue((digest,), (True,))
                new.append(fresh)
            yield part.loc[new, self.columns]


def first_seen(stream: DataFrame, key: str, order: list[str] = (), kept_ms: int | None = None) -> DataFrame:
    """The first row of each trimmed key, for streams without an event time.

    A text is told by its SHA-256, so an entry of the state has 32 bytes. ``kept_ms`` is how long a key stays
    after it was first seen (processing time); the state then holds the keys of that span, and a repeat
    further apart is a first row again. Such a stream has work as long as it runs, so it takes a trigger by
    interval, not one that ends with the input. Rows of one micro-batch come in ``order``. Null keys are one key.
    """
    rows, names, by = _plain(stream, list(order))
    content = trim_u(F.col(names[stream.columns.index(key)]))
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce(F.concat(F.lit("="), content), F.lit("")), 256))).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(BUCKETS)))
    out = keyed.groupBy("bucket").transformWithStateInPandas(FirstSeen(kept_ms, names, by), rows.schema, "append", "processingTime" if kept_ms else "none")
    return out.toDF(*stream.columns)


class Capped(StatefulProcessor):
    """Passes rows of a label on until its target is reached; the state is a number."""

    def __init__(self, targets: dict[str, int], default: int, columns: list[str], order: list[str]) -> None:
        self.targets, self.default, self.columns, self.order = targets, default, columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        left = max(0, self.targets.get(key[0], self.default) - used)
        if not left:
            return
        best: pd.DataFrame | None = None
        for part in rows:  # no more than the rows still wanted stay in memory
            best = part if best is None else pd.concat([best, part], ignore_index=True)
            best = (best.sort_values(self.order, kind="stable") if self.order else best).iloc[:left]
        self.used.update((used + len(best),))
        yield best[self.columns]


def capped(stream: DataFrame, label: str, targets: dict[str, int], default: int = 0, order: list[str] = ()) -> DataFrame:
    """Rows until a label's target is reached, then none: a hard quota. Of the rows of one micro-batch the
    first in ``order`` are taken."""
    rows, names, by = _plain(stream, list(order))
    out = rows.groupBy(names[stream.columns.index(label)]).transformWithStateInPandas(Capped(targets, default, names, by), rows.schema, "append", "none")
    return out.toDF(*stream.columns)


_ROLLUP = "run string, task string, steps long, attempts long, passes long, failures long, exhausted long, status string, version long"
_LINES = pa.schema([("line", pa.int64()), ("at_ms", pa.int64()), ("heading", pa.string()), ("step", pa.string()), ("ok", pa.bool_())])
_COUNTS = pa.schema([("task", pa.string()), ("step", pa.string()), ("tries", pa.int64()), ("good", pa.int64()), ("fine", pa.bool_()), ("turn", pa.int64())])
#: State keys of a run's counts: each holds those of the tasks whose hash falls to it.
TASK_BUCKETS = 256


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def _in_order(tables: list[pa.Table]) -> pa.Table:
    """Lines of all tables by number; of equal ones those of the earlier table first."""
    both = pa.concat_tables(tables)
    return both.take(np.argsort(both["line"].to_numpy(), kind="stable")).combine_chunks()


def _merged(stretches: list[Iterator[pa.Table]]) -> Iterator[pa.Table]:
    """Lines of sorted stretches in one order, with a part of each stretch in memory."""
    heads = [[next(s, None), s] for s in stretches]
    while heads := [h for h in heads if h[0] is not None]:
        bound = min(h[0]["line"][-1].as_py() for h in heads)
        taken = []
        for h in heads:
            n = int(np.searchsorted(h[0]["line"].to_numpy(), bound, side="right"))
            taken.append(h[0].slice(0, n))
            h[0] = h[0].slice(n) if n < h[0].num_rows else next(h[1], None)
        yield _in_order(taken) if len(taken) > 1 else taken[0]


def _summed(tables: list[pa.Table], *keys: str) -> pa.Table:
    """Counts by ``keys``; of rows with the same ones the last tells whether it ended well."""
    out = pa.concat_tables([_COUNTS.empty_table(), *tables]).group_by([*keys], use_threads=False)
    out = out.aggregate([("tries", "sum"), ("good", "sum"), ("fine", "last"), *[("turn", "max")] * ("turn" not in keys)])
    return pa.table([out[n if n in keys else f"{n}_{how}"] for n, how in zip(_COUNTS.names, ("", "", "sum", "sum", "last", "max"), strict=True)], schema=_COUNTS)


def _attempts(lines: pa.Table, task: str | None, turn: int) -> tuple[str | None, pa.Table]:
    """The task that is open after lines in order, and the counts of their attempts; ``task`` is open before."""
    heading = pa.concat_arrays([pa.array([task], pa.string()), *lines["heading"].chunks]).dictionary_encode()  # the open task stands for a heading above
    codes = heading.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    of = codes[np.maximum.accumulate(np.where(codes >= 0, np.arange(len(codes)), 0))]
    at = np.flatnonzero((codes[1:] < 0) & lines["ok"].is_valid().to_numpy() & (of[1:] >= 0))
    ok = lines["ok"].take(at)
    one = pa.table([heading.dictionary.take(pa.array(of[1:][at])), lines["step"].take(at), pa.array(np.ones(len(at), np.int64)), ok.cast(pa.int64()), ok, pa.array(np.full(len(at), turn))], schema=_COUNTS)
    return heading.dictionary[int(of[-1])].as_py() if of[-1] >= 0 else None, _summed([one], "task", "step")


class LiveRollup(StatefulProcessor):
    """The roll-up of one run from lines in any order.

    Lines wait in state until the watermark has passed them, since a line may still come between them; then
    they are folded, in order, into the counts of the steps. What is shown counts the waiting lines as well.

    Waiting lines are a sorted stretch in parts of ``part`` lines. New lines are sorted ``stretch`` at a time,
    and stretches are merged part by part; counts go to state by the hash of their task when there are more
    than ``stretch``. So no more than a part of each stretch and the counts of a bucket are in memory.
    """

    def __init__(self, stretch: int = 200_000, part: int = 20_000) -> None:
        self.stretch, self.part = stretch, part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", "stretch long, part long", "lines binary")
        self.waiting = handle.getValueState("waiting", "stretch long, parts long, first_ms long")
        self.heading = handle.getValueState("heading", "task string")
        self.steps = handle.getMapState("steps", "bucket int", "counts binary")
        self.open = handle.getMapState("open", "bucket int", "counts binary")
        self.turn = handle.getValueState("turn", "n long")

    def _put(self, stretch: int, done: int, lines: pa.Table) -> int:
        """Adds sorted lines to a stretch of so many parts; the parts it has then."""
        for i in range(0, lines.num_rows, self.part):
            self.lines.updateValue((stretch, done), (_packed(lines.slice(i, self.part)),))
            done += 1
        return done

    def _taken(self, stretch: int, parts: int) -> Iterator[pa.Table]:
        """The parts of a stretch, which leave the state one by one."""
        for i in range(parts):
            data = self.lines.getValue((stretch, i))[0]
            self.lines.removeKey((stretch, i))
            yield _unpacked(data)

    def _stretches(self, new: Iterator[pa.Table], last: int) -> tuple[list[Iterator[pa.Table]], int]:
        """New lines as sorted stretches, all but one of them in state; the number of the last."""
        out, held, n = [], [], 0
        for table in new:
            held, n = [*held, table], n + table.num_rows
            if n >= self.stretch:
                last += 1
                out.append(self._taken(last, self._put(last, 0, _in_order(held))))
                held, n = [], 0
        if n:
            rest = _in_order(held)
            out.append(rest.slice(i, self.part) for i in range(0, n, self.part))
        return out, last

    def _held(self, state: MapState, bucket: int) -> pa.Table:
        found = state.getValue((bucket,)) if state.containsKey((bucket,)) else None
        return _unpacked(found[0]) if found else _COUNTS.empty_table()

    def _added(self, state: MapState, tables: list[pa.Table], keys: list[str], most: int) -> tuple[list[pa.Table], set[int]]:
        """Counts that stay in memory, at most ``most``; else they go to state, and the buckets that they go to."""
        if sum(t.num_rows for t in tables) <= most:
            return tables, set()
        both = _summed(tables, *keys)
        if both.num_rows <= most // 2:
            return [both], set()
        tasks = both["task"].combine_chunks().dictionary_encode()
        buckets = np.array([zlib.crc32(t.encode()) % TASK_BUCKETS for t in tasks.dictionary.to_pylist()])[tasks.indices.to_numpy()]
        order = np.argsort(buckets, kind="stable")
        both, found = both.take(order), np.unique(buckets[order], return_index=True)
        for bucket, start, end in zip(found[0].tolist(), found[1], [*found[1][1:], len(order)], strict=True):
            state.updateValue((bucket,), (_packed(_summed([self._held(state, bucket), both.slice(start, end - start)], *keys)),))
        return [], set(found[0].tolist())

    def _turn(self, key: tuple, new: Iterator[pa.Table], watermark: int) -> Iterator[pd.DataFrame]:
        turn = (self.turn.get()[0] if self.turn.exists() else 0) + 1
        self.turn.update((turn,))
        old, parts = self.waiting.get()[:2] if self.waiting.exists() else (0, 0)
        stretches, last = self._stretches(new, old)
        task = self.heading.get()[0] if self.heading.exists() else None
        shown, first, latest, kept, rest = task, None, 0, 0, _LINES.empty_table()
        folded, open_, touched = [], [], set()
        for lines in _merged([self._taken(old, parts), *stretches]):
            # Folding stops at the first line that the watermark hasn't passed, so lines are folded in order.
            at = lines["at_ms"].to_numpy()
            ready = 0 if first is not None else int(np.argmax(at > watermark)) if (at > watermark).any() else len(at)
            if ready:
                task, counts = _attempts(lines.slice(0, ready), task, turn)
                folded, found = self._added(self.steps, [*folded, counts], ["task", "step"], self.stretch)
                touched |= found
            if ready < len(at):
                if first is None:
                    first, shown = int(at[ready]), task
                latest = max(latest, int(at[ready:].max()))
                shown, counts = _attempts(lines.slice(ready), shown, turn)
                rest = pa.concat_tables([rest, lines.slice(ready)])
                full = rest.num_rows // self.part * self.part
                kept, rest = self._put(last + 1, kept, rest.slice(0, full)), rest.slice(full)
                open_, _ = self._added(self.open, [*open_, counts], ["task", "step", "turn"], self.stretch)
        if task is not None:
            self.heading.update((task,))
        if first is not None:
            self.waiting.update((last + 1, self._put(last + 1, kept, rest), first))
            self.handle.registerTimer(latest + 1)
        elif self.waiting.exists():
            self.waiting.clear()
        touched |= self._added(self.steps, folded, ["task", "step"], 0)[1]
        self._added(self.open, open_, ["task", "step", "turn"], 0)
        yield from self._views(key, turn, touched)

    def _views(self, key: tuple, turn: int, touched: set[int]) -> Iterator[pd.DataFrame]:
        """Tasks that got attempts in this turn, or have or had waiting ones, with the counts of both."""
        views, n = [], 0
        for bucket in sorted(touched | {k[0] for k in self.open.keys()}):
            steps, open_ = self._held(self.steps, bucket), self._held(self.open, bucket)
            now = open_.filter(pc.equal(open_["turn"], turn))
            if now.num_rows < open_.num_rows:
                self.open.updateValue((bucket,), (_packed(now),)) if now.num_rows else self.open.removeKey((bucket,))
            names = pa.concat_arrays([*steps.filter(pc.equal(steps["turn"], turn))["task"].chunks, *open_["task"].chunks]).unique()
            both = _summed([steps, now], "task", "step")
            both = both.filter(pc.is_in(both["task"], names)).to_pandas()
            view = both.assign(bad=~both["fine"].astype(bool)).groupby("task").agg(steps=("tries", "size"), attempts=("tries", "sum"), passes=("good", "sum"), exhausted=("bad", "sum"))
            views.append(view.reindex(names.to_pylist(), fill_value=0).reset_index(names="task"))
            n += len(names)
            if n >= self.part:
                yield self._shown(key, turn, views)
                views, n = [], 0
        if n:
            yield self._shown(key, turn, views)

    def _shown(self, key: tuple, turn: int, views: list[pd.DataFrame]) -> pd.DataFrame:
        out = pd.concat(views, ignore_index=True)
        out = out.assign(run=str(key[0]), failures=out["attempts"] - out["passes"], status=np.where(out["exhausted"] > 0, "FAIL", "PASS"), version=turn)
        return out[["run", "task", "steps", "attempts", "passes", "failures", "exhausted", "status", "version"]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = (pa.table([pa.array(part[f.name], f.type, from_pandas=True) for f in _LINES], schema=_LINES) for part in rows)
        yield from self._turn(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.waiting.exists() and self.waiting.get()[2] <= watermark:  # else no line can be folded
            yield from self._turn(key, iter(()), watermark)


def live_rollup(lines: DataFrame, at: str, delay: str, run: str = "run", line: str = "line", text: str = "text") -> DataFrame:
    """Running (run, task, steps, attempts, passes, failures, exhausted, status, version) of raw log lines, in update mode.

    ``line`` (a number) orders the lines of a run; they may arrive in any order within ``delay`` of the event
    time ``at``, which must not fall as lines go up by more than that. The last heading above a line is its
    task; PASS and FAIL lines are attempts of the step that their message names. Of a task's
    rows that of the highest version counts. State: a run's open heading, its steps' counts, and the lines of the last ``delay``.
    """
    parsed = parse_lines(lines.withWatermark(at, delay), text)
    rows = parsed.where("heading is not null or level in ('PASS', 'FAIL')")
    rows = rows.select(F.col(run).cast("string").alias("run"), F.col(line).cast("long").alias("line"), F.col(at).alias("at"), F.unix_millis(F.col(at)).alias("at_ms"), "heading", F.col("message").alias("step"), F.when(F.col("heading").isNull(), F.col("level") == "PASS").alias("ok"))
    return rows.groupBy("run").transformWithStateInPandas(LiveRollup(), StructType.fromDDL(_ROLLUP), "update", "eventTime", eventTimeColumnName="")


def newest(rows: DataFrame) -> DataFrame:
    """Of stored update rows of ``live_rollup`` the last of each run and task, without tasks that lost all attempts."""
    rest = [c for c in rows.columns if c not in ("run", "task", "version")]
    last = rows.groupBy("run", "task").agg(F.max_by(F.struct(*rest), "version").alias("_last"))
    return last.select("run", "task", "_last.*").where("attempts > 0")
