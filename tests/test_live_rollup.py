"""The live roll-up of one run, turn by turn, on a state that is a dict."""

import random
import tracemalloc

import pandas as pd
import pytest

from sparrowmill.streaming.stateful import LiveRollup


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value

    def clear(self):
        self.now = None


class Entries(dict):
    def exists(self):
        return bool(self)

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        del self[k]


class Several(Value):
    def put(self, values):
        self.now = list(values)


class Handle:
    def __init__(self):
        self.state, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.state.setdefault(name, Entries())

    def getValueState(self, name, *_):
        return self.state.setdefault(name, Value())

    def getListState(self, name, *_):
        return self.state.setdefault(name, Several())

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def frame(lines):
    return pd.DataFrame([("r", *x) for x in lines], columns=["run", "line", "at_ms", "heading", "step", "ok"])


def rolled(lines):
    """(task: steps, attempts, passes, failures, exhausted, status) of lines, by going through them."""
    found, task = {}, None
    for _, _, heading, step, ok in sorted(lines, key=lambda x: x[0]):
        if heading is not None:
            task = heading
        elif task is not None:
            one = found.setdefault(task, {}).setdefault(step, [0, 0, True])
            one[0], one[1], one[2] = one[0] + 1, one[1] + ok, ok
    out = {}
    for task, steps in found.items():
        tries, good, bad = (sum(x) for x in zip(*((t, g, not f) for t, g, f in steps.values()), strict=True))
        out[task] = (len(steps), tries, good, tries - good, bad, "FAIL" if bad else "PASS")
    return out


@pytest.mark.parametrize("stretch, part", [(5, 2), (37, 7), (200_000, 20_000)])
@pytest.mark.parametrize("stuck", [False, True])
def test_turns_show_what_all_lines_so_far_come_to(stretch, part, stuck):
    """Lines come up to 60 ms late; with ``stuck`` times start anew in the middle, so that most lines wait."""
    draw = random.Random(stretch + stuck)
    lines = []
    for n in range(600):
        head = draw.random() < 0.3
        lines.append((n, n % 300 if stuck else n, f"t{draw.randrange(40)}" if head else None, None if head or draw.random() < 0.1 else f"s{draw.randrange(4)}", None if head else draw.random() < 0.6))
    come = sorted(lines, key=lambda x: (x[1] + draw.randrange(60), x[0]))
    handle, processor, views, sent = Handle(), LiveRollup(stretch, part), {}, []
    processor.init(handle)
    for i in range(0, len(come), 75):
        clock = Clock(max([x[1] for x in sent], default=60) - 60)
        new = come[i : i + 75]
        sent += new
        shown = [*processor.handleInputRows(("r",), iter([frame(new[:40]), frame(new[40:])]), clock)]
        due = [t for t in handle.timers if t <= clock.watermark]
        handle.timers = [t for t in handle.timers if t > clock.watermark]
        for _ in due:
            shown += processor.handleExpiredTimer(("r",), clock, None)
        for row in pd.concat(shown).itertuples(index=False):
            views[row.task] = max(views.get(row.task, (0,)), (row.version, *row[2:8]))
        assert {t: v[1:] for t, v in views.items() if v[2]} == rolled(sent)
    for _ in processor.handleExpiredTimer(("r",), Clock(10_000), None):
        pass
    assert not handle.state["lines"] and not handle.state["waiting"].exists()


def test_memory_does_not_follow_the_lines_of_a_run():
    peaks = []
    for chunks in (10, 40):
        handle, processor = Handle(), LiveRollup()
        processor.init(handle)
        rows = (frame((i * 5000 + j, j, f"t{j}", None, None) if j % 2 == 0 else (i * 5000 + j, j, None, f"s{j % 3}", True) for j in range(5000)) for i in range(chunks))
        tracemalloc.start()
        for _ in processor.handleInputRows(("r",), rows, Clock(0)):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0]
