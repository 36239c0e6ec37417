"""JSON arrays cut at byte ranges, against the json module."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from sparrowmill.sources import arrays as a
from sparrowmill.sources import samples as s


def _value(rng: random.Random, depth: int):
    kind = rng.randrange(6 if depth < 4 else 3)
    if kind == 0:
        return rng.choice([None, True, -1.5, 7])
    if kind in (1, 2):
        return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", " ", "\n", "é", "😀", "x", "\\" * 5]) for _ in range(rng.randrange(12)))
    if kind in (3, 4):
        return {f'k"{i}\\': _value(rng, depth + 1) for i in range(rng.randrange(3))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(3))]


def _cut(spark, path, chunk_bytes):
    rows = a.numbered_elements(a.array_files(spark, str(path), chunk_bytes), chunk_bytes).collect()
    return [json.loads(r.value) for r in sorted(rows, key=lambda r: (r.name, r.ord))], rows


@pytest.mark.parametrize("chunk_bytes", [3, 64, 1 << 20])
def test_elements_of_random_arrays(spark, tmp_path, chunk_bytes):
    rng, wanted = random.Random(chunk_bytes), []
    for name in "abc":
        values = [_value(rng, 0) for _ in range(4 if chunk_bytes == 3 else 40)]
        text = json.dumps(values, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"{name}.json").write_text({"a": "", "b": " \n", "c": "﻿ "}[name] + text + " \n", encoding="utf-8")
        wanted += values
    (tmp_path / "d.json").write_text(" [ \n ] ")
    (tmp_path / "e.jsonl").write_text('{"x": [1]}\n[2]\n')
    (tmp_path / "f.json").write_text("  \n")
    got, rows = _cut(spark, tmp_path, chunk_bytes)
    assert got == wanted
    assert [r.ord for r in sorted(rows, key=lambda r: (r.name, r.ord)) if r.name == "a.json"] == list(range(len(wanted) // 3))


@pytest.mark.parametrize("text", ["[1, 2", "[1,,2]", "[1,]", "[,1]", "[1] x", "[1][2]", "[1]]", '["a', "[1] [", "[[1]", "[", '[1, "a\\"]'])
@pytest.mark.parametrize("chunk_bytes", [2, 1 << 20])
def test_what_is_no_array_is_an_error(spark, tmp_path, text, chunk_bytes):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="Malformed array"):
        _cut(spark, tmp_path, chunk_bytes)


def test_an_element_longer_than_many_ranges_and_a_run_of_backslashes(spark, tmp_path):
    values = ["\\" * 1001, {"t": "[\"," * 700}, "end"]
    (tmp_path / "a.json").write_text(json.dumps(values))
    assert _cut(spark, tmp_path, 100)[0] == values


def test_one_array_is_read_by_several_tasks(spark, tmp_path):
    values = [{"instruction": f"q{i}", "output": "x" * (i % 90), "tier": i % 3} for i in range(4000)]
    (tmp_path / "a.json").write_text(json.dumps(values))
    files = a.array_files(spark, str(tmp_path), 20_000)
    each = a.array_elements(files, 20_000)
    assert each.select(F.spark_partition_id()).distinct().count() > 5
    assert each.count() == 4000


def test_samples_of_packed_and_plain_files_with_odd_names(spark, tmp_path):
    with gzip.open(tmp_path / "a b.json.gz", "wt") as f:
        f.write('[{"instruction": "i1", "output": "o1", "tier": "t"}, null]')
    (tmp_path / "ü%20 ü.json").write_text('[{"instruction": "i2"}]')
    (tmp_path / "l.jsonl").write_text('{"instruction": "i3"}\n')
    (tmp_path / "pretty.json").write_text('[\n{"instruction": "i4"}\n,\n{"instruction": "i5"}\n]')
    assert sorted((r.instruction or "") for r in s.read_samples(spark, str(tmp_path)).collect()) == ["", "i1", "i2", "i3", "i4", "i5"]
    assert sorted((r.instruction or "") for r in s.read_samples(spark, str(tmp_path), meta="meta").collect()) == ["", "i1", "i2", "i3", "i4", "i5"]


def test_written_arrays_come_back(spark, tmp_path):
    rows = spark.range(200).selectExpr("cast(id AS string) AS instruction", "if(id % 7 = 0, null, concat('a\"\\\\[', id)) AS output").repartition(5)
    a.write_arrays(rows, str(tmp_path / "out"))
    got = s.read_samples(spark, str(tmp_path / "out")).select("instruction", "output")
    assert got.count() == 200 and got.exceptAll(rows).isEmpty()
    a.write_arrays(rows.limit(0), str(tmp_path / "none"))
    assert _cut(spark, tmp_path / "none", 100)[0] == []


def test_arrays_are_cut_once_and_read_by_no_other_reader(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"instruction": "i1"}, {"instruction": "i2"}]')
    (tmp_path / "z.json").write_text(" [\n] ")
    rows = s.read_samples(spark, str(tmp_path), meta="meta")
    assert [r.instruction for r in rows.collect()] == ["i1", "i2"]
    assert "text" not in rows._jdf.queryExecution().executedPlan().toString().lower().replace("context", "")
    (tmp_path / "a.json").write_text('[{"instruction": "i1"}, {"instruction": "i2"}')
    rows = s.read_samples(spark, str(tmp_path))  # whether there is a row is seen from the first bytes
    with pytest.raises(Exception, match="Malformed array"):
        rows.collect()


def test_whether_an_array_has_an_element_is_seen_from_its_first_bytes(spark, tmp_path):
    texts = {"a": "[ \n ]", "b": "﻿ [" + " " * 9000 + "1]", "c": "[", "d": '{"x": 1}', "f": "[[]]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        f.write(" " * 5000 + "[" + "\n" * 5000 + "]")
    found = {r.name[0]: (r.head, r.filled) for r in a.probed_files(spark, str(tmp_path)).collect()}
    assert found == {"a": (0, False), "b": (4, True), "c": (0, False), "d": (None, None), "f": (0, True), "g": (5000, False)}
    for name in "bdf":
        (tmp_path / f"{name}.json").unlink()
    (tmp_path / "c.json").unlink()
    with pytest.raises(ValueError, match="no samples"):
        s.read_samples(spark, str(tmp_path))
