import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import audit, dedup, quota, runlog, seen
from sparrowmill.operators import windows as w
from sparrowmill.plans import jobs
from sparrowmill.sources import samples as s
from sparrowmill.sources.shared import shared_folder
from sparrowmill.streaming import ingest as t
from sparrowmill.streaming import stateful


def test_readers_and_writers(spark, tmp_path):
    lines = ['{"instruction": "a", "input": "b", "output": "c", "category": "x"}', "", "not json", '{"instruction": "d"}']
    (tmp_path / "l.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "a.json").write_text('[{"instruction": "a"},\n {"instruction": "b", "output": ""}]', encoding="utf-8")
    (tmp_path / "bad.json").write_text('[{"instruction": "a"},', encoding="utf-8")
    (tmp_path / "empty.jsonl").write_text("\n\n", encoding="utf-8")
    got = s.read_samples(spark, str(tmp_path / "l.jsonl"), "category string")
    assert [(r.instruction, r.output, r.category) for r in got.collect()] == [("a", "c", "x"), ("d", None, None)]
    assert tuple(s.count_unanswered(got).first()) == (2, 1)
    assert s.read_samples(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(Exception):
        s.read_samples(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError):
        s.read_samples(spark, str(tmp_path / "empty.jsonl"))
    (tmp_path / "p.json").write_text(json.dumps([{"name": "P", "alias": ["x"], "price": "¥1"}, {"name": "Q"}]), encoding="utf-8")
    assert [(r.name, r.alias, r.ord) for r in s.read_products(spark, str(tmp_path / "p.json")).collect()] == [("P", ["x"], 0), ("Q", None, 1)]
    (tmp_path / "s.jsonl").write_text('{"label": "N1", "text": "q"}\n{"sarcasm_label": "S1", "label": "x", "text": "r"}\n{"text": "z"}', encoding="utf-8")
    assert sorted(r.label for r in s.read_seeds(spark, str(tmp_path / "s.jsonl")).collect()) == ["", "N1", "S1"]
    (tmp_path / "q1.jsonl").write_text('{"instruction": " a ", "output": "1"}\n{"instruction": "b"}\nxx', encoding="utf-8")
    (tmp_path / "q2.jsonl").write_text('{"instruction": "a", "output": "2"}\n{"instruction": "c", "output": "3"}', encoding="utf-8")
    qa = s.read_qa(spark, str(tmp_path / "q1.jsonl"), str(tmp_path / "q2.jsonl"))
    kept = dedup.keep_first(qa, "instruction", ["file", "line"])
    assert sorted(r.output for r in kept.collect()) == ["1", "3"]
    assert dedup.keep_first(kept, "instruction", ["file", "line"]).count() == 2
    assert {(r.file, r.raw, r.unique, r.duplicates) for r in dedup.file_counts(qa, "instruction").collect()} == {("q1.jsonl", 1, 1, 0), ("q2.jsonl", 2, 2, 0), (None, 3, 2, 1)}
    assert [r.output for r in dedup.not_seen(qa, qa.where("file = 'q1.jsonl'"), "instruction").collect()] == ["3"]
    s.write_corpus(kept, str(tmp_path / "out"))
    s.append_rows(kept, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    prompts = spark.createDataFrame([("t", ["ask {category}", "no"])], "type string, seed_prompts array<string>")
    assert [r.instruction for r in s.seed_prompt_rows(prompts, {"category": "phones"}).collect()] == ["ask phones", "no"]


def test_audits(spark):
    rows = [("A one\nB two「x」C", True, "x"), ("A B E", False, "x"), ("B then A 'q' C", True, "y"), (None, None, "y")]
    df = spark.createDataFrame(rows, "cot string, is_sarcastic boolean, label string")
    out = audit.section_audit(df, ["A", "B"], unflagged=["E"], keywords=["then"], span=("B", "C"), quotes=["「", '"']).collect()
    assert [(r.issues, len(r.warnings), r.passed) for r in out] == [([], 1, True), ([], 1, True), ([], 1, True), (["A", "B", "E"], 0, False)]
    totals = audit.audit_totals(audit.section_audit(df, ["A", "B"], unflagged=["E"]), "label")
    assert {tuple(r) for r in totals.collect()} == {("x", 2, 2, 0, 0), ("y", 2, 1, 0, 1)}
    rules = spark.createDataFrame([("S", "require", "yes", "no yes"), ("N", "warn_forbid", "deep", "deep part"), ("*", "require", "not", "no not")], "type string, kind string, needle string, message string")
    tasks = spark.createDataFrame([("T", "Task", "field")], "id string, name string, output_field string")
    typed = spark.createDataFrame([("yes 【三、Task分析】 field", "S", "T", "o"), ("deep", "N", "unknown", ""), ("x", "Q", "T", None)], "cot string, bridge_type string, task_id string, task_output string")
    got = audit.typed_audit(typed, rules, tasks).collect()
    assert [(r.issues, r.warnings) for r in got] == [([], []), (["no output"], ["deep part"]), (["no not", "no section on Task", "no field field", "no output"], [])]
    texts = [("one", "a")] + [("dup", "a"), ("dup", "a")] + [("near", "abc"), ("near", "abd")] + [("open", f"same {'x' * i * 5}") for i in range(6)] + [("fine", "q" * 30), ("fine", "r")]
    d = audit.diversity(spark.createDataFrame(texts, "label string, text string"))
    assert {r.label: r.verdict for r in d.collect()} == {"one": "pass", "dup": "duplicate_text", "near": "narrow_lengths", "open": "repeated_openings", "fine": "pass"}
    with pytest.raises(ValueError, match="label: x"):
        audit.require_known(df, "label", spark.createDataFrame([("y",)], "label string"), "label")


def test_quotas_requests_and_responses(spark):
    labels = spark.createDataFrame([("S1", True, "Irony", True), ("N1", False, "Plain", False)], "label string, flagged boolean, name string, is_sarcastic boolean")
    combos = quota.combinations(labels, spark.createDataFrame([("SA",), ("ER",)], "task string"), spark.createDataFrame([("S", 50), ("N", 30), ("C", 30)], "type string, target int"))
    assert {r.combined for r in combos.collect()} == {f"BX-{x}-{t}-{k}" for t in ("SA", "ER") for x, k in (("S1", "S"), ("N1", "N"), ("N1", "C"))}
    quotas = spark.createDataFrame([("S1", 7), ("N1", 2)], "label string, target int")
    existing = spark.createDataFrame([("N1", 5), ("__unknown__", 1)], "label string, n long")
    assert {r.label: r.need for r in quota.remaining(quotas, existing).collect()} == {"S1": 7, "N1": 0}
    seeds = spark.createDataFrame([("S1", i, f"seed {i}") for i in range(5)], "label string, line long, text string")
    reqs = jobs.plan_requests(quotas, existing, labels.select("label", "name", F.lit("d").alias("description")), seeds, "{count} of {name}: {seeds} {other}", 4).orderBy("batch").collect()
    assert [(r.label, r.batch_size, r.request) for r in reqs] == [("S1", 4, "4 of Irony: seed 0\nseed 1\nseed 2 {other}"), ("S1", 3, "3 of Irony: seed 0\nseed 1\nseed 2 {other}")]
    spec = quota.rotated(spark.range(150).withColumnRenamed("id", "slot").withColumn("f", F.col("slot") % 2 == 0), {"scene": list("abcdefghi"), "tone": ["x", "y"]}, ["s", "m", "l"], "f", "tone").orderBy("slot").collect()
    assert [r.scene for r in spec[:10]] == list("abcdefghia") and spec[1].tone is None and (spec[0].length, spec[72].length) == ("s", "m")
    texts = ['[{"text": "a"}]', '```json\n[{"text": "b", "label": "Q"}, {"text": "c"}]\n```', 'Here: [{"text": "d", "is_sarcastic": true}] done', '{"samples": [{"text": "e"}]}', '{"data": [{"text": "f"}]}', "none", 'say {"data": [{"text": "g"}]} ok']
    df = spark.createDataFrame([("S1", x) for x in texts], "label string, content string")
    found, rejects = quota.parse_responses(df)
    full = quota.fill_defaults(found, labels)
    assert sorted(r.text for r in full.collect()) == list("abcdefg")
    assert {(r.label, r.category, r.is_sarcastic) for r in full.collect()} == {("S1", "Irony", True), ("Q", "Irony", True)}
    assert [r.error for r in rejects.collect()] == ["no samples in: none"]
    assert quota.augmentations(labels, spark.createDataFrame([("k", "rewrite {name}")], "kind string, template string")).count() == 2
    lines = quota.constraint_lines(spark.createDataFrame([(1, 0, "p"), (1, 1, "q")], "b int, o int, x string"), ["b"], "o", F.col("x")).first().constraints
    assert lines == "1. p\n2. q"


def test_run_logs(spark):
    text = ["── TASK: build ──────", "[10:00:01] INFO start", "[10:00:02] FAIL compile", "[10:00:03] PASS compile", "── TASK: ship ──", "[10:00:04] FAIL push", "[10:00:05] FAIL push"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(text)], "run string, line long, text string")
    rows = runlog.carry_task(runlog.parse_lines(df)).where("level in ('PASS', 'FAIL')").selectExpr("run", "task", "message AS step", "level = 'PASS' AS ok", "line")
    roll = runlog.run_rollup(rows)
    assert {tuple(r) for r in roll.collect()} == {("r", "build", 1, 2, 1, 1, 0, "PASS"), ("r", "ship", 1, 2, 0, 2, 1, "FAIL")}
    assert tuple(runlog.overall(roll).first()) == (2, 1, "FAIL")


def test_one_run_is_filled_range_by_range(spark):
    rows = [("long" if i % 20 else "short", i, f"h{i}" if i % 97 == 5 or (i % 20 == 0 and i % 60 == 0) else None) for i in range(2000)] + [(None, i, "n" if i == 3 else None) for i in range(9)]
    df = spark.createDataFrame(rows, "run string, line long, heading string").repartition(5)
    want, last = set(), {}
    for run, line, heading in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        last[run] = heading or last.get(run)
        want.add((run, line, heading, last[run]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = runlog.carry_task(df)
    assert {tuple(r) for r in out.collect()} == want and runlog.carry_task(df.limit(0)).count() == 0
    assert w.in_ranges(df, ["run"], ["line"]).where("run = 'long'").select("_range").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_with_and_without_a_key(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], i * 7 % 31, "text" * i) for i in range(100)] + [(None, None, None, None)], "id long, g string, o long, text string")
    for key in (None, ["id"]):
        got = {r.id: r.p for r in w.numbered(df, ["g"], ["o", "id"], "p", key).collect()}
        for g in "ab":
            order = sorted((i * 7 % 31, i) for i in range(100) if "ab"[i % 3 == 0] == g)
            assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
        assert got[None] == 1
    assert w.preview(df).count() == 5 and [r.id for r in w.preview(df, at_random=3, keys=["id"]).collect()] == [r.id for r in w.preview(df.repartition(7), at_random=3, keys=["id"]).collect()]


def test_keep_first_sends_a_text_once_a_task(spark):
    df = spark.createDataFrame([(i, [" x ", "x", None, "y"][i % 4], {"k": i}) for i in range(40)], "id long, t string, m map<string,int>").repartition(4)
    assert {tuple(r) for r in dedup.keep_first(df, "t", ["id"]).select("id", "t", "m.k").collect()} == {(0, " x ", 0), (2, None, 2), (3, "y", 3)}
    assert "Window" not in dedup.keep_first(df, "t", ["id"])._jdf.queryExecution().toString()


def test_seen_filter(spark, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK", 4)
    old = spark.createDataFrame([(f" k{i} ",) for i in range(500)] + [(None,)] * 3, "t string").repartition(4)
    new = spark.createDataFrame([(i, f"k{i % 900}") for i in range(1000)] + [(2000, None), (2001, ""), (2002, "k5\n")], "id long, t string").repartition(3)
    path = shared_folder(spark, "seen")
    seen.make_store(old.where("t is null or t < ' k3'"), "t", path, expected=500)
    later = old.where("t >= ' k3'").select(seen.key_digest("t").alias("digest")).distinct()
    seen.add_to_store(later, path)
    want = {i for i in range(1000) if i % 900 >= 500} | {2001}
    out = seen.unseen_rows(new, "t", path)
    assert {r.id for r in out.collect()} == want and out.columns == ["id", "t"]
    # What passes the filter without a hit meets no exchange: one branch of the union is a scan alone.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and plan.strip().startswith("Union")
    monkeypatch.setattr(seen, "BROADCAST_BYTES", 1)
    assert {r.id for r in seen.unseen_rows(new, "t", path).collect()} == want
    filters = spark.read.parquet(f"{path}/filter")
    assert filters.count() > filters.select("chunk").distinct().count() > 1  # parts of two generations


def test_jobs(spark):
    samples = spark.createDataFrame([(i, f"say {i}", "", str(i), "ab"[i % 2]) for i in range(8)], "sample_id long, instruction string, input string, output string, g string").repartition(2)

    def respond(prompts):
        if any("7" in p for p in prompts):
            raise RuntimeError("lost")
        return [p.split()[1] for p in prompts]

    sizes = jobs.answer(samples, lambda prompts: [str(len(prompts))] * len(prompts), batch_size=3)
    assert sorted(r.prediction for r in sizes.collect()) == ["1", "1", "3", "3", "3", "3", "3", "3"] or samples.groupBy(F.spark_partition_id()).count().where('count != 4').count() > 0
    four = jobs.answer(samples.coalesce(1), respond, batch_size=4)
    assert four.where("error like '%lost%'").count() == 4 and four.where("error is null").count() == 4
    assert [r.sample_id for r in jobs.answer(samples.coalesce(1), respond, batch_size=4, narrow=True).where("error is not null").collect()] == [7]
    short = jobs.answer(samples, lambda prompts: prompts[1:], batch_size=2).collect()
    assert len(short) == 8 and all("answers to" in r.error for r in short)
    predictions = jobs.answer(samples, respond)
    rows, summary, groups, fields, unknown = jobs.evaluate(samples.drop("error"), predictions, ["exact_match", "nope"], "g")
    assert fields is None and unknown == ["nope"]
    one = summary.first()
    assert one.total == 8 and one.errors >= 1 and one.exact_match == 1.0 and rows.where("error like '%lost%'").count() == one.errors
    assert groups.where("group_value is null").count() == 1
    base = spark.createDataFrame([("t", i, float(i)) for i in range(4)], "tensor string, pos long, value double")
    distances, cosines = jobs.compare_models(base, {"x": base.withColumn("value", F.col("value") + 1), "y": base.withColumn("value", F.col("value") - 1)})
    assert {r.task: r.l1 for r in distances.collect()} == {"x": 4.0, "y": 4.0} and cosines.first()["class"] == "conflicting"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "S1-1.txt").write_text('[{"text": "a"}, {"text": "b"}]')
    (tmp_path / "in" / "N1-2.txt").write_text("nothing")
    run = lambda: t.ingest(t.response_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "S1-3.txt").write_text('[{"text": "c"}]')
    run()  # resumes after what is done
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    assert spark.read.json(str(tmp_path / "out-rejects")).count() == 1
    rows = spark.createDataFrame([(f"k{i % 3} ", "x" if i % 2 else "y", i) for i in range(20)], "key string, label string, n long")
    rows.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "rows"))

    def result(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    assert dict(result(t.label_counts(stream), "complete", "c1")) == {"x": 10, "y": 10}
    stateful.with_state_store(spark)
    assert sorted(r[2] for r in result(stateful.first_seen(stream, "key", ["n"]), "append", "c2")) == [0, 1, 2]
    assert sorted((r[1], r[2]) for r in result(stateful.capped(stream, "label", {"x": 4, "y": 1}, order=["n"]), "append", "c3")) == [("x", 1), ("x", 3), ("x", 5), ("x", 7), ("y", 0)]
    seen = []
    t.for_each_batch(stream, lambda b: seen.append(b.count()), str(tmp_path / "c4")).awaitTermination()
    assert sum(seen) == 20


def test_live_rollup_of_lines_in_any_order(spark, tmp_path):
    """Lines of a run come in three files, some before the heading above them; the last view equals the batch."""
    text = {0: "── TASK: build ──", 1: "[10:00:01] FAIL compile", 2: "[10:00:02] PASS compile", 3: "[10:00:03] INFO well", 4: "── TASK: ship ──", 5: "[10:00:04] FAIL push", 6: "[10:00:05] PASS sign", 7: "[10:00:06] FAIL push", 8: "── TASK: build ──", 9: "[10:00:07] FAIL test"}
    rows = {n: ("r", n, x, datetime.datetime(2024, 1, 1, 0, n)) for n, x in text.items()}
    schema = "run string, line long, text string, at timestamp"
    for part in ([1, 0, 5, 2], [7, 3, 4], [9, 6, 8]):
        spark.createDataFrame([rows[n] for n in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "lines"))
    stateful.with_state_store(spark)
    views = {}
    for delay in ("5 minutes", "1 hour"):
        live = stateful.live_rollup(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines")), "at", delay)
        name = "live_" + delay.split()[0]
        live.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(100)
        assert {tuple(r) for r in stateful.newest(spark.table(name)).collect()} == {("r", "build", 2, 3, 1, 2, 1, "FAIL"), ("r", "ship", 2, 3, 1, 2, 1, "FAIL")}
        views[delay] = {tuple(r)[:5] for r in spark.table(name).collect()}
    # Before its heading came, the push at line 5 counted for the task above.
    assert ("r", "build", 2, 3, 1) in views["1 hour"]


def test_first_seen_state_stays_in_its_span(spark, tmp_path):
    """Many batches of new keys with a short time to live: state rows stay below those of all keys."""
    stateful.with_state_store(spark)
    schema = "key string, n long"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stateful.first_seen(stream, "key", ["n"], kept_ms=2000).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    states = []
    try:
        for i in range(6):
            spark.createDataFrame([(f"k{i}-{j % 40}", j) for j in range(80)] + [("again", i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            until = time.time() + 20
            while time.time() < until and spark.table("firsts").where(f"key like 'k{i}-%'").count() < 40:
                time.sleep(0.5)
            states += [x.numRowsTotal for p in query.recentProgress for x in p.stateOperators]
    finally:
        query.stop()
    got = spark.table("firsts").collect()
    assert sorted((r.key, r.n) for r in got if r.key != "again") == sorted((f"k{i}-{j}", j) for i in range(6) for j in range(40))
    assert len([r for r in got if r.key == "again"]) > 1  # its first row, and again once the state forgot it
    assert max(states[-3:]) < 6 * 41


def test_rotation_of_other_dimensions_and_numbering_in_ranges(spark):
    rows = spark.range(400).selectExpr("id AS slot", "if(id % 4 = 0, null, 'k') AS kind").repartition(7)
    out = quota.rotated(rows, {"scene": list("abcd"), "tone": list("xyz")}, ["s", "m", "l"], kind=["kind"]).collect()
    for kind in (None, "k"):
        own = sorted((r for r in out if r.kind == kind), key=lambda r: r.slot)
        assert [(r.scene, r.tone, r.length) for r in own] == [("abcd"[i % 4], "xyz"[i % 3], "sml"[(i + i // 12) % 3]) for i in range(len(own))]
    whole = quota.rotated(rows, {"scene": list("ab")}, ["s", "m"]).orderBy("slot").collect()
    assert [r.length for r in whole] == ["sm"[(i + i // 2) % 2] for i in range(400)]


def test_a_folder_with_an_array_file_and_a_lines_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"instruction": "i1", "output": "o1"},\n {"instruction": "i2", "output": "o2"}]')
    (tmp_path / "b.jsonl").write_text('{"instruction": "i3"}\n\n[bad\n{"instruction": "i4", "output": "o4"}\n')
    got = s.read_samples(spark, str(tmp_path))
    assert sorted((r.instruction, r._file) for r in got.collect()) == [("i1", "a.json"), ("i2", "a.json"), ("i3", "b.jsonl"), ("i4", "b.jsonl")]


def test_lines_keep_their_order_over_parts_and_arguments(spark, tmp_path):
    rows = [json.dumps({"instruction": f"q{i}", "output": "x" * (i % 50), "text": str(i), "label": "L"}) for i in range(400)]
    (tmp_path / "z.jsonl").write_text("\n".join(rows[:300]), encoding="utf-8")
    (tmp_path / "a.jsonl").write_text("\n".join(rows[300:]), encoding="utf-8")
    (tmp_path / "run.log").write_text("\n".join(f"line {i}" for i in range(500)), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key in before:
        spark.conf.set(key, "2000b")
    try:
        qa = s.read_qa(spark, str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl"))
        assert [r.instruction for r in qa.orderBy("line").collect()] == [f"q{i}" for i in range(400)]
        assert qa.rdd.getNumPartitions() > 2
        log = s.read_run_log(spark, str(tmp_path / "run.log"))
        assert [r.text for r in log.orderBy("line").collect()] == [f"line {i}" for i in range(500)]
        assert quota.seeds_of(s.read_seeds(spark, str(tmp_path / "z.jsonl"))).first().seeds == ["0", "1", "2"]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_requests_with_specs(spark):
    quotas = spark.createDataFrame([("S1", 3), ("N1", 0)], "label string, need int")
    slots = quota.batch_slots(quotas, 2)
    assert sorted((r.batch, r.slot) for r in slots.collect()) == [(0, 0), (0, 1), (1, 2)]
    specs = quota.rotated(slots, {"scene": ["a", "b"]}, [("s", 1, 5), ("l", 6, 9)], kind=["label"])
    lines = quota.constraint_lines(specs, ["label", "batch"], "slot", F.concat_ws(" ", "scene", "length", "min_len", "max_len"))
    dim, seeds = spark.createDataFrame([], "label string, name string, description string"), spark.createDataFrame([], "label string, line long, text string")
    got = quota.requests(quotas, dim, seeds, "{count}: {constraints}", 2, constraints=lines).orderBy("batch").collect()
    assert [r.request for r in got] == ["2: 1. a s 1 5\n2. b l 6 9", "1: 1. a l 6 9"]
