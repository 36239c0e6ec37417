import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import warc as w
from sparrowmill.llm.id_ranges import IdRanges, cuts_below
from sparrowmill.llm.storage import new_folder

ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, None, None), (4, "http://x\r\nevil: 1", ""), (5, "u", "é" * 50_000), (6, "u", "only"), (7, "u", "é" * 50_000), (7, "v", "other"), (7, "v", "other"), (None, "n", "only"), (None, "n", "zz")]


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def test_records_and_revisits(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, shard string").repartition(3)
    manifest = w.write_archives(df, new_folder(spark, "w"), shard_bytes=20_000, file_bytes=400)
    out = w.read_archives(manifest).collect()
    last, rows = defaultdict(list), defaultdict(int)
    for i, _, h in ROWS:
        if i is not None:
            last[h or ""].append(i)
    want = []
    for i, _, h in ROWS:
        body, top = (h or "").encode(), max(last[h or ""], default=None)
        rows[i, h] += 1
        revisit = i is not None and (i != top or rows[i, h] > 1)
        want.append((i, len(body), digest(body), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == sorted(want, key=repr)
    assert all((r.payload is not None) == (r.record_type == "response") for r in out)
    assert sum(r.n_records for r in manifest.collect()) == len(ROWS) and manifest.count() > 3
    some = w.read_archives(w.write_archives(df, new_folder(spark, "w"), min_bytes=12)).where("record_type = 'revisit'").collect()
    assert {(r.page_id, r.refers_to) for r in some} == {(5, 7)}
    assert w.read_archives(w.write_archives(df.limit(0), new_folder(spark, "w"))).count() == 0


def test_files_are_the_same_on_every_run_and_well_formed(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    runs = []
    for parts in (1, 4):
        manifest = w.write_archives(df.repartition(parts), new_folder(spark, "w"), shard_bytes=20_000).collect()
        runs.append(sorted((Path(r.name).name, r.n_bytes, r.sha256) for r in manifest))
        for r in manifest:
            path = Path(r.name.removeprefix("file://"))
            assert hashlib.sha256(path.read_bytes()).hexdigest() == r.sha256 and not list(path.parent.glob("*.tmp-*"))
            text = gzip.decompress(path.read_bytes())
            assert text.count(b"WARC/1.1\r\n") == r.n_records and b"\r\nevil" not in text
    assert [x[1:] for x in runs[0]] == [x[1:] for x in runs[1]]


def test_damage_is_found():
    raw = w.record_bytes(1, "s", 0, "u", b"payload", None)
    assert w.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        w.parse_record(raw.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))


def test_reading_checks_the_manifest_and_writing_again_keeps_it(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    folder = new_folder(spark, "w")
    manifest = w.write_archives(df, folder, shard_bytes=20_000)
    files = sorted(map(tuple, manifest.collect()))
    # A task that is run again meets the files of its first attempt, one of them cut short.
    Path(files[0][0].removeprefix("file://")).write_bytes(b"cut")
    again = w.write_archives(df, folder, shard_bytes=20_000)
    assert sorted(map(tuple, again.collect())) == files and w.read_archives(again).count() == len(ROWS)
    assert not list(Path(folder.removeprefix("file://")).glob("*.tmp-*"))
    for column, value in (("n_records", F.col("n_records") + 1), ("sha256", F.lit("0")), ("n_bytes", F.col("n_bytes") + 1)):
        with pytest.raises(Exception, match="not what the manifest says"):
            w.read_archives(manifest.withColumn(column, value)).count()


def test_cuts_are_found_in_two_steps(spark):
    for n in (0, 1, 2, 9, 100, 1001):
        cuts = [3 * i for i in range(n)]
        rows = spark.range(-5, 3 * n + 5, 1).select("id", cuts_below(F.col("id"), cuts).alias("k")).collect()
        assert all(r.k == sum(c <= r.id for c in cuts) for r in rows)


def test_heavy_ids_have_shards_of_their_own_in_order(spark):
    ranges = IdRanges([10, 20], {None: 3, 5: 2, 10: 4, 25: 2})
    rows = spark.range(0, 30).selectExpr("id").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS id"))
    got = {r.id: (r.a, r.n) for r in rows.select("id", ranges.first(F.col("id")).alias("a"), ranges.pieces(F.col("id")).alias("n")).collect()}
    assert got[None] == (0, 3) and {i: n for i, (_, n) in got.items() if n > 1} == {None: 3, 5: 2, 10: 4, 25: 2}
    at = 2  # the last shard so far
    for i in range(30):
        a, n = got[i]
        assert a > at if n > 1 or got.get(i - 1, (0, 3))[1] > 1 else a >= at
        at = a + n - 1
    assert at < ranges.count


def test_pages_of_one_id_or_of_none_spread_over_shards(spark):
    rows = [(None, f"http://n/{i % 7}", f"<p>{i % 290}</p>" * 40) for i in range(300)] + [(5, f"http://f/{i}", f"<p>{i % 190}</p>" * 40) for i in range(200)]
    rows += [(9, None, f"<p>{i}</p>" * 40) for i in range(3)] + [(None, None, None)] * 4
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    runs = []
    for parts in (1, 4):
        manifest = w.write_archives(df.repartition(parts), new_folder(spark, "w"), shard_bytes=20_000)
        assert manifest.where("n_records > 150").count() == 0 and manifest.count() >= 8
        runs.append(sorted((Path(r.name).name, r.n_bytes, r.sha256) for r in manifest.collect()))
        out = w.read_archives(manifest).collect()
        assert len(out) == len(rows)
        top = {h: max(i for i, _, g in rows if g == h and i is not None) for h in {h for i, _, h in rows if i is not None}}
        want = sorted(((i, digest((h or "").encode())) for i, _, h in rows), key=repr)
        assert sorted(((r.page_id, r.payload_digest) for r in out), key=repr) == want
        first = [r for r in out if r.page_id is not None and r.record_type == "response"]
        assert len(first) == len(top) and {(r.page_id, r.payload_digest) for r in first} == {(i, digest(h.encode())) for h, i in top.items()}
        assert all(r.record_type == "response" for r in out if r.page_id is None)
        ids = [line for r in manifest.collect() for line in gzip.decompress(Path(r.name.removeprefix("file://")).read_bytes()).decode().split("\r\n") if line.startswith("WARC-Record-ID")]
        assert len(set(ids)) == len(rows)
    assert runs[0] == runs[1]
