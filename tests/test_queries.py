"""Every query of the library against its SQL in DuckDB, and the entry module without the pipeline."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sparrowmill import queries

DATA = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(plain, (r[c] for c in columns))) for r in df.collect())
    assert rows or name in SQL
    if name in SQL:
        con = duckdb.connect()
        for f in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        assert Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()) == rows


def test_entry_without_the_pipeline(tmp_path):
    root = Path(__file__).parent.parent
    (tmp_path / "sparrowmill").mkdir()
    for p in root.joinpath("sparrowmill").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "sparrowmill" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'turn_bleu' in q and 'pipeline' not in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
