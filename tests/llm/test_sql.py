"""Every query that has SQL against it in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from assayer.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


def flat(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, FOLDER)
    cur = con.execute(oracle_sql()[name])
    assert flat(df.columns, [tuple(r) for r in df.collect()]) == flat([c[0] for c in cur.description], cur.fetchall())


def test_xxh64_in_sql():
    import random

    import xxhash

    from assayer.llm.oracles import xxh64

    rnd = random.Random(1)
    texts = ["", "é"] + ["".join(rnd.choice("abcdé ñ\U0001F600Z") for _ in range(rnd.randrange(150))) for _ in range(200)] + ["x" * n for n in range(100)]
    con = duckdb.connect()
    con.execute("CREATE TABLE g (s VARCHAR)")
    con.executemany("INSERT INTO g VALUES (?)", [(t,) for t in texts])
    assert dict(con.execute(f"WITH RECURSIVE {xxh64('t', 'g')} SELECT s, h FROM t").fetchall()) == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
