"""Every catalogue query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from assayer.plans.catalogue import ORACLES, QUERIES
from assayer.streaming.scoring import append_new, assign_stream

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def flat(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cur = duck.execute(ORACLES[name])
    assert flat(df.columns, [tuple(r) for r in df.collect()]) == flat([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_scores_are_probabilities(spark, name):
    got = [r["score"] for r in QUERIES[name](spark, FOLDER).collect()]
    assert got and all(0 <= s <= 1 for s in got)


def test_stream_gives_the_same_assignments(spark, tmp_path):
    from assayer.plans.catalogue import spec
    from assayer.sources.tables import read

    orders = read(spark, FOLDER, "orders")
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(FOLDER)
    append_new(assign_stream(stream, spec()), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = QUERIES["split_assignment"](spark, FOLDER)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(want).count() == 0 and spark.read.parquet(str(tmp_path / "out")).count() == want.count()
