"""Lines' keys are made once, and of a frequent line once."""

import pytest
from pyspark.sql import functions as F

from assayer.llm import line_dedup

TEXTS = ["a common line of some length\nthe quick brown fox jumps", None, "a common line of some length\nthe quick brown fix jumps\na common line of some length", "", "a common line of some lengths\nshort"]


def rows(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"], r["text"], r["removed"], r["n_links"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("often", [1, 2])
def test_frequent_lines_give_the_same_rows(spark, monkeypatch, often):
    docs = spark.createDataFrame([*enumerate(TEXTS * 3), (None, TEXTS[0]), (4, TEXTS[2])], "doc_id long, text string")
    want = rows(line_dedup.dedup_lines(docs))
    assert sum(r[4] for r in want) > 0
    monkeypatch.setattr(line_dedup, "OFTEN", often)
    monkeypatch.setattr(line_dedup, "SHARE", 0.0)
    firsts = spark.createDataFrame([(1, 1, 0, often), (2, 2, 5, often + 1)], "id long, id2 long, first long, n long")
    assert [r["id"] for r in line_dedup._frequent(firsts).collect()] == [2]
    assert rows(line_dedup.dedup_lines(docs)) == want
    assert rows(line_dedup.dedup_lines(docs, once=False)) == want


def test_lines_are_cut_into_keys_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    own = line_dedup.lines
    monkeypatch.setattr(line_dedup, "lines", lambda docs: own(docs).mapInArrow(count, "doc_id long, pos int, line string"))
    docs = spark.createDataFrame([*enumerate(TEXTS * 3)], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).agg(F.sum("n_links")).first()[0] > 0
    n = own(docs).count()
    assert seen.value == 2 * n  # once for their numbers, once for their keys
