"""The pipeline against plain Python, stage by stage, on a small folder of tables."""

import collections
import hashlib
import math

import pytest
from test_operators import alike_groups, distance, exhaustive_tiles

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    out = tmp_path_factory.mktemp("tables")
    items = [(i, line(30)) for i in range(3)]
    texts = {i: "\n".join(line(15) for _ in range(4)) for i in range(120)}
    for i in range(0, 120, 6):
        texts[i] = " | ".join(word() for _ in range(80))
    texts[200] = texts[1]
    texts[201] = texts[2].replace(texts[2].split("\n")[0], line(15))
    texts[202] = f"{line(10)}\n{items[0][1]}\n{line(10)}"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "mix_sources":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in docs.collect()}
        seen[name], docs = {r["doc_id"]: r for r in after.collect()}, after
    kept = seen["quality_classifier"]
    assert sum(i % 6 == 0 for i in kept if i < 120) <= 1 and sum(i % 6 != 0 for i in kept if i < 120) >= 98
    lines = [x for r in seen["line_dedup"].values() for x in r["text"].split("\n") if x]
    assert max(collections.Counter(lines).values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"].values())
    assert 202 in seen["simhash_near_dedup"] and 202 not in seen["benchmark_decontamination"]
    ran = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in ran.collect()} == set(seen["mix_sources"])


def without_repeated_lines(rows):
    """(doc_id, text) less the lines that repeat an earlier one exactly or within an edit for each ten characters, two at most."""
    first = {}
    for i, text in sorted(rows):
        for p, line in enumerate(text.split("\n")):
            if line:
                first.setdefault(line, (i, p))
    bags = {x: collections.Counter(x) for x in first}
    near = collections.defaultdict(list)
    for a in first:
        for b in first:
            most = min(2, min(len(a), len(b)) // 10)
            if a < b and abs(len(a) - len(b)) <= most and sum(((bags[a] - bags[b]) + (bags[b] - bags[a])).values()) <= 2 * most and distance(a, b) <= most:
                near[a].append(b)
                near[b].append(a)
    gone = lambda i, p, x: x and (first[x] != (i, p) or any(first[n] < first[x] for n in near[x]))
    return [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if not gone(i, p, x))) for i, t in rows]


def mixed(rows, sources):
    """(doc_id, copy, shuffle_key) of a Poisson number of copies, inverted at a hash."""
    n = collections.Counter(sources[i] for i, _ in rows)
    total, weights = len(rows), sum(math.sqrt(x) for x in n.values())
    out = set()
    for i, _ in rows:
        rate = math.sqrt(n[sources[i]]) / weights * total / n[sources[i]]
        u = int(hashlib.md5(f"mix-1:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        for copy in range(1, k + 1):
            out.add((i, copy, int(hashlib.md5(f"mix-1:order:{i}:{copy}".encode()).hexdigest()[:15], 16)))
    return out


def test_rows_by_brute_force(spark, folder):
    import re

    from assayer.llm import quality

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {r["doc_id"] for r in quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r["score"] >= quality.ACCEPT}
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = without_repeated_lines([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good])
    rows = [min(rows[k] for k in group) for group in alike_groups(rows)]
    tokens = lambda t: re.findall(r"\w+", t.lower())
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    covered = lambda item, doc: sum(n for *_, n in exhaustive_tiles(item, doc)) if set(item) & set(doc) else 0
    dirty = {i for i, t in rows for item in items if len(set(item) & set(tokens(t))) >= 10 and covered(item, tokens(t)) >= 0.5 * len(item)}
    rows = [(i, t) for i, t in rows if i not in dirty]
    texts, ran = dict(rows), corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["copy"], r["shuffle_key"]) for r in ran} == mixed(rows, sources) and all(r["text"] == texts[r["doc_id"]] for r in ran)
    assert [r["shuffle_key"] for r in ran] == sorted(r["shuffle_key"] for r in ran) and len(ran) == len(mixed(rows, sources)) > 40
