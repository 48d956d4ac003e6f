"""The near-duplicate stage of the pipeline takes its first pairs from SimHash and BK-trees."""

import random


def test_one_of_each_goes_through_simhash(spark, monkeypatch):
    from assayer.llm import near_dedup

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(300)]
        texts += [" ".join(words), " ".join([*words[:-1], word()]), " ".join(words).upper()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    links, pairs = near_dedup.links, near_dedup.simhash_pairs
    monkeypatch.setattr(near_dedup, "links", lambda fps, radius=3: seen.append(fps.count()) or links(fps, radius))
    monkeypatch.setattr(near_dedup, "simhash_pairs", lambda *a: seen.append([tuple(r) for r in pairs(*a).collect()]) or pairs(*a))
    assert {r["doc_id"] for r in near_dedup.one_of_each(docs).collect()} == {3 * i for i in range(12)}
    found = next(x for x in seen if isinstance(x, list))
    prints = {r["row"]: r["node"] for r in near_dedup.shingle_sets(docs.selectExpr("doc_id as row", "text")).collect()}
    fps = [int(x) for x in near_dedup.simhash([t.encode() for t in texts], near_dedup.WORDS)]
    close = {tuple(sorted((prints[3 * i], prints[3 * i + 1]))) for i in range(12) if (fps[3 * i] ^ fps[3 * i + 1]).bit_count() <= 3}
    assert close and set(found) == close and all(prints[3 * i] == prints[3 * i + 2] for i in range(12))
