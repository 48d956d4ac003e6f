"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

RND = random.Random(7)
WORDS = ["the", "of", "river", "stone", "Élan", "night", "green", "walk", "seven", "paper", "cloud", "mend"]


def prose(n):
    return " ".join(RND.choice(WORDS) + str(RND.randrange(30)) for _ in range(n))


def odd_documents():
    base = [prose(RND.randrange(1, 60)) for _ in range(40)]
    passage = prose(30)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(10)]
    rows += [(200 + i, f"{prose(5)} {passage} {prose(5)}") for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "\U0001F600 é " * 3), (305, "same " * 3000), (306, "same " * 3001), (None, base[0]), (5, base[5])]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("range", "key", "id", "line", "anchor", "one", "fp", "copy", "score", "removed", "value")}) if extra else df


def words(text):
    return (text or "").encode().split()


def test_near_duplicates(spark):
    from assayer.llm import near_dedup

    rows = odd_documents()
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)

    def simhash(t):
        ws = (t or "").encode().lower().split()
        parts = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
        hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {(i, t): simhash(t) for i, t in rows}
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for (i, _), v in prints.items():
        if i is not None:
            least[root(v)] = min(least.get(root(v), i), i)
    want = collections.Counter((i, v, least.get(root(v))) for (i, t) in rows for v in [prints[(i, t)]])
    assert collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    kept = near_dedup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.where("doc_id = 100").count() == 0


def alike_groups(rows):
    """Row numbers by component of Jaccard >= 0.8 over five-word shingles, by brute force."""

    def shingles(t):
        ws = [w.lower() for w in words(t)]
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(set)
    for i in range(len(rows)):
        groups[root(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def near_copies():
    """Texts of 30 to 300 words, and copies with some words replaced, about the threshold and well above; some share a passage."""
    rows, passage = [], prose(40)
    for i in range(30):
        base = prose(RND.randrange(30, 300)).split()
        rows.append((10 * i, " ".join(base)))
        for k in range(1, 6):
            own = list(base)
            for at in RND.sample(range(len(own)), max(1, RND.randrange(0, 6) * len(own) // 100)):
                own[at] = f"new{RND.randrange(10**6)}"
            rows.append((10 * i + k, " ".join(own)))
        rows.append((10 * i + 7, f"{prose(5 * i)} {passage}"))
    return rows


def test_alike_documents(spark):
    from assayer.llm import near_dedup

    rows = near_copies() + [(1000, None), (1001, ""), (1002, "one"), (1003, "One"), (1004, "same " * 300), (1005, "same " * 301), (1006, "a b c d"), (1007, "a b c d e")]
    want = {i: min(rows[j][0] for j in g) for g in alike_groups(rows) for i in g}
    assert sum(len(g) > 1 for g in alike_groups(rows)) > 20 and sum(len(g) == 1 for g in alike_groups(rows)) > 20
    got = near_dedup.alike_documents(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(rows[i][0], c) for i, c in want.items()} and len(got) == len(rows)
    assert {r["doc_id"] for r in near_dedup.one_of_each(frame(spark, rows)).collect()} == set(want.values())
    assert near_dedup.one_of_each(frame(spark, [])).count() == 0


def test_one_changed_word_is_a_near_copy(spark):
    from assayer.llm import near_dedup

    rows = []
    for i in range(40):
        base = prose(200).split()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:100] + ["changed"] + base[101:]))]
    assert {r["doc_id"] for r in near_dedup.one_of_each(frame(spark, rows)).collect()} == {2 * i for i in range(40)}


def test_one_of_each_decides_by_row(spark):
    from assayer.llm import near_dedup

    a, b, c, d, e = (prose(40) for _ in range(5))
    rows = [(1, a), (1, b), (2, a), (2, c), (None, d), (None, d), (None, a), (3, e), (3, e), (4, d), (None, ""), (None, None), (None, "solo")]
    kept = collections.Counter((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(frame(spark, rows)).collect())
    empty = {k for k in kept if not k[1]}
    assert len(empty) == 1 and {k: n for k, n in kept.items() if k not in empty} == {(1, a): 1, (1, b): 1, (2, c): 1, (3, e): 1, (4, d): 1, (None, "solo"): 1}


def test_refined_shards_and_several_trees_lose_no_link(spark):
    from assayer.llm.components import components
    from assayer.llm.near_dedup import links

    centre = RND.getrandbits(64)
    values = {centre} | {centre ^ sum(1 << b for b in RND.sample(range(64), RND.randrange(1, 6))) for _ in range(120)} | {RND.getrandbits(64) for _ in range(60)}
    signed = {v - 2**64 if v >= 2**63 else v for v in values}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for tree in (3, 2000):
        got = {r["node"]: r["root"] for r in components(links(df, tree=tree)).collect()}
        parent = {v: v for v in signed}

        def root(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for a in signed:
            for b in signed:
                if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
        assert got == {v: root(v) for v in signed if any(v != w and root(w) == root(v) for w in signed)}


def test_bk_tree():
    from assayer.llm.near_dedup import BKTree

    tree, values = BKTree(), [RND.getrandbits(16) for _ in range(300)]
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.values[i] for i in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_substring_dedup(spark):
    from assayer.llm.substring_dedup import dedup

    rows = odd_documents()
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in dedup(frame(spark, rows)).collect())
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 12):
            if i is not None:
                key = tuple(w[s : s + 13])
                first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if i is not None and first[tuple(w[s : s + 13])] < i:
                gone[s : s + 13] = [True] * 13
        want[(i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())] += 1
    assert got == want
    assert dedup(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    from assayer.llm.fingerprints import edit_likeness, fingerprint, likeness

    rows = [r for r in odd_documents() if r[0] is not None and r[0] != 5]
    got = {r["doc_id"]: r for r in edit_likeness(frame(spark, rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0]["fingerprint"] == got[100]["fingerprint"]
    assert edit_likeness(frame(spark, [])).count() == 0 and edit_likeness(frame(spark, [(1, "a b")])).first()["near_next"] == 1.0
    a, b = (" ".join(f"w{i}" for i in range(s, s + 1000)) for s in (0, 500))
    near = spark.createDataFrame([(a, b)], "a string, b string").select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("n")).first()["n"]
    assert near == pytest.approx(496 / 1496, abs=0.1)


def test_successors_in_any_number_of_ranges(spark):
    from assayer.llm.fingerprints import with_next

    ids = sorted([RND.randrange(-(2**62), 2**62) for _ in range(150)] + list(range(150)) + [7, 7, 9])
    rows = [(i, f"t{n:04d}") for n, i in enumerate(ids)]
    want = {t: rows[(n + 1) % len(rows)][1] for n, (_, t) in enumerate(rows)} | {"lone": "lone", "alone": "alone"}
    docs = spark.createDataFrame([*rows, (None, "lone"), (None, "alone")], "doc_id long, text string")
    for per, ranges in ((500, 4096), (10, 4096), (2, 5), (1, 2), (3, 1)):
        assert {r["text"]: r["next_text"] for r in with_next(docs, per, ranges).collect()} == want
    assert with_next(docs.limit(0)).count() == 0


def test_fingerprints_by_brute_force(spark):
    """Bins, densification and packing in plain Python over the same shingle hashes."""
    from assayer.llm.fingerprints import BINS, PROBES, fingerprint, likeness, shingle_hashes

    texts = [prose(n) for n in (0, 1, 4, 5, 6, 30, 300, 3000)] + [None, "same " * 50, "é " * 7]
    ranks = spark.range(256).select("id", *(F.xxhash64(F.lit(b), F.col("id").cast("int")).alias(f"b{b}") for b in (0, 5, 255))).collect()
    rank = {(b, r["id"]): r[f"b{b}"] for r in ranks for b in (0, 5, 255)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(shingle_hashes(F.col("text")).alias("h"), fingerprint(F.col("text")).alias("p")).collect()
    for r in rows:
        least = {}
        for h in r["h"]:
            if h & (1 << 56) - 1 != (1 << 56) - 1:
                b = (h >> 56) + BINS // 2
                least[b] = min(least.get(b, h), h)
        if not r["h"]:
            assert r["p"] == b""
            continue
        assert len(r["p"]) == BINS
        for b in range(BINS):
            tried = [b, *((b * a + k) % BINS for a, k in PROBES)]
            found = next((x for x in tried if x in least), None)
            if found is None and b not in (0, 5, 255):
                continue
            if found is None:
                found = min(least, key=lambda j: (rank[(b, j)] & ~255) | j)
            assert r["p"][b] == least[found] & 255
    some = [(rows[i]["p"], rows[j]["p"]) for i in range(len(rows)) for j in range(len(rows))]
    got = spark.createDataFrame([(bytes(a), bytes(b)) for a, b in some], "a binary, b binary").select("a", "b", likeness(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        share = sum(x == y for x, y in zip(r["a"], r["b"], strict=False)) / BINS
        want = 1.0 if r["a"] == r["b"] else 0.0 if not r["a"] or not r["b"] else max(0.0, (share - 1 / 256) / (1 - 1 / 256))
        assert r["n"] == pytest.approx(want)


def test_personal_data(spark):
    from assayer.llm.personal_data import personal_data, rendered

    bits = ["4845168114407329", "4111 1111 1111 1111", "+1 (017) 555-7713", "1.2.3.4", "a@b.c.d@e.f_g@h.i", "256.1.1.1", "001.002.0003.4", "\U0001F600é", "call (212) 555-1212 now", "Mr. John Smith", "x", "1.2.3.4.5.6.7.8", "9-9-9--9"]
    rows = [(i, RND.choice([" ", " | ", ""]).join(RND.choice(bits) for _ in range(RND.randrange(0, 7)))) for i in range(300)] + [(i, "".join(RND.choice("a1.@+- ()9_%é0") for _ in range(60))) for i in range(300, 600)]
    rows += [(600, None), (601, ""), (602, "1 " * 20000), (603, "a" * 50000), (604, "7" * 50000), (0, "again a@b.cd"), (605, "a@b" + ".c" * 500_000)]

    def base(t):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))] if "." in t else []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return ",".join(f"{k}:{a}:{b}" for k, a, b in out)

    got = collections.Counter((r["doc_id"], r["b"]) for r in personal_data(frame(spark, rows)).select("doc_id", rendered(F.col("base")).alias("b")).collect())
    assert got == collections.Counter((i, base(t or "")) for i, t in rows)
    assert personal_data(frame(spark, [])).count() == 0


def test_many_matches_in_one_text(spark):
    from assayer.llm.personal_data import WIDER, personal_data

    n = 20_000
    long = {"many": "1.2.3.4 " * n, "digits": "7" * 1_000_000, "dots": "1." * 500_000, "plus": "+1 " * 300_000, "at": "a@" * 500_000, "dashes": "9-" * 500_000, "upper": "AB12" * 250_000,
            "words": "Mr Bob " * 3000, "phones": "(212) 555-1212, " * 3000, "pluses": "+" * 500_000, "brackets": "+1" + "(" * 500_000, "mail": "a[at]b[dot]" * 100_000}
    rows = list(enumerate(long.values()))
    got = {r["doc_id"]: r for r in personal_data(frame(spark, rows)).collect()}
    assert [(s["kind"], s["start"]) for s in got[0]["base"]][-1] == ("ip", 8 * (n - 1)) and len(got[0]["base"]) == n
    assert all(not got[i]["base"] for i in (1, 4, 5, 9, 10)) and len(got[2]["base"]) == 125_000 and set(WIDER) == {"account", "id", "iban", "local_phone", "masked_email", "person"}


def planted_spans():
    """Texts with spans of the wider kinds that are personal data and look-alikes that are not."""
    rnd = random.Random(21)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def iban():
        bare = "DE00" + digits(18)
        check = 98 - int(bare[4:] + "131400") % 97
        return f"DE{check:02d}{bare[4:]}"

    names = ["Anna", "Peter", "Maria", "John", "Klaus", "Sophie", "Carlos", "Laura"]
    kinds = {
        "id": (lambda: f"{rnd.randrange(100, 600)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}", ["my ssn is {}", "social security number: {}", "ssn {} issued then"], lambda: f"{rnd.choice(['000', '666', '900'])}-00-{digits(4)}", ["order {} units", "part {} rows", "ref {}"]),
        "iban": (iban, ["pay to iban {}", "bank account {}, bic follows", "konto {}"], lambda: "ZZ" + digits(18), ["model {} version", "serial {}", "sku {}"]),
        "local_phone": (lambda: f"({rnd.choice(['212', '415', '646'])}) {rnd.randrange(220, 540)}-{digits(4)}", ["call {} today", "phone {} or write", "tel: {}"], lambda: f"0{digits(2)} 1{digits(2)} {digits(4)}", ["item {} units", "= {} |", "order {}"]),
        "masked_email": (lambda: f"{rnd.choice(names).lower()} [at] {rnd.choice(['mail', 'post'])} [dot] {rnd.choice(['com', 'org', 'de'])}", ["write to {} for more", "contact {}", "mail {}"], lambda: f"x{digits(3)}(at)y{digits(2)}(dot)z9", ["the {} operator", "/{}/", "build {}"]),
        "person": (lambda: f"Mr {rnd.choice(names)} Miller", ["dear {} said", "signed by {}, said", "letter from {} wrote"], lambda: f"Mr {rnd.choice(['President', 'Speaker', 'Robot', 'Potato'])}", ["figure {} show", "the {} award", "page {}"]),
        "account": (lambda: "4" + digits(10) + "7", ["account {} at the bank", "customer {}", "my konto {} bei"], lambda: "20" + digits(6).replace("0", "1"), ["page {} rows", "={}|", "version {} bytes"]),
    }
    texts, truth = [], {}
    for i in range(600):
        kind = list(kinds)[i % len(kinds)]
        good, good_in, bad, bad_in = kinds[kind]
        real = rnd.random() < 0.5
        span, shell = (good(), rnd.choice(good_in)) if real else (bad(), rnd.choice(bad_in))
        lead, tail = prose(rnd.randrange(1, 12)), prose(rnd.randrange(1, 12))
        text = f"{lead}. {shell.format(span)}. {tail}"
        texts.append((i, text))
        if real:
            at = text.index(span)
            truth[i] = (kind, at, at + len(span))
    return texts, truth


def test_added_spans(spark):
    from assayer.llm.personal_data import personal_data

    texts, truth = planted_spans()
    got = {r["doc_id"]: {(s["kind"], s["start"], s["stop"]) for s in r["added"]} for r in personal_data(frame(spark, texts)).collect()}
    right = sum(truth[i] in got[i] for i in truth)
    claimed = sum(map(len, got.values()))
    print("recall", right / len(truth), "precision", right / max(1, claimed))
    assert right / len(truth) >= 0.9 and right / claimed >= 0.9


def test_reliabilities_tell_good_votes_from_bad():
    from assayer.llm.personal_data import LABELERS, reliabilities

    votes = lambda *b: sum(x * 3**i for i, x in enumerate((*b, *[1] * (LABELERS - len(b)))))
    got = reliabilities({("id", votes(2, 1, 2, 1, 2)): 90, ("id", votes(0, 1, 1, 0, 1)): 100, ("id", votes(2, 1, 2, 1, 1)): 10})
    assert got[("id", votes(2, 1, 2, 1, 2))] > 0.9 and got[("id", votes(0, 1, 1, 0, 1))] < 0.1


def test_warc(spark, tmp_path):
    from assayer.llm import warc

    rows = [(i, f"http://x/{i}\r\nz", ["<p>é\U0001F600</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "", None, f"u{i}"][i % 5]) for i in range(40)] + [(99, None, "long" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("block", F.lit(2))
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        again = first[h or ""] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h or ""]) if again else ("response", None))
    warc.write(pages, f"file://{tmp_path}/w", per_file=7)
    warc.register(spark)
    read = spark.read.format("warc").option("partitionBytes", "1").load(f"file://{tmp_path}/w")
    some = read.where("record_type = 'revisit' and record_id in ('<urn:page:5>', '<urn:page:6>')")
    assert some.count() == 2 and {r["payload"] for r in some.collect()} == {None}
    assert "FilterExec" not in str(read.where("record_id = '<urn:page:4>'").collect()) and read.where("record_id = '<urn:page:4>'").first()["payload"] == "u4"
    assert {r["payload"] for r in read.where("record_id = '<urn:page:2>'").collect()} == {""}
    assert spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}/w").where("payload is not null").count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, least=10**9).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_filters_answer_as_sql_does(spark, tmp_path):
    from assayer.llm import warc

    rows = [(i, f"http://{'ab'[i % 2]}/{i}", "x" * (i % 7)) for i in range(30)] + [(90, None, "solo"), (91, None, None)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    warc.register(spark)
    read = spark.read.format("warc").load(f"file://{tmp_path}/w")
    spark.createDataFrame(read.collect(), read.schema).write.parquet(f"file://{tmp_path}/plain")
    plain = spark.read.parquet(f"file://{tmp_path}/plain")
    for test in (
        "refers_to in ('<urn:page:1>', null, 'zz')", "refers_to in (null)", "refers_to = null", "refers_to <=> null", "refers_to is null", "refers_to is not null", "not (refers_to = '<urn:page:1>')",
        "target_uri like 'http://a/%'", "target_uri is null", "record_type = 'revisit' and target_uri like 'http://b%'", "payload_length > 3", "payload_length <= 2", "payload_length >= 4 and payload_length < 6",
        "payload_length in (0, null)", "payload_length = 5", "record_id in ('<urn:page:3>', '<urn:page:90>')", "record_type > 'response'", "payload_digest is not null and payload_length is null",
    ):
        assert sorted(r["record_id"] for r in read.where(test).collect()) == sorted(r["record_id"] for r in plain.where(test).collect()), test
    by_header = spark.read.format("warc").option("header.WARC-Target-URI", "http://a/4").load(f"file://{tmp_path}/w")
    assert [r["record_id"] for r in by_header.collect()] == ["<urn:page:4>"]


def test_a_warc_cut_short_is_refused(spark, tmp_path):
    import gzip

    from assayer.llm import warc

    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 400\r\n\r\n" + b"y" * 300
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(whole)
    warc.register(spark)
    read = spark.read.format("warc").load(f"file://{tmp_path}/a.warc.gz")
    for df in (read, read.where("record_type = 'revisit'")):
        with pytest.raises(Exception, match="cut short"):
            df.collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def mutated(text, most):
    out = list(text)
    for _ in range(RND.randrange(most + 1)):
        at, what = RND.randrange(len(out) + 1), RND.randrange(3)
        if what == 0 and at < len(out):
            out[at] = RND.choice("abé")
        elif what == 1:
            out.insert(at, RND.choice("abé"))
        elif at < len(out):
            del out[at]
    return "".join(out)


def test_banded_distance(spark):
    from assayer.llm.line_dedup import distance as banded

    pairs = [(t, mutated(t, 4)) for t in ("".join(RND.choice("abé") for _ in range(RND.randrange(40))) for _ in range(800))]
    pairs = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= 2]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", banded(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(min(r["d"], 3) == min(distance(r["a"], r["b"]), 3) for r in got)


def test_line_dedup(spark):
    from assayer.llm.line_dedup import dedup_lines

    base = ["".join(RND.choice("abcdef ") for _ in range(RND.randrange(6, 45))) for _ in range(90)]
    rows = [(i, "\n".join(RND.choice([mutated(RND.choice(base), 3), RND.choice(base), ""]) for _ in range(RND.randrange(8)))) for i in range(90)] + [(90, None), (91, ""), (92, "x" * 400), (93, "x" * 401), (96, "y" * 100_000), (94, "no. 41"), (95, "no. 42")]
    got = {r["doc_id"]: r for r in dedup_lines(frame(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if line:
                first.setdefault(line, (i, p))
    near = collections.defaultdict(list)
    lines = sorted(first)
    for a in lines:
        for b in lines:
            if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                near[a].append(b)
                near[b].append(a)
    for i, t in rows:
        if t is None:
            assert got[i]["text"] is None
            continue
        parts = t.split("\n")
        gone = [p for p, x in enumerate(parts) if x and (first[x] != (i, p) or any(first[n] < first[x] for n in near[x]))]
        assert got[i]["removed"] == gone and got[i]["text"] == "\n".join(x for p, x in enumerate(parts) if p not in gone)
        assert got[i]["n_links"] == sum(len(near[x]) for x in parts if x) and got[i]["n_lines"] == len(parts)
    assert dedup_lines(frame(spark, [])).count() == 0
    twice = dedup_lines(frame(spark, [(1, "a line"), (1, "a line"), (None, "a line")])).collect()
    assert len(twice) == 3


def exhaustive_tiles(item, doc, shortest=5):
    """Greedy string tiling by looking at every pair of places, again and again."""
    k = min(shortest, len(item))
    item_free, doc_free, out = [True] * len(item), [True] * len(doc), []
    while k:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and item_free[i + n] and doc_free[j + n]:
                    n += 1
                best = min(best, (-n, i, j))
        n, i, j = -best[0], *best[1:]
        if n < k:
            break
        out.append((i, j, n))
        item_free[i : i + n], doc_free[j : j + n] = [False] * n, [False] * n
    return out


def test_tiles():
    import numpy as np

    from assayer.llm.decontamination import coded, tiles

    t = lambda item, doc: tiles(*coded(item, doc))
    item = "a b c d e f g h i j k l"
    assert t(item, "x g h i j k l y a b c d e f z") == [(0, 8, 6), (6, 1, 6)]
    assert t(item, "a b c d x e f g h") == [] and t("a b", "x a b") == [(0, 1, 2)] and t("", item) == [] and t(item, "") == []
    rnd = random.Random(9)
    for n in range(250):
        letters = "a" if n % 7 == 0 else "ab" if n % 3 == 0 else "abcdefgh"
        own, doc = [rnd.choice(letters) for _ in range(rnd.randrange(1, 25))], [rnd.choice(letters) for _ in range(rnd.randrange(40))]
        for _ in range(rnd.randrange(4)):
            at, to = rnd.randrange(len(own)), rnd.randrange(len(doc) + 1)
            doc[to:to] = own[at : at + rnd.randrange(3, 12)]
        assert t(" ".join(own), " ".join(doc)) == exhaustive_tiles(own, doc)
    assert tiles(np.zeros(300, np.int32), np.zeros(300_000, np.int32)) == [(0, 0, 300)]
    halves = np.concatenate([np.zeros(150, np.int32), np.ones(150, np.int32)])
    assert tiles(halves, np.zeros(200_000, np.int32)) == [(0, 0, 150)]


def test_decontamination(spark):
    from assayer.llm.decontamination import clean, contaminated

    items = [(i, prose(30)) for i in range(6)] + [(7, "one two"), (8, None), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = items[1][1].split()
    rows = [(1, f"{prose(20)} {items[0][1].upper()}! {prose(9)}"), (2, " ".join([*cut[15:], "between", *cut[:15]])), (3, prose(50)), (4, " ".join(cut[:8])), (5, None), (6, ""), (10, "so one, two."), (1, "other text"), (None, items[2][1])]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 0), (2, 1), (10, 7), (None, 2)}
    kept = clean(frame(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6] and kept.columns == frame(spark, rows).columns
    assert contaminated(frame(spark, rows), bench.limit(0)).count() == 0 and contaminated(frame(spark, []), bench).count() == 0


def test_benchmark_items_without_id_count(spark):
    from assayer.llm.decontamination import clean, contaminated

    a, b, c = (prose(30) for _ in range(3))
    docs = frame(spark, [(1, f"{prose(5)} {a}"), (2, f"{b} {prose(5)}"), (3, c)])
    bench = spark.createDataFrame([(None, a), (None, prose(10)), (7, b), (None, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in contaminated(docs, bench).collect()} == {(1, None, 1.0), (2, 7, 1.0)}
    assert [r["doc_id"] for r in clean(docs, bench).collect()] == [3]


def test_decontamination_by_brute_force(spark):
    from assayer.llm.decontamination import clean, contaminated

    items = [(f"i{i}", prose(RND.randrange(1, 40))) for i in range(25)] + [("i0", "twin of five plain words"), ("i0", "twin of five plain words")]
    rows = []
    for i in range(120):
        parts = [prose(RND.randrange(1, 20))]
        for _ in range(RND.randrange(3)):
            ws = RND.choice(items)[1].split()
            at = RND.randrange(len(ws))
            parts += [" ".join(ws[at : at + RND.randrange(4, 25)]), prose(RND.randrange(3))]
        rows.append((i, " ".join(parts)))
    rows += [(500, rows[0][1]), (501, "Twin of FIVE, plain words."), (502, rows[3][1] * 400), (503, "word " * 300_000), (504, "x" * 300_000)]
    want = collections.Counter()
    for i, text in rows[:122]:
        doc = re.findall(r"\w+", text.lower())
        for item_id, item in items:
            own = re.findall(r"\w+", item.lower())
            if set(own) & set(doc):
                found = exhaustive_tiles(own, doc)
                if found and sum(n for *_, n in found) >= 0.5 * len(own):
                    want[(i, item_id, round(sum(n for *_, n in found) / len(own), 9), len(found), max(n for *_, n in found))] += 1
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = contaminated(frame(spark, rows), bench).collect()
    assert collections.Counter((r["doc_id"], r["item_id"], round(r["coverage"], 9), r["n_tiles"], r["longest"]) for r in got if r["doc_id"] < 502) == want and len(want) > 20
    dirty = {r["doc_id"] for r in got}
    assert {r["doc_id"] for r in clean(frame(spark, rows), bench).collect()} == {i for i, _ in rows} - dirty and 503 not in dirty


def test_mixing(spark):
    from assayer.llm.mixing import mix, rates

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit("t").alias("text"), F.lit(9).alias("copy"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("gone", 5.0)], "source string, weight double")
    out = mix(docs, weights, 6000).collect()
    n = collections.Counter(r["source"] for r in out)
    assert n[None] == 0 and n["a"] == pytest.approx(2000, rel=0.1) and n["b"] == pytest.approx(4000, rel=0.1)
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    assert collections.Counter(tuple(r) for r in mix(docs.repartition(7), weights, 6000).collect()) == collections.Counter(tuple(r) for r in out)
    per = collections.defaultdict(list)
    for r in out:
        per[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in per.values())
    assert {r["source"]: r["rate"] for r in rates(docs).collect()}.keys() == {"a", "b", None}
    big = mix(spark.createDataFrame([(1, "x"), (2, "x"), (None, "x"), (2, "x")], "doc_id long, source string"), total=4000).groupBy("doc_id").count().collect()
    assert all(800 < r["count"] < 2300 for r in big) and len(big) == 3
    assert mix(docs.limit(0)).count() == 0


def test_classifiers(spark):
    from assayer.llm import quality, toxicity

    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 5 == 0
        text = " | ".join(prose(1) for _ in range(60)) if bad else prose(60)
        rows.append((i, text + (" scumbag" if rude else "")))
        labels.append((i, int(not bad), int(rude)))
    rows += [(1000, None), (1001, ""), (None, "x"), (1002, "z" * 200_000), (3, rows[3][1])]
    docs, labelled = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for k, module in enumerate((quality, toxicity)):
        got = module.score(docs, labelled).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
        assert held and sum((r["score"] >= 0.3) == bool(truth[r["doc_id"]][k]) for r in held) / len(held) > 0.95
        assert module.score(docs.limit(0), labelled).count() == 0
        assert {round(r["score"], 9) for r in module.score(docs, labelled.limit(0)).collect()} == {0.5}
    kept = quality.keep(docs, labelled)
    assert kept.columns == docs.columns and 280 < kept.count() < 330


def test_swapped_identity_terms_score_alike():
    from assayer.llm.toxicity import digest, fit

    texts = [f"the muslim crowd is scum {i}" for i in range(40)] + [f"the christian crowd is fine {i}" for i in range(40)]
    rows = [(*digest(t), int(i < 40)) for i, t in enumerate(texts)]
    gap = lambda m: abs(m.scores([b"the muslim choir"], {})[0] - m.scores([b"the christian choir"], {})[0])
    loose, held = fit(rows, penalty=0.0), fit(rows)
    assert gap(held) < 0.05 < gap(loose)
    assert held.scores([b"they are scum"], {})[0] > 0.5


def test_penalty_spares_neutral_mentions():
    from assayer.llm.toxicity import ACCEPT, digest, fit

    rnd = random.Random(3)
    insults, groups = ["scum", "vermin", "filth"], ["muslim", "jewish", "gay"]
    rude = [f"{rnd.choice(groups)} people {prose(3)} {rnd.choice(insults) if i % 3 else prose(1)}" for i in range(120)]
    fine = [prose(8) for _ in range(200)] + [f"christian people {prose(5)}" for _ in range(60)] + [f"white people {prose(5)}" for _ in range(60)]
    rows = [(*digest(t), int(i < len(rude))) for i, t in enumerate(rude + fine)]
    neutral = [f"the {g} choir sang {prose(4)}".encode() for g in groups for _ in range(20)]
    flagged = lambda m: (m.scores(neutral, {}) >= ACCEPT).mean()
    assert flagged(fit(rows)) < 0.1 < flagged(fit(rows, penalty=0.0))
    assert (fit(rows).scores([f"those {w}".encode() for w in insults], {}) >= ACCEPT).all()


def test_features_selected_by_executors_are_the_same(spark):
    from assayer.llm.toxicity import digest, fit, fit_sampled

    rnd = random.Random(5)
    texts = [(i, f"{prose(20)} {rnd.choice(['scum', 'vermin', 'Élancé']) if i % 3 == 0 else ''} {rnd.choice(['gay', 'white', ''])} men", int(i % 3 == 0)) for i in range(150)]
    here = fit([(*digest(t), y) for _, t, y in texts])
    there = fit_sampled(spark.createDataFrame(texts, "doc_id long, text string, label int"))
    assert here.index == there.index and abs(here.weight - there.weight).max() < 1e-12 and "=scum" in here.index


def test_toxicity_scores_by_brute_force():
    import math

    from assayer.llm.toxicity import Model, digest, features, swaps

    model = Model({"=scum": 0, "scu": 1, "=gay": 2}, [0.5, 1.25, -0.25], -1.0)
    model.weight = __import__("numpy").array(model.weight)
    for text in ("", "Scum!", "scumbag scum SCUM", "gay 7up_scum", prose(30), "é" * 10, "scum " * 300_000):
        own = {f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in features(w)}
        z = -1.0 + sum(w for f, w in (("=scum", 0.5), ("scu", 1.25), ("=gay", -0.25)) if f in own)
        assert model.scores([text.encode()], {})[0] == pytest.approx(1 / (1 + math.exp(-z)))
    assert len(swaps(["a", "gay", "man"])) == 15 and swaps(["a", "man"]) == []
    words, named = digest("Gay men sing. The rest! " + "word " * 450 + "women")
    assert words == ["gay", "men", "rest", "sing", "the", "women", "word"] and named[0] == "gay men sing" and len(named[1].split()) == 51


def test_network_scores_by_brute_force():
    import numpy as np

    from assayer.llm.quality import CHUNK, FILTERS, STRIDE, WIDTH, Network, chunked, taken

    rng = np.random.default_rng(5)
    net = Network(rng.normal(0, 1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 1, FILTERS).astype(np.float32), rng.normal(0, 1, FILTERS).astype(np.float32), 0.3, rng.normal(0, 1, 4))
    for text in (b"", b"one", bytes(rng.integers(0, 256, 256, np.uint8)), bytes(rng.integers(0, 256, 257, np.uint8)), bytes(rng.integers(0, 256, 3000, np.uint8))):
        chunks, at = [], 0
        while True:
            chunks.append(text[at : at + CHUNK].ljust(CHUNK, bytes(1)))
            at += STRIDE
            if at + CHUNK - STRIDE >= len(text):
                break
        z = []
        for c in chunks:
            pooled = [max(sum(net.table[j][c[i + j]][f] for j in range(WIDTH)) for i in range(CHUNK - WIDTH + 1)) + net.bias[f] for f in range(FILTERS)]
            z.append(sum(max(p, 0) * w for p, w in zip(pooled, net.weight, strict=True)) + net.offset)
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        want = 1 / (1 + np.exp(-(np.array([z.mean(), p.mean(), p.min(), 1]) @ net.mix)))
        assert net.scores([b"x" * 700, text])[1] == pytest.approx(want, rel=1e-4)
        view, starts, _ = chunked([text])
        assert all(any((t == view[s]).all() for s in starts) for t in taken(text))


def test_components(spark):
    from assayer.llm.components import components

    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (200, 202), (200, 203)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 204)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_missing_shared_folder_is_refused_off_local_mode():
    from types import SimpleNamespace

    from assayer.llm.shared import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "file:///x/"}, sparkContext=context)) == "file:///x"
