"""DuckDB SQL for queries whose hashes or distances need more than a few lines."""

from __future__ import annotations

#: The primes of XXH64.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
MASK = 1 << 64


def _wide(x: str) -> str:
    return f"({x})::UHUGEINT"


def _times(x: str, c: int) -> str:
    return f"({_wide(x)} * {c}::UHUGEINT % {MASK}::UHUGEINT)::UBIGINT"


def _plus(x: str, y: str) -> str:
    return f"(({_wide(x)} + {_wide(y)}) % {MASK}::UHUGEINT)::UBIGINT"


def _turn(x: str, n: int) -> str:
    return f"({_wide(x)} * {1 << n}::UHUGEINT % {MASK}::UHUGEINT + {_wide(x)} // {1 << (64 - n)}::UHUGEINT)::UBIGINT"


def _round(acc: str, word: str) -> str:
    return _times(_turn(_plus(acc, _times(word, P2)), 31), P1)


def _little(hexes: str, at: str, size: int) -> str:
    """The number that ``size`` bytes from byte ``at`` (from 0) of a text in hexadecimal spell, the least byte first."""
    parts = " || ".join(f"substr({hexes}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size)))
    return f"('0x' || {parts})::UBIGINT"


def _steps(relation: str, key: str, steps: list[tuple[str, str]]) -> tuple[str, str]:
    """Subqueries, each of which replaces column h."""
    for condition, value in steps:
        relation = f"(SELECT * REPLACE (CASE WHEN {condition} THEN {value} ELSE h END AS h) FROM {relation})"
    return relation, key


def _avalanche() -> list[tuple[str, str]]:
    out = []
    for shift, prime in ((33, P2), (29, P3), (32, None)):
        out.append(("true", f"xor(h, h >> {shift})"))
        if prime:
            out.append(("true", _times("h", prime)))
    return out


def xxh64(name: str, texts: str, seed: int = 42) -> str:
    """CTEs that end in ``name`` (s, h UBIGINT): XXH64 of the UTF-8 of each distinct s of the relation ``texts`` (s)."""
    start = [(seed + P1 + P2) % MASK, (seed + P2) % MASK, seed, (seed - P1) % MASK]
    lanes = ", ".join(_round(f"v{i}", _little("x", f"32 * k + {8 * i}", 8)) + f" AS v{i}" for i in range(4))
    merged = _plus(_plus(_turn("v0", 1), _turn("v1", 7)), _plus(_turn("v2", 12), _turn("v3", 18)))
    relation = f"{name}_joined"
    merge = [("n >= 32", _plus(_times(f"xor(h, {_round('0::UBIGINT', f'v{i}')})", P1), f"{P4}::UBIGINT")) for i in range(4)]
    tail, steps = "32 * (n // 32)", [*merge, ("true", _plus("h", "n::UBIGINT"))]
    for i in range(3):
        steps.append((f"n % 32 >= {8 * i + 8}", _plus(_times(_turn(f"xor(h, {_round('0::UBIGINT', _little('x', f'{tail} + {8 * i}', 8))})", 27), P1), f"{P4}::UBIGINT")))
    eights = "8 * (n // 8)"
    steps.append(("n % 8 >= 4", _plus(_times(_turn(f"xor(h, {_times(_little('x', eights, 4), P1)})", 23), P2), f"{P3}::UBIGINT")))
    fours = "4 * (n // 4)"
    for i in range(3):
        steps.append((f"n % 4 >= {i + 1}", _times(_turn(f"xor(h, {_times(_little('x', f'{fours} + {i}', 1), P5)})", 11), P1)))
    relation, _ = _steps(relation, "s", [*steps, *_avalanche()])
    return f"""{name}_hex AS MATERIALIZED (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM {texts})),
{name}_lanes AS (SELECT s, x, n, 0::BIGINT AS k, {start[0]}::UBIGINT AS v0, {start[1]}::UBIGINT AS v1, {start[2]}::UBIGINT AS v2, {start[3]}::UBIGINT AS v3 FROM {name}_hex WHERE n >= 32
  UNION ALL SELECT s, x, n, k + 1, {lanes} FROM {name}_lanes WHERE 32 * (k + 1) <= n),
{name}_joined AS (SELECT s, x, n, v0, v1, v2, v3, {merged} AS h FROM {name}_lanes WHERE k = n // 32 UNION ALL SELECT s, x, n, 0, 0, 0, 0, {(seed + P5) % MASK}::UBIGINT FROM {name}_hex WHERE n < 32),
{name} AS MATERIALIZED (SELECT s, h FROM {relation})"""


def simhash_sql(shingle: int, radius: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = WORDS.format(f"translate(coalesce(text, ''), '{upper}', '{lower}')")
    bits = " + ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END)" for b in range(64))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {shingle} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {shingle - 2}), lambda i: array_to_string(list_slice(ws, i, i + {shingle - 1}), ' ')) END) AS s FROM d),
{xxh64("t", "g")},
p AS (SELECT doc_id, ({bits})::UBIGINT AS fp FROM g JOIN t USING (s) GROUP BY doc_id),
f AS MATERIALIZED (SELECT d.doc_id, coalesce(p.fp, 0::UBIGINT) AS fp FROM d LEFT JOIN p USING (doc_id)),
u AS MATERIALIZED (SELECT fp, min(doc_id) AS lo FROM f GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {radius}),
r AS (SELECT fp AS node, fp AS seen FROM u UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(lo) AS component_id FROM r JOIN u ON r.seen = u.fp GROUP BY node)
SELECT f.doc_id, lower(lpad(hex(f.fp), 16, '0')) AS fingerprint, c.component_id FROM f JOIN c ON f.fp = c.node"""


def lines_sql(edits: int, each: int) -> str:
    """Edit distance in SQL counts bytes: the letters of a pair of lines that take several are told as control characters, of which
    lines hold none."""
    marks = " || ".join(f"chr({i})" for i in (*range(1, 9), 11, 12, *range(14, 32)))
    wide = "array_to_string(list_distinct(list_filter(string_split(a || b, ''), lambda c: strlen(c) > 1)), '')"
    narrow = lambda x: f"translate({x}, wide, left({marks}, length(wide)))"
    return f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS MATERIALIZED (SELECT doc_id, i AS pos, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM d) WHERE ls[i + 1] <> ''),
f AS MATERIALIZED (SELECT line, min(doc_id::HUGEINT * 2147483648 + pos) AS at, length(line) AS n FROM l GROUP BY line),
p AS (SELECT a.line AS a, a.at AS a_at, b.line AS b, b.at AS b_at, least({edits}, a.n // {each}) AS most FROM f a JOIN f b ON a.n >= {each} AND b.n - a.n BETWEEN 0 AND least({edits}, a.n // {each}) AND (a.n < b.n OR a.line < b.line)),
q AS MATERIALIZED (SELECT a, a_at, b, b_at FROM (SELECT *, {wide} AS wide FROM p) WHERE levenshtein({narrow("a")}, {narrow("b")}) <= most),
k AS (SELECT line, min(near) AS near, count(*) AS links FROM (SELECT a AS line, b_at AS near FROM q UNION ALL SELECT b, a_at FROM q) GROUP BY line),
g AS (SELECT l.doc_id, l.pos, l.doc_id::HUGEINT * 2147483648 + l.pos > f.at OR coalesce(k.near < f.at, false) AS gone, coalesce(links, 0) AS links FROM l JOIN f USING (line) LEFT JOIN k USING (line)),
r AS (SELECT doc_id, list(pos ORDER BY pos) FILTER (gone) AS gone, sum(links)::BIGINT AS links FROM g GROUP BY doc_id),
j AS (SELECT d.*, coalesce(r.gone, []) AS gone, coalesce(r.links, 0) AS links FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed, links AS n_links, array_to_string(gone, ',') AS removed,
  sha256(array_to_string(list_transform(list_filter(range(0, len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10))) AS kept_sha256 FROM j"""


def _long(value: str) -> list[tuple[str, str]]:
    """Steps that make of h, a seed, the XXH64 of the eight bytes of a number."""
    mixed = _turn(f"xor(h, {_round('0::UBIGINT', value)})", 27)
    return [("true", _plus("h", f"{P5 + 8}::UBIGINT")), ("true", _plus(_times(mixed, P1), f"{P4}::UBIGINT")), *_avalanche()]


def _int(value: str) -> list[tuple[str, str]]:
    """The same of four bytes."""
    mixed = _turn(f"xor(h, {_times(value, P1)})", 23)
    return [("true", _plus("h", f"{P5 + 4}::UBIGINT")), ("true", _plus(_times(mixed, P2), f"{P3}::UBIGINT")), *_avalanche()]


def fingerprints_sql(shingle: int, bins: int, probes: tuple) -> str:
    """Fingerprints of 256 bins of a byte: the least hash of each, empty bins filled from the first probe that isn't, or else by rank."""
    places = [f"h{i}" for i in range(shingle)]
    whole, _ = _steps("(SELECT *, 42::UBIGINT AS h FROM (SELECT DISTINCT " + ", ".join(places) + f" FROM grams WHERE n >= {shingle}))", "", [s for p in places for s in _long(p)])
    # a short text folds its words one after another: h of the words so far becomes acc, the first number hashed
    short = "(SELECT *, 0::UBIGINT AS acc, 0::UBIGINT AS h FROM (SELECT DISTINCT " + ", ".join(places[:-1]) + f" FROM grams WHERE n < {shingle} AND i = 1))"
    for p in places[:-1]:
        short = f"(SELECT * REPLACE (h AS acc) FROM {short})"
        short, _ = _steps(short, "", [(f"{p} IS NOT NULL", v) for _, v in [("", "42::UBIGINT"), *_long("acc"), *_long(p)]])
    ranks, _ = _steps("(SELECT b, j, 42::UBIGINT AS h FROM range(256) x(b), range(256) y(j))", "", [*_int("b::UBIGINT"), *_int("j::UBIGINT")])
    signed = "(CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)"
    tried = ", ".join(f"cs[((b * {a} + {k}) & {bins - 1}) + 1]" for a, k in probes)
    likeness = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE greatest(0.0, (len(list_filter(range({bins}), lambda i: substr({a}, 2 * i + 1, 2) = substr({b}, 2 * i + 1, 2))) / {bins}.0::DOUBLE - 1.0 / 256) / (1 - 1.0 / 256)) END::DOUBLE"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id)),
e AS MATERIALIZED (SELECT *, length(text) AS n_chars, left(text, length(text) - length(text) // 2) || left(nxt, length(text) // 2) AS edited FROM o),
sides AS MATERIALIZED (SELECT doc_id, kind, {WORDS.format("t")} AS ws FROM (SELECT doc_id, 0 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e)),
spoken AS (SELECT unnest(ws) AS s FROM sides),
{xxh64("t", "spoken")},
placed AS (SELECT doc_id, kind, len(ws) AS n, i, ws[i] AS s FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM sides)),
grams AS MATERIALIZED (SELECT doc_id, kind, n, i, h AS h0, {", ".join(f"lead(h, {k}) OVER w AS h{k}" for k in range(1, shingle))} FROM placed JOIN t USING (s) WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
whole AS MATERIALIZED (SELECT * FROM {whole}), short AS (SELECT * FROM {short}),
hashed AS (SELECT doc_id, kind, h FROM grams JOIN whole USING ({", ".join(places)}) WHERE n >= {shingle}
  UNION ALL SELECT g.doc_id, g.kind, s.h FROM grams g JOIN short s ON {" AND ".join(f"g.{p} IS NOT DISTINCT FROM s.{p}" for p in places[:-1])} WHERE n < {shingle} AND i = 1),
lows AS (SELECT doc_id, kind, ((h >> 56)::INT + 128) % 256 AS b, min(h) AS h FROM hashed GROUP BY ALL),
codes AS (SELECT doc_id, kind, b, (h & 255)::INT AS code FROM lows WHERE (h & {(1 << 56) - 1}::UBIGINT) <> {(1 << 56) - 1}::UBIGINT),
lists AS (SELECT doc_id, kind, list(code ORDER BY b) AS cs FROM (SELECT doc_id, kind, b FROM (SELECT DISTINCT doc_id, kind FROM codes), range({bins}) r(b)) LEFT JOIN codes USING (doc_id, kind, b) GROUP BY ALL),
ranks AS (SELECT list(js ORDER BY b) AS rk FROM (SELECT b, list(j + 1 ORDER BY {signed} - (h & 255)::HUGEINT + j) AS js FROM {ranks} GROUP BY b)),
dense AS (SELECT doc_id, kind, b, coalesce(cs[b + 1], {tried}) AS code, cs FROM lists, range({bins}) r(b)),
filled AS (SELECT doc_id, kind, b, code FROM dense WHERE code IS NOT NULL UNION ALL SELECT doc_id, kind, b, cs[list_filter(rk[b + 1], lambda j: cs[j] IS NOT NULL)[1]] FROM dense, ranks WHERE code IS NULL),
prints AS MATERIALIZED (SELECT doc_id, kind, string_agg(lower(lpad(to_hex(code), 2, '0')), '' ORDER BY b) AS p FROM filled GROUP BY ALL),
x AS (SELECT e.doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, coalesce(a.p, '') AS fingerprint, coalesce(c.p, '') AS edited_fingerprint, coalesce(n.p, '') AS next_print
  FROM e LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN prints c ON c.doc_id = e.doc_id AND c.kind = 1 LEFT JOIN prints n ON n.doc_id = e.next_id AND n.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {likeness("fingerprint", "edited_fingerprint")} AS near_edited, {likeness("fingerprint", "next_print")} AS near_next FROM x"""
