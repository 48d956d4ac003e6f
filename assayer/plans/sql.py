"""Pieces of DuckDB SQL that the catalogue's oracles share."""

from __future__ import annotations

PRIORITY = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END"
KEYS = ("split-0", "split-1", "split-2")


def u(key: str, value: str) -> str:
    return f"(('0x' || substr(sha256('{key}' || chr(0) || {value}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def split(key: str, cluster: str = "o_custkey::VARCHAR", tested: str | None = None) -> str:
    tested = tested or f"{u('test/test-v1', cluster)} < 0.2"
    return f"CASE WHEN {tested} THEN 'test' WHEN {u(f'validation/{key}', cluster)} < 0.25 THEN 'validation' ELSE 'train' END"


ID = "o_orderkey::VARCHAR"
ARM = "CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'seen' WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'unseen' END"
#: Every order as an assignment with three deterministic scores.
ORD = f"""ord AS (SELECT {ID} AS id, o_custkey::VARCHAR AS cluster, 'orders/' || o_orderstatus AS cell, {PRIORITY} AS label,
  {", ".join(f'{split(k)} AS "split__{k}"' for k in KEYS)}, {ARM} AS arm,
  least(1.0, floor(o_totalprice / 10000) / 50.0) AS ties, 0.35 * {PRIORITY} + 0.65 * {u("a", ID)} AS score_a, 0.3 * {PRIORITY} + 0.7 * {u("b", ID)} AS score_b
  FROM orders)"""
TEST = 'SELECT * FROM ord WHERE "split__split-0" = \'test\''


def ranked(rows: str, by: str, score: str = "score", w: str = "1") -> str:
    """(by, pr_auc, roc_auc) of a named relation."""
    return f"""SELECT {by}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / sum(p) END AS pr_auc,
      CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(n * (tp - p / 2)) / (sum(p) * sum(n)) END AS roc_auc
    FROM (SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp
      FROM (SELECT {by}, {score} AS s, sum({w} * label)::DOUBLE AS p, sum({w} * (1 - label))::DOUBLE AS n FROM {rows} GROUP BY ALL)) GROUP BY {by}"""


def weights(rows: str, by: str, draws: int, seed: str) -> str:
    """CTEs slots, drawn and w of a named relation with ``cluster``."""
    return f"""slots AS (SELECT {by}, cluster, row_number() OVER (PARTITION BY {by} ORDER BY cluster) - 1 AS slot, count(*) OVER (PARTITION BY {by}) AS slots FROM (SELECT DISTINCT {by}, cluster FROM {rows})),
    drawn AS (SELECT {by}, draw, floor(('0x' || substr(sha256({seed} || '/' || draw || '/' || slot), 1, 8))::BIGINT / 4294967296.0 * slots)::BIGINT AS slot FROM slots, range({draws}) r(draw)),
    w AS (SELECT {by}, draw, cluster, count(*) AS w FROM drawn JOIN slots USING ({by}, slot) GROUP BY ALL)"""


def interval(values: str, points: str, by: str, draws: int) -> str:
    """Interval columns of relations (by, draw, value) and (by, point)."""
    return f"""SELECT {by}, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, {draws}::BIGINT AS n_boot, {draws} - ok AS n_failed, round((hi - lo) / 2, 6) AS half_width, coalesce(lo > 0 OR hi < 0, false) AS excludes_zero
    FROM {points} JOIN (SELECT {by}, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(value) AS ok FROM {values} GROUP BY {by}) USING ({by})"""
