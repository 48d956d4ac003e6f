"""Cluster bootstrap: draws are rows and multiplicities weights of a relational plan. Ranked metrics take the same draws as matrices of
counts: of small groups in one task, of large ones in tasks of a block of draws each that walk through the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.hashing import pick
from assayer.functions.metrics import metric
from assayer.operators.walks import areas, packed, walked
from assayer.sources.shared import stored

LEVELS = (0.025, 0.975)


def cluster_slots(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., cluster, slot from 0 in the order of the cluster's text, slots)."""
    clusters = rows.select(*by, "cluster").distinct()
    own = Window.partitionBy(*by)
    return clusters.withColumn("slot", F.row_number().over(own.orderBy("cluster")) - 1).withColumn("slots", F.count("*").over(own))


def draw_weights(rows: DataFrame, by: Sequence[str], draws: int, seed: str | int = 0) -> DataFrame:
    """(by..., draw, cluster, w): how often each cluster is drawn in each of ``draws`` resamples of as many clusters as
    there are. A counter hash of seed, draw and slot picks; any executor gets the same draws."""
    slots = cluster_slots(rows, by)
    drawn = slots.select(*by, "slot", "slots", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    chosen = pick(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string")), F.col("slots")).cast("int")
    counted = drawn.groupBy(*by, "draw", chosen.alias("slot")).agg(F.count("*").alias("w"))
    return counted.join(slots.select(*by, "slot", "cluster"), [*by, "slot"]).select(*by, "draw", "cluster", "w")


def resampled(rows: DataFrame, weights: DataFrame, by: Sequence[str], name: str, many: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """(by..., extra..., draw, value) of a metric on every draw at once; null where a draw has one class."""
    kept = [c for c in rows.columns if c != "w"]
    joined = rows.select(*kept).join(weights, [*by, "cluster"])
    return metric(name, many, RANGES)(joined, [*by, *extra, "draw"])


def interval(points: DataFrame, values: DataFrame, by: Sequence[str], draws: int) -> DataFrame:
    """(by..., point, lo, hi, n_boot, n_failed, half_width, excludes_zero) of (by..., value) and (by..., draw, value).
    A draw without a value is failed and left out."""
    finite = F.when(~F.isnan("value"), F.col("value"))
    levels = F.percentile(finite, F.array(*map(F.lit, LEVELS)))
    spread = values.groupBy(*by).agg(levels.alias("q"), F.count(finite).alias("ok"))
    out = points.withColumnRenamed("value", "point").join(spread, list(by), "left") if by else points.withColumnRenamed("value", "point").crossJoin(F.broadcast(spread))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return out.select(
        *by, "point", lo.alias("lo"), hi.alias("hi"), F.lit(draws).cast("long").alias("n_boot"), (F.lit(draws) - F.coalesce("ok", F.lit(0))).cast("long").alias("n_failed"),
        ((hi - lo) / 2).alias("half_width"), F.coalesce((lo > 0) | (hi < 0), F.lit(False)).alias("excludes_zero"),
    )


def weighted_once(rows: DataFrame) -> DataFrame:
    return rows.withColumn("w", F.lit(1))


#: Rows of a group up to which its draws are computed in one task, as matrices; larger groups are walked through. And numbers
#: in one matrix (draws x rows of a small group, draws x clusters of a large one; one draw's at least).
SMALL, CELLS = 5_000, 1 << 23
#: Tasks over which the ordered pass of a larger group is dealt for each unit of the score.
RANGES = 256
RANKED = ("pr_auc", "roc_auc")


def _groups(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., _seed, n), stored: each group has one seed."""
    return stored(kept.groupBy(*by, "_seed").agg(F.count("*").alias("n")), "groups")


def _small(groups: DataFrame) -> bool:
    return (groups.agg(F.max("n")).first()[0] or 0) <= SMALL


class _Picks:
    """The counter hash of (seed, draw, slot) as numbers in [0, 1), kept for groups that share a seed."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], np.ndarray] = {}

    def counts(self, seed: str, draws: range, slots: int) -> np.ndarray:
        """How often each slot is drawn: draws x slots."""
        out = np.zeros((len(draws), slots))
        for i, d in enumerate(draws):
            own = self.known.get((seed, d), np.zeros(0))
            if len(own) < slots:
                head = f"{seed}/{d}/"
                more = b"".join(hashlib.sha256(f"{head}{s}".encode()).digest()[:4] for s in range(len(own), slots))
                own = self.known[(seed, d)] = np.concatenate([own, np.frombuffer(more, ">u4") / float(1 << 32)])
                if len(self.known) * slots > CELLS:
                    self.known = {(seed, d): own}
            out[i] = np.bincount((own[:slots] * slots).astype(np.int64), minlength=slots)
        return out


def _areas(label: np.ndarray, score: np.ndarray, weights: np.ndarray, name: str) -> np.ndarray:
    """The metric of rows under each line of a matrix of weights (draws x rows); nan where a draw has one class."""
    order = np.argsort(-score, kind="stable")
    label, score, weights = label[order], score[order], weights[:, order]
    ties = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    p, n = (np.add.reduceat(weights * side, ties, axis=1) for side in (label, 1 - label))
    tp, fp = p.cumsum(axis=1), n.cumsum(axis=1)
    ups, downs = tp[:, -1], fp[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        if name == "roc_auc":
            out = (n * (tp - p / 2)).sum(axis=1) / (ups * downs)
        else:
            out = np.where(p > 0, p * tp / (tp + fp), 0.0).sum(axis=1) / ups
    return np.where((ups > 0) & (downs > 0), out, np.nan)


def _kept(rows: DataFrame, by: Sequence[str], scores: Sequence[str], seed: Column) -> DataFrame:
    """(by..., cluster, label, _s0..., _seed), stored: it is read several times."""
    columns = (F.col(s).cast("double").alias(f"_s{i}") for i, s in enumerate(scores))
    return stored(rows.select(*by, "cluster", "label", *columns, seed.alias("_seed")), "resampled")


def _drawn(rows: DataFrame, by: Sequence[str], scores: Sequence[str], name: str, draws: int, seed: Column) -> DataFrame:
    """(by..., point, values array) of each group: the metric of the first score column, less that of the second if there is one,
    on the rows and on each draw in order (null: failed)."""
    kept = _kept(rows, by, scores, seed)
    groups = _groups(kept, by)
    return _matrices(kept, by, len(scores), name, draws) if _small(groups) else _walks(kept, groups, by, len(scores), name, draws)


def _matrices(kept: DataFrame, by: Sequence[str], sides: int, name: str, draws: int) -> DataFrame:
    """``_drawn`` where a group is one task's, which is why ``_small`` comes first."""
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in by), "point double, values array<double>"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        label = table["label"].to_numpy().astype(float)
        columns = [table[f"_s{i}"].to_numpy() for i in range(sides)]
        clusters, slot = np.unique(np.array(table["cluster"].to_pylist(), object), return_inverse=True)
        picks = _PICKS.setdefault("all", _Picks())
        measure = lambda w: _areas(label, columns[0], w, name) - (_areas(label, columns[1], w, name) if len(columns) > 1 else 0.0)
        step, values = max(1, CELLS // max(1, len(label))), []
        for at in range(0, draws, step):
            counts = picks.counts(table["_seed"][0].as_py(), range(at, min(draws, at + step)), len(clusters))
            values.append(measure(counts[:, slot]))
        listed = lambda v: [None if np.isnan(x) else float(x) for x in v]
        own = [pa.array([k.as_py()], table.schema.field(c).type) for k, c in zip(key, by, strict=True)]
        point = listed(measure(np.ones((1, len(label)))))
        return pa.Table.from_arrays([*own, pa.array(point, pa.float64()), pa.array([listed(np.concatenate(values))], pa.list_(pa.float64()))], names=[*by, "point", "values"])

    return kept.groupBy(*by).applyInArrow(run, schema)


def _numbered(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., _seed, _g from 1 in the order of the seeds), stored."""
    return stored(groups.select(*by, "_seed", F.row_number().over(Window.orderBy("_seed", *by)).alias("_g")), "numbers")


def _by_number(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the number of their group."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(F.broadcast(groups.select("_g", *(F.col(c).alias(f"_of_{c}") for c in by))), same)


def _falling(number: Column) -> Column:
    """What rows are sorted by before their ``_score``: a number below 2**32 and 31 bits that do not fall as the score does, in one long.
    Spark compares it as it is, and looks at the rows themselves only where it is equal."""
    low = F.least(F.greatest(F.floor((1 - F.col("_score")) * float(1 << 30)), F.lit(0)), F.lit((1 << 31) - 1))
    return number * (1 << 31) + F.coalesce(low, F.lit((1 << 31) - 1))


def _walks(kept: DataFrame, groups: DataFrame, by: Sequence[str], sides: int, name: str, draws: int) -> DataFrame:
    """``_drawn`` for groups of any size. Rows are packed by falling score into chunks of five bytes a row, of which each block of
    draws gets a copy; its task holds the counts of its draws, and one chunk. Groups with one seed are walked by the same tasks, which
    hash their slots once."""
    spark = kept.sparkSession
    # groups are numbered in the order of their seeds; from here on a row names its group by a number
    groups = _numbered(groups, by)
    own = _by_number(kept, groups, by).select("_g", "cluster", "label", *(f"_s{i}" for i in range(sides)))
    slots = stored(cluster_slots(own, ["_g"]), "slots")
    sizes = slots.groupBy("_g").agg(F.max("slots").cast("long").alias("_slots"))
    most = sizes.agg(F.max("_slots")).first()[0] or 1
    tasks = max(1, spark.sparkContext.defaultParallelism)
    step = -(-draws // (tasks * -(-draws * most // (tasks * CELLS))))
    blocks = -(-draws // step)
    numbered = own.join(slots.select("_g", "cluster", F.col("slot").alias("_slot")), ["_g", "cluster"])
    side = F.explode(F.array(*(F.struct(F.lit(i).alias("_side"), F.col(f"_s{i}").alias("_score")) for i in range(sides))))
    long = numbered.select("_g", "_slot", F.col("label").alias("_label"), side.alias("_x")).select("_g", "_slot", "_label", "_x.*")
    long = long.withColumn("_range", F.floor(F.col("_score") * RANGES))
    order = ["_g", "_side", F.desc("_range")]
    chunks = long.repartition("_g", "_side", "_range").sortWithinPartitions(_falling(F.col("_g").cast("long") * 2 + F.col("_side")), F.desc("_score"))
    chunks = chunks.mapInArrow(lambda batches: packed(batches, ["_g", "_side", "_range"]), "_g int, _side int, _range long, _seq long, _chunk binary, _flags binary")
    named = chunks.join(F.broadcast(groups.select("_g", "_seed").join(sizes, "_g")), "_g")
    dealt = named.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionById(blocks, "_block").sortWithinPartitions("_block", *order, "_seq")
    found = dealt.mapInArrow(lambda batches: walked(batches, ["_g"], name, draws, step), "_g int, _side int, draw int, value double")
    of = lambda i: F.max(F.when(F.col("_side") == i, F.col("value")))
    each = found.groupBy("_g", "draw").agg((of(0) - of(1) if sides > 1 else of(0)).alias("value"))
    listed = F.array_sort(F.collect_list(F.when(F.col("draw") >= 0, F.struct("draw", "value"))))
    values = each.groupBy("_g").agg(F.max(F.when(F.col("draw") < 0, F.col("value"))).alias("point"), F.transform(listed, lambda x: x["value"]).alias("values"))
    return values.join(F.broadcast(groups), "_g").select(*by, "point", "values")


def roc_auc(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., value) of rows (by..., label, score) that count once each; null where a group has one class. A group is dealt over ranges
    of the score: each sums up its own pairs of rows, and those with the ranges above it follow from their counts."""
    kept = stored(rows.select(*by, F.col("label").cast("int").alias("_label"), F.col("score").cast("double").alias("_score"), F.lit("").alias("_seed")), "scored")
    groups = _numbered(_groups(kept, by), by)
    own = _by_number(kept, groups, by).select("_g", F.floor(F.col("_score") * RANGES).alias("_range"), F.lit(0).alias("_slot"), "_label", "_score")
    dealt = own.repartition("_g", "_range").sortWithinPartitions(_falling(F.col("_g").cast("long")), F.desc("_score"))
    found = dealt.mapInArrow(lambda batches: areas(batches, ["_g", "_range"]), "_g int, _range long, p double, n double, area double")
    higher = Window.partitionBy("_g").orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("area", F.col("area") + F.col("n") * F.coalesce(F.sum("p").over(higher), F.lit(0.0)))
    both = F.sum("p") * F.sum("n")
    values = found.groupBy("_g").agg(F.when(both > 0, F.sum("area") / both).alias("value"))
    return values.join(F.broadcast(groups), "_g").select(*by, "value")


#: One cache a worker process.
_PICKS: dict[str, _Picks] = {}


def _between(found: DataFrame, by: Sequence[str], draws: int) -> DataFrame:
    """``interval`` of (by..., point, values array)."""
    ranked = F.array_sort(F.filter("values", lambda v: v.isNotNull()))

    def level(q: float) -> Column:
        place = (F.size("_v") - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        a, b = F.get("_v", low), F.coalesce(F.get("_v", low + 1), F.get("_v", low))
        return F.when(F.size("_v") > 0, a + (place - low) * (b - a))

    own = found.withColumn("_v", ranked).withColumns({"lo": level(LEVELS[0]), "hi": level(LEVELS[1])})
    return own.select(
        *by, "point", "lo", "hi", F.lit(draws).cast("long").alias("n_boot"), (F.lit(draws) - F.size("_v")).cast("long").alias("n_failed"),
        ((F.col("hi") - F.col("lo")) / 2).alias("half_width"), F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)).alias("excludes_zero"),
    )


def bootstrap_metric(rows: DataFrame, by: Sequence[str], name: str, draws: int = 1000, seed: str | int = 0, many: bool = False) -> DataFrame:
    """Interval of one metric over resampled clusters of (by..., cluster, label, score or probs)."""
    if name in RANKED and not many:
        return _between(_drawn(rows, by, ["score"], name, draws, F.lit(str(seed))), by, draws)
    point = metric(name, many, RANGES)(weighted_once(rows), by)
    return interval(point, resampled(rows, draw_weights(rows, by, draws, seed), by, name, many), by, draws)


def _pair(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Both methods' rows as one frame with a ``side``, so that one pass and one set of weights serves both."""
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col(a).alias("score")), F.struct(F.lit("b").alias("side"), F.col(b).alias("score")))
    kept = [c for c in rows.columns if c not in (a, b, "score")]
    return rows.select(*kept, F.explode(sides).alias("s")).select(*kept, "s.side", "s.score")


def _difference(values: DataFrame, by: Sequence[str]) -> DataFrame:
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("value")))
    return values.groupBy(*by).agg((side("a") - side("b")).alias("value"))


def paired_difference(rows: DataFrame, by: Sequence[str], name: str, a: str, b: str, draws: int = 1000, seed: str | int = 0) -> DataFrame:
    """Interval of metric(a) - metric(b), columns ``a`` and ``b`` scoring the same rows, both on the same resamples."""
    if name in RANKED:
        return _between(_drawn(rows, by, [a, b], name, draws, F.lit(str(seed))), by, draws)
    both = _pair(rows, a, b)
    point = _difference(metric(name, False, RANGES)(weighted_once(both), [*by, "side"]), by)
    values = resampled(both, draw_weights(rows, by, draws, seed), by, name, extra=["side"])
    return interval(point, _difference(values, [*by, "draw"]), by, draws)


def difference_in_differences(rows: DataFrame, group: str, one: str, two: str, name: str, a: str, b: str, draws: int = 1000, seed: str | int = 0, by: Sequence[str] = ()) -> DataFrame:
    """A row for each ``by``: the interval of [a - b] on the rows whose ``group`` is ``one``, less the same on ``two``. Each group's
    clusters are resampled by themselves."""
    rows, by = rows.where(F.col(group).isin(one, two)), list(by)
    if name in RANKED:
        seeds = F.when(F.col(group) == one, f"{seed}/0").otherwise(f"{seed}/1")
        found = _drawn(rows, [*by, group], [a, b], name, draws, seeds)
        of = lambda g, c: F.max(F.when(F.col(group) == g, F.col(c)))
        sides = found.groupBy(*by).agg((of(one, "point") - of(two, "point")).alias("point"), of(one, "values").alias("_one"), of(two, "values").alias("_two"))
        return _between(sides.withColumn("values", F.zip_with("_one", "_two", lambda x, y: x - y)), by, draws)
    both = _pair(rows, a, b)
    turn = lambda df, on: df.groupBy(*on).agg((F.max(F.when(F.col(group) == one, F.col("value"))) - F.max(F.when(F.col(group) == two, F.col("value")))).alias("value"))
    point = turn(_difference(metric(name, False, RANGES)(weighted_once(both), [*by, group, "side"]), [*by, group]), by)
    sides = []
    for i, g in enumerate((one, two)):
        sides.append(draw_weights(rows.where(F.col(group) == g), [*by, group], draws, f"{seed}/{i}"))
    values = resampled(both, sides[0].unionByName(sides[1]), [*by, group], name, extra=["side"])
    return interval(point, turn(_difference(values, [*by, group, "draw"]), [*by, "draw"]), by, draws)
