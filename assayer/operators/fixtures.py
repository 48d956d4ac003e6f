"""Labels, counted exclusions, cells, keyed splits and date arms: one lazy plan from a source table to assignments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.errors import FixtureError, refuse
from assayer.functions.hashing import below

SPLITS = ("train", "validation", "test")
NO_LABEL = "label rule returned no label"
NO_ARM = "(none)"


@dataclass(frozen=True)
class Arm:
    """Rows dated before and not before named cutoffs: column -> ISO date."""

    before: Mapping[str, str] = field(default_factory=dict)
    after: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Spec:
    """How one task's rows become assignments. ``test`` is (fraction, key), or (column, value) of a shipped split."""

    task: str
    id: str
    label: Column | str
    keys: Sequence[str]
    test: tuple[float, str] | tuple[str, str]
    validation: float
    kind: str = "binary"
    cluster: str | None = None
    cell: str | None = None
    arms: Mapping[str, Arm] = field(default_factory=dict)


def label_map(column: str, mapping: Mapping) -> Column:
    """mapping[column]; null where the column is null or not in the mapping."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None)


def checked_label(df: DataFrame, id_column: str, rule: Callable[[DataFrame], Column], declared: Sequence[str]) -> Column:
    """A label rule's column, refused if on the declared columns alone it fails or gives other labels."""
    if missing := [c for c in declared if c not in df.columns]:
        raise FixtureError([f"label column {c!r} is not in the table" for c in missing])
    narrow = df.select(*dict.fromkeys([id_column, *declared]))
    try:
        again = narrow.select(F.col(id_column).alias("_id"), rule(narrow).cast("double").alias("_b"))
        wide = df.select(F.col(id_column).alias("_id"), rule(df).cast("double").alias("_a"))
        differ = wide.join(again, "_id").where(~F.col("_a").eqNullSafe(F.col("_b"))).limit(1).count()
    except Exception as e:
        raise FixtureError(f"the label rule reads a column that label_columns does not name: {e}") from e
    if differ:
        raise FixtureError("the label rule depends on a column that label_columns does not name")
    return rule(df)


def split_column(cluster: Column, key: str, test: tuple, validation: float) -> Column:
    """train, validation or test of a cluster under a split key. The test set is the same under every key; validation is
    drawn from the rest by a hash of its own."""
    first, second = test
    tested = below(f"test/{second}", cluster, first) if isinstance(first, float) else F.col(first).cast("string") == F.lit(str(second))
    chosen = below(f"validation/{key}", cluster, float(validation))
    # nested, so that a filter on the test set makes no other hash
    return F.when(F.coalesce(tested, F.lit(False)), "test").otherwise(F.when(chosen, "validation").otherwise("train"))


def in_arm(arm: Arm) -> Column:
    """Whether a row is in an arm: strictly before its ``before`` cutoffs, on or after its ``after`` ones. No date: not in it."""
    tests = [F.try_to_timestamp(F.col(c).cast("string")) < F.to_timestamp(F.lit(d)) for c, d in arm.before.items()]
    tests += [F.try_to_timestamp(F.col(c).cast("string")) >= F.to_timestamp(F.lit(d)) for c, d in arm.after.items()]
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def arm_column(arms: Mapping[str, Arm]) -> Column:
    named = [F.when(in_arm(a), F.lit(n)) for n, a in arms.items()]
    return F.coalesce(*named, F.lit(None).cast("string")) if named else F.lit(None).cast("string")


def arm_overlaps(df: DataFrame, arms: Mapping[str, Arm]) -> DataFrame:
    """(first, second, rows) for each pair of arms that share rows."""
    names = list(arms)
    flags = df.select(*(in_arm(arms[n]).alias(f"a{i}") for i, n in enumerate(names)))
    pairs = [(i, j) for j in range(len(names)) for i in range(j)]
    counted = flags.agg(*(F.count_if(F.col(f"a{i}") & F.col(f"a{j}")).alias(f"c{i}_{j}") for i, j in pairs))
    rows = F.array(*(F.struct(F.lit(names[i]).alias("first"), F.lit(names[j]).alias("second"), F.col(f"c{i}_{j}").alias("rows")) for i, j in pairs))
    return counted.select(F.explode(rows).alias("p")).select("p.*").where("rows > 0")


def labelled(df: DataFrame, spec: Spec) -> DataFrame:
    """id, cluster, label, cell, reason of every source row; ``reason`` says why a row is left out, label first."""
    rule = F.col(spec.label) if isinstance(spec.label, str) else spec.label
    out = df.withColumn("_label", rule).withColumn("_cell", F.concat(F.lit(f"{spec.task}/"), F.col(spec.cell).cast("string")) if spec.cell else F.lit(spec.task))
    reason = F.when(F.col("_label").isNull(), NO_LABEL)
    if spec.cell:
        reason = reason.when(F.col("_cell").isNull(), f"no value for {spec.cell}")
    return out.withColumn("_reason", reason).withColumn("_cluster", F.col(spec.cluster or spec.id).cast("string"))


def assignments(df: DataFrame, spec: Spec, carry: Sequence[str] = ()) -> DataFrame:
    """id, cluster, cell, label, split__<key>..., arm of the kept rows, and the source's columns in ``carry``. Row-local: no shuffle at any size."""
    rows = labelled(df, spec).where("_reason is null")
    splits = [split_column(F.col("_cluster"), k, spec.test, spec.validation).alias(f"split__{k}") for k in spec.keys]
    return rows.select(
        F.col(spec.id).cast("string").alias("id"), F.col("_cluster").alias("cluster"), F.col("_cell").alias("cell"),
        F.col("_label").cast("int").alias("label"), *splits, arm_column(spec.arms).alias("arm"), *carry,
    )


def long_splits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each id and split key."""
    named = F.create_map(*(x for k in keys for x in (F.lit(k), F.col(f"split__{k}"))))
    kept = [c for c in rows.columns if not c.startswith("split__")]
    return rows.select(*kept, F.explode(named).alias("split_key", "split"))


def exclusions(df: DataFrame, spec: Spec) -> DataFrame:
    """(rows_in, rows_kept, excluded map<reason, rows>) in one pass."""
    reasons = [NO_LABEL, *([f"no value for {spec.cell}"] if spec.cell else [])]
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, reasons)), F.array(*(F.count_if(F.col("_reason") == r) for r in reasons))), lambda _, n: n > 0)
    return labelled(df, spec).agg(F.count("*").alias("rows_in"), F.count_if(F.col("_reason").isNull()).alias("rows_kept"), counts.alias("excluded"))


def split_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(cell, split_key, train, validation, test), zero where a split has no row."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    return long_splits(rows, keys).groupBy("cell", "split_key").agg(*counts)


def class_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(f"split__{key}").alias("split"), "label").agg(F.count("*").alias("rows"))


def arm_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("arm", F.lit(NO_ARM)).alias("arm")).agg(F.count("*").alias("rows"))


def one_class_splits(rows: DataFrame, key: str) -> DataFrame:
    """(cell, split, classes) of train and test splits with fewer than two classes; a cell without such rows counts none."""
    split = F.col(f"split__{key}")
    per = rows.groupBy("cell").agg(*(F.count_distinct(F.when(split == s, F.col("label"))).alias(s) for s in ("train", "test")))
    return per.unpivot("cell", ["train", "test"], "split", "classes").where("classes < 2")


def cluster_splits(rows: DataFrame, key: str) -> DataFrame:
    """(cluster, splits): in how many splits each cluster has rows; more than one would leak."""
    return rows.groupBy("cluster").agg(F.count_distinct(f"split__{key}").alias("splits"))


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.groupBy(F.col(id_column).cast("string").alias("id")).agg(F.count("*").alias("rows")).where("rows > 1 and id is not null")


def distinct_cells(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("cell")).where("cell is not null").distinct()


def label_problems(rows: DataFrame, kind: str) -> list[str]:
    """What is wrong with the labels (long or double column ``_label``) as a whole."""
    value = F.expr("try_cast(_label as double)")
    r = rows.where("_label is not null").agg(
        F.count_if(value.isNull() | (value != F.floor(value))).alias("broken"),
        F.count_if(~value.isin(0.0, 1.0)).alias("odd"),
        F.count_if(value < 0).alias("negative"),
        F.count_distinct(value).alias("classes"),
    ).first()
    out = []
    if r["broken"]:
        out.append(f"{r['broken']} labels are not integers")
    elif kind == "binary" and r["odd"]:
        out.append(f"{r['odd']} labels of a binary task are neither 0 nor 1")
    elif r["negative"]:
        out.append(f"{r['negative']} labels are negative")
    if r["classes"] < 2:
        out.append("the labels have one class only")
    return out


def check(df: DataFrame, spec: Spec) -> None:
    """Refuse a source that can't be frozen, with everything that is wrong with it."""
    needed = [spec.id, *([spec.cluster] if spec.cluster else []), *([spec.cell] if spec.cell else []), *(c for a in spec.arms.values() for c in (*a.before, *a.after))]
    refuse(FixtureError, [f"{spec.task}: the table has no column {c!r}" for c in dict.fromkeys(needed) if c not in df.columns])
    problems = []
    nulls = df.agg(F.count_if(F.col(spec.id).isNull()).alias("ids"), F.count_if(F.col(spec.cluster or spec.id).isNull()).alias("clusters")).first()
    if nulls["ids"]:
        problems.append(f"{spec.task}: {nulls['ids']} rows have no {spec.id}")
    if nulls["clusters"] and spec.cluster:
        problems.append(f"{spec.task}: {nulls['clusters']} rows have no {spec.cluster}")
    if twice := duplicate_ids(df, spec.id).orderBy("id").first():
        problems.append(f"{spec.task}: {spec.id} {twice['id']} appears more than once")
    problems += [f"{spec.task}: {p}" for p in label_problems(labelled(df, spec), spec.kind)]
    if len(spec.arms) > 1:
        problems += [f"{spec.task}: arms must be disjoint; {r['first']} and {r['second']} share {r['rows']} rows" for r in arm_overlaps(df, spec.arms).collect()]
    refuse(FixtureError, problems)
    thin = one_class_splits(assignments(df, spec), spec.keys[0]).orderBy("cell", "split").collect()
    refuse(FixtureError, [f"{r['cell']}: {r['split']} has one class only" for r in thin])


def with_source(rows: DataFrame, source: DataFrame, id_column: str) -> DataFrame:
    """Assignments joined to their source columns; refused where the source has lost an id."""
    joined = rows.join(source.withColumn("_key", F.col(id_column).cast("string")), F.col("id") == F.col("_key"), "left")
    lost = joined.where("_key is null").count()
    refuse(FixtureError, [f"{lost} frozen ids are not in the source"] if lost else [])
    return joined.drop("_key")
