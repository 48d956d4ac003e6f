"""Feature channels: every column is registered to one, encoders learn from training rows only, features come out long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.errors import ChannelError, refuse
from assayer.functions.hashing import unit_hash

#: Kinds of channels and the parameters each may take, with their defaults (None: must be given).
KINDS = {
    "numeric": {"impute": "median", "scale": False, "missing_indicator": False},
    "categorical": {"encoding": None, "min_frequency": 1},
    "text": {"max_features": 20000, "ngram_max": 1, "min_df": 1},
    "multihot": {"separator": ";", "min_df": 1},
}
IMPUTES, ENCODINGS = ("median", "mean", "zero"), ("one_hot", "target")
MISSING, INFREQUENT = "<missing>", "<infrequent>"
TOKEN = r"(?U)\b\w\w+\b"
FOLDS = 5


@dataclass(frozen=True)
class Channel:
    name: str
    kind: str
    columns: Sequence[str]
    params: Mapping = field(default_factory=dict)
    tasks: Sequence[str] | None = None

    def param(self, key: str):
        return self.params.get(key, KINDS[self.kind][key])

    def serves(self, task: str) -> bool:
        return self.tasks is None or task in self.tasks


@dataclass(frozen=True)
class Registry:
    channels: Sequence[Channel]
    ignore: Mapping[str, str] = field(default_factory=dict)

    def owner(self, column: str) -> str | None:
        """``ignore`` wins, else the channel that has the column, else none."""
        if column in self.ignore:
            return "ignore"
        return next((c.name for c in self.channels if column in c.columns), None)

    def problems(self) -> list[str]:
        """Everything wrong with the registry itself."""
        out, seen = [], {}
        for c in self.channels:
            if c.kind not in KINDS:
                out.append(f"channel {c.name}: unknown kind {c.kind!r}")
                continue
            out += [f"channel {c.name}: unknown parameter {k!r}" for k in c.params if k not in KINDS[c.kind]]
            if not c.columns:
                out.append(f"channel {c.name} has no columns")
            if c.kind == "categorical" and c.params.get("encoding") not in ENCODINGS:
                out.append(f"channel {c.name}: encoding must be given, as one of {', '.join(ENCODINGS)}")
            if c.kind == "numeric" and c.param("impute") not in IMPUTES:
                out.append(f"channel {c.name}: impute must be one of {', '.join(IMPUTES)}")
            out += [f"channel {c.name}: {k} must be a whole number from 1 on" for k in ("min_frequency", "max_features", "ngram_max", "min_df") if k in KINDS[c.kind] and (not isinstance(c.param(k), int) or isinstance(c.param(k), bool) or c.param(k) < 1)]
            for column in c.columns:
                if column in seen:
                    out.append(f"column {column!r} is in channels {seen[column]} and {c.name}")
                seen.setdefault(column, c.name)
        return out + [f"ignored column {c!r} has no reason" for c, why in self.ignore.items() if not str(why or "").strip()]

    def check(self, columns: Sequence[str], label_columns: Sequence[str] = (), structural: Sequence[str] = ()) -> None:
        """Refuse a table with unregistered, missing or leaking columns; all are named at once."""
        out = [f"column {c!r} is not registered to any channel" for c in columns if c not in structural and self.owner(c) is None]
        out += [f"channel {c.name} has column {x!r}, which the table lacks" for c in self.channels for x in c.columns if x not in columns]
        out += [f"label column {x!r} is in channel {c.name}: it would leak" for c in self.channels for x in c.columns if x in label_columns and x not in self.ignore]
        refuse(ChannelError, out)

    def pick(self, task: str, names: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> list[Channel]:
        """The channels of a task, some of them by name or kind; unknown names and an empty choice are refused."""
        refuse(ChannelError, [f"unknown channel {n!r}" for n in names or () if n not in {c.name for c in self.channels}])
        out = [c for c in self.channels if c.serves(task) and (names is None or c.name in names) and (kinds is None or c.kind in kinds)]
        refuse(ChannelError, [] if out else [f"no channel of task {task} is left"])
        return out

    def manifest(self, task: str, columns: Sequence[str]) -> dict:
        return {"columns": {c: self.owner(c) for c in columns}, "channels": {c.name: {"kind": c.kind, "columns": list(c.columns), "params": dict(c.params)} for c in self.channels if c.serves(task)}}


def non_training(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(~F.col(split).eqNullSafe(F.lit("train"))).groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"))


def training_only(rows: DataFrame, split: str) -> None:
    """Refuse to fit on rows that aren't training rows."""
    bad = non_training(rows, split).collect()
    refuse(ChannelError, ["encoders learn from training rows alone, not from " + ", ".join(f"{r['rows']} {r['split']} rows" for r in sorted(bad, key=str))] if bad else [])


def _number(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def numeric_stats(train: DataFrame, columns: Sequence[str], impute: str = "median") -> DataFrame:
    """One row: fill, mean, std and missing of each column after imputation, in a single pass plus one for the spread.

    The median is exact; an all-missing column fills with zero. Standard deviations are the population's; zero counts as one."""
    fill = {"median": lambda c: F.percentile(_number(c), F.lit(0.5)), "mean": lambda c: F.avg(_number(c)), "zero": lambda c: F.lit(0.0)}[impute]
    fills = train.agg(*(F.coalesce(fill(c), F.lit(0.0)).alias(f"{c}__fill") for c in columns), *(F.count_if(_number(c).isNull()).alias(f"{c}__missing") for c in columns))
    filled = train.crossJoin(F.broadcast(fills))
    own = lambda c: F.coalesce(_number(c), F.col(f"{c}__fill"))
    spread = lambda c: F.when(F.stddev_pop(own(c)) > 0, F.stddev_pop(own(c))).otherwise(1.0)
    stats = filled.agg(*(F.coalesce(F.avg(own(c)), F.lit(0.0)).alias(f"{c}__mean") for c in columns), *(F.coalesce(spread(c), F.lit(1.0)).alias(f"{c}__std") for c in columns))
    return fills.crossJoin(F.broadcast(stats))


def numeric_features(rows: DataFrame, stats: DataFrame, channel: Channel) -> DataFrame:
    """(id, feature, value): imputed, scaled if asked, then an indicator for each column with missing values in training."""
    joined = rows.crossJoin(F.broadcast(stats))
    own = lambda c: F.coalesce(_number(c), F.col(f"{c}__fill"))
    value = lambda c: (own(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") if channel.param("scale") else own(c)
    pairs = [F.struct(F.lit(f"{channel.name}:{c}").alias("feature"), value(c).alias("value")) for c in channel.columns]
    if channel.param("missing_indicator"):
        for c in channel.columns:
            share = F.col(f"{c}__missing") / F.col("_rows")
            flag = _number(c).isNull().cast("double")
            flag = (flag - share) / F.when(F.sqrt(share * (1 - share)) > 0, F.sqrt(share * (1 - share))).otherwise(1.0) if channel.param("scale") else flag
            pairs.append(F.when(F.col(f"{c}__missing") > 0, F.struct(F.lit(f"{channel.name}:missing({c})").alias("feature"), flag.alias("value"))))
    kept = F.filter(F.array(*pairs), lambda p: p.isNotNull())
    return joined.select("id", F.explode(kept).alias("p")).select("id", "p.*")


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def one_hot_vocabulary(train: DataFrame, column: str, min_frequency: int = 1) -> DataFrame:
    """(category, feature) of the training categories; those of fewer rows than ``min_frequency`` share a feature."""
    counted = train.groupBy(_category(column).alias("category")).agg(F.count("*").alias("n"))
    return counted.select("category", F.when(F.col("n") < min_frequency, INFREQUENT).otherwise(F.col("category")).alias("feature"))


def one_hot_features(rows: DataFrame, vocabulary: DataFrame, channel: str, column: str) -> DataFrame:
    """(id, feature, value): an unseen category takes the shared feature if there is one, else none."""
    rare = vocabulary.agg(F.max(F.when(F.col("feature") == INFREQUENT, INFREQUENT)).alias("_rare"))
    named = rows.select("id", _category(column).alias("category")).join(vocabulary, "category", "left").crossJoin(F.broadcast(rare))
    out = named.withColumn("feature", F.coalesce("feature", "_rare")).where("feature is not null")
    return out.select("id", F.concat(F.lit(f"{channel}:{column}="), "feature").alias("feature"), F.lit(1.0).alias("value"))


def target_statistics(train: DataFrame, column: str, smooth: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., category, value): training mean of the label in each category, shrunk to the overall mean by ``smooth`` rows."""
    prior = train.groupBy(*by).agg(F.avg("label").alias("_prior")) if by else train.agg(F.avg("label").alias("_prior"))
    per = train.groupBy(*by, _category(column).alias("category")).agg(F.sum("label").alias("_sum"), F.count("*").alias("_n"))
    joined = per.join(F.broadcast(prior), list(by)) if by else per.crossJoin(F.broadcast(prior))
    return joined.select(*by, "category", ((F.col("_sum") + smooth * F.col("_prior")) / (F.col("_n") + smooth)).alias("value"))


def fold(seed: str = "fold") -> Column:
    return F.floor(unit_hash(seed, F.col("id")) * FOLDS).cast("int")


def target_encode_train(train: DataFrame, channel: str, column: str, smooth: float = 1.0) -> DataFrame:
    """Cross-fitted (id, feature, value): each row's category by the other folds alone; one unseen there gets their mean."""
    rows = train.select("id", "label", _category(column).alias("category"), fold().alias("fold"))
    all_ = rows.groupBy("category").agg(F.sum("label").alias("hits"), F.count("*").alias("rows"))
    own = rows.groupBy("fold", "category").agg(F.sum("label").alias("own_hits"), F.count("*").alias("own_rows"))
    whole = rows.agg(F.sum("label").alias("all_hits"), F.count("*").alias("all_rows"))
    folds = rows.groupBy("fold").agg(F.sum("label").alias("fold_hits"), F.count("*").alias("fold_rows"))
    joined = rows.join(own, ["fold", "category"]).join(all_, "category").join(F.broadcast(folds), "fold").crossJoin(F.broadcast(whole))
    prior = F.coalesce(F.try_divide(F.col("all_hits") - F.col("fold_hits"), F.col("all_rows") - F.col("fold_rows")), F.lit(0.0))
    value = (F.col("hits") - F.col("own_hits") + smooth * prior) / (F.col("rows") - F.col("own_rows") + smooth)
    return joined.select("id", F.lit(f"{channel}:{column}").alias("feature"), value.alias("value"))


def target_encode(rows: DataFrame, train: DataFrame, channel: str, column: str, smooth: float = 1.0) -> DataFrame:
    """(id, feature, value) of rows outside training: the full training statistics, unseen categories get the overall mean."""
    stats = target_statistics(train, column, smooth)
    prior = train.agg(F.avg("label").alias("_prior"))
    joined = rows.select("id", _category(column).alias("category")).join(stats, "category", "left").crossJoin(F.broadcast(prior))
    return joined.select("id", F.lit(f"{channel}:{column}").alias("feature"), F.coalesce("value", "_prior").alias("value"))


def joined_text(columns: Sequence[str]) -> Column:
    """The texts with one space between, nulls as empty."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def terms(text: Column, ngram_max: int = 1) -> Column:
    """Lower-cased word tokens of two characters or more, and their runs up to ``ngram_max``."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    grams = [words]
    for n in range(2, ngram_max + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
        runs = F.transform(starts, _run(words, n))
        grams.append(F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>")))
    return F.concat(*grams) if len(grams) > 1 else words


def _run(words: Column, n: int):
    def of(i: Column) -> Column:
        return F.array_join(F.slice(words, i, F.lit(n)), " ")

    return of


def term_counts(rows: DataFrame, columns: Sequence[str], ngram_max: int = 1) -> DataFrame:
    """(id, term, tf)."""
    return rows.select("id", F.explode(terms(joined_text(columns), ngram_max)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(train: DataFrame, columns: Sequence[str], max_features: int = 20000, ngram_max: int = 1, min_df: int = 1) -> DataFrame:
    """(term, df, idf) of the ``max_features`` commonest terms of training, ties by term, in at least ``min_df`` rows."""
    counts = term_counts(train, columns, ngram_max)
    per = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)
    top = per.orderBy(F.desc("tf"), "term").limit(max_features)
    rows = train.agg(F.count("*").alias("_rows"))
    return top.crossJoin(F.broadcast(rows)).select("term", "df", (F.log((1 + F.col("_rows")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_features(rows: DataFrame, words: DataFrame, channel: str, columns: Sequence[str], ngram_max: int = 1) -> DataFrame:
    """(id, feature, value) with rows of unit length. ``words`` has at most max_features rows."""
    weighed = term_counts(rows, columns, ngram_max).join(words, "term").withColumn("v", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return weighed.select("id", F.concat(F.lit(f"{channel}:"), "term").alias("feature"), (F.col("v") / norm).alias("value"))


def codes(column: str, separator: str = ";") -> Column:
    """The distinct trimmed non-empty parts of a delimited text."""
    parts = F.split(F.coalesce(F.col(column).cast("string"), F.lit("")), _quoted(separator), -1)
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def multihot_vocabulary(train: DataFrame, column: str, separator: str = ";", min_df: int = 1) -> DataFrame:
    return train.select(F.explode(codes(column, separator)).alias("code")).groupBy("code").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def multihot_features(rows: DataFrame, words: DataFrame, channel: str, column: str, separator: str = ";") -> DataFrame:
    held = rows.select("id", F.explode(codes(column, separator)).alias("code")).join(words, "code")
    return held.select("id", F.concat(F.lit(f"{channel}:{column}="), "code").alias("feature"), F.lit(1.0).alias("value"))


class Featurizer:
    """Fits a task's channels on training rows and turns any rows into (id, feature, value). With more than two classes a
    target-encoded column becomes a feature for each class: the share of that class in the category."""

    def __init__(self, channels: Sequence[Channel], split: str, classes: int = 2) -> None:
        self.channels, self.split, self.classes, self.train = list(channels), split, classes, None

    def fit(self, rows: DataFrame) -> Featurizer:
        training_only(rows, self.split)
        self.train = rows
        return self

    def transform(self, rows: DataFrame, training: bool = False) -> DataFrame:
        """``training`` gives the training rows their own, cross-fitted, target encodings."""
        refuse(ChannelError, [] if self.train is not None else ["a featurizer must be fitted before it transforms"])
        out = None
        for c in self.channels:
            for part in self._parts(c, rows, training):
                out = part if out is None else out.unionByName(part)
        return out

    def _parts(self, c: Channel, rows: DataFrame, training: bool) -> list[DataFrame]:
        train = self.train
        if c.kind == "numeric":
            stats = numeric_stats(train, c.columns, c.param("impute")).crossJoin(F.broadcast(train.agg(F.count("*").alias("_rows"))))
            return [numeric_features(rows, stats, c)]
        if c.kind == "text":
            words = vocabulary(train, c.columns, c.param("max_features"), c.param("ngram_max"), c.param("min_df"))
            return [tfidf_features(rows, words, c.name, c.columns, c.param("ngram_max"))]
        if c.kind == "multihot":
            return [multihot_features(rows, multihot_vocabulary(train, x, c.param("separator"), c.param("min_df")), c.name, x, c.param("separator")) for x in c.columns]
        if c.param("encoding") == "one_hot":
            return [one_hot_features(rows, one_hot_vocabulary(train, x, c.param("min_frequency")), c.name, x) for x in c.columns]
        if self.classes == 2:
            return [target_encode_train(train, c.name, x) if training else target_encode(rows, train, c.name, x) for x in c.columns]
        out = []
        for x in c.columns:
            for k in range(self.classes):
                one = train.withColumn("label", (F.col("label") == k).cast("int"))
                own = target_encode_train(one, c.name, x) if training else target_encode(rows, one, c.name, x)
                out.append(own.withColumn("feature", F.concat("feature", F.lit(f"[{k}]"))))
        return out
