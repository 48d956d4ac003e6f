"""Methods: each fits on training rows and scores others; registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.errors import RunError, refuse


class Method:
    """``unavailable()`` gives a reason not to run, ``kinds`` the channel kinds it reads (None: all of them)."""

    kinds: tuple[str, ...] | None = None

    def unavailable(self) -> str | None:
        return None

    def fit_predict(self, train: DataFrame, rows: DataFrame, classes: int, seed: int) -> DataFrame:
        """(id, probs array<double>) of ``rows``; both have (id, label, features vector)."""
        raise NotImplementedError


REGISTRY: dict[str, Callable[[], Method]] = {}


def register(name: str) -> Callable:
    def add(make: Callable[[], Method]) -> Callable[[], Method]:
        refuse(RunError, [f"method {name} is registered already"] if name in REGISTRY else [])
        REGISTRY[name] = make
        return make

    return add


def make(name: str) -> Method:
    refuse(RunError, [] if name in REGISTRY else [f"unknown method {name!r}; there are {', '.join(sorted(REGISTRY))}"])
    return REGISTRY[name]()


def priors(train: DataFrame, classes: int) -> DataFrame:
    """One row: the share of each class in training, zero for one it lacks."""
    return train.agg(F.array(*(F.avg((F.col("label") == k).cast("double")) for k in range(classes))).alias("probs"))


def vectors(long: DataFrame, index: DataFrame, n: int, rows: DataFrame) -> DataFrame:
    """rows with ``features``: a sparse vector of the long (id, feature, value) by index (feature, at) of ``n`` features; features
    outside it are left out. Spark's functions make dense vectors only, so a row's pairs become a vector in Python."""
    known = long.join(index, "feature").where("value <> 0")
    pairs = known.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_pairs"))
    sparse = F.udf(lambda p: Vectors.sparse(n, [(x[0], x[1]) for x in p or []]), VectorUDT(), useArrow=False)
    return rows.join(pairs, "id", "left").withColumn("features", sparse("_pairs")).drop("_pairs")


def _padded(classes: int):
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.get("probs", k), F.lit(0.0)))


@register("majority")
class Majority(Method):
    def fit_predict(self, train: DataFrame, rows: DataFrame, classes: int, seed: int) -> DataFrame:
        return rows.select("id").crossJoin(F.broadcast(priors(train, classes)))


class _Logistic(Method):
    c = 1.0

    def fit_predict(self, train: DataFrame, rows: DataFrame, classes: int, seed: int) -> DataFrame:
        """L2-penalised likelihood with an unpenalised intercept; a class that training lacks gets probability 0."""
        n = train.count()
        model = LogisticRegression(regParam=1 / (self.c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9, family="multinomial" if classes > 2 else "auto").fit(train)
        return model.transform(rows).withColumn("probs", vector_to_array("probability")).select("id", _padded(classes).alias("probs"))


@register("logreg")
class LogReg(_Logistic):
    kinds = ("numeric", "categorical", "multihot")


@register("tfidf_logreg")
class TfidfLogReg(_Logistic):
    kinds, c = ("text",), 4.0


@register("hist_gbm")
class HistGBM(Method):
    """Boosted trees on binned features; more than two classes by one-vs-rest."""

    kinds = ("numeric", "categorical", "multihot")

    def fit_predict(self, train: DataFrame, rows: DataFrame, classes: int, seed: int) -> DataFrame:
        trees = GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.1, seed=seed)
        if classes == 2:
            found = trees.fit(train).transform(rows).withColumn("probs", vector_to_array("probability"))
            return found.select("id", "probs")
        found = OneVsRest(classifier=trees).fit(train).transform(rows).withColumn("raw", vector_to_array("rawPrediction"))
        odds = found.withColumn("e", F.transform("raw", lambda r: 1 / (1 + F.exp(-r))))
        total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
        return odds.withColumn("total", total).withColumn("probs", F.transform("e", lambda x: x / F.col("total"))).select("id", _padded(classes).alias("probs"))
