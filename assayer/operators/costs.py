"""Costs against a pinned price table, and deltas of repairs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.errors import LogError, UnpricedModel, refuse
from assayer.operators.logs import append


def rollup(calls: DataFrame, prices: DataFrame, strict: bool = True) -> DataFrame:
    """(model, calls, input_tokens, output_tokens, cost) of calls (model, input_tokens, output_tokens) under prices
    (model, input_per_1k, output_per_1k), one row a model. With ``strict`` a model without a price fails when its row is
    read; else its cost is null."""
    sums = calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.col("input_per_1k") + F.col("output_tokens") * F.col("output_per_1k")) / 1000
    if strict:
        cost = F.when(F.col("input_per_1k").isNull(), F.raise_error(F.concat(F.lit("a model has no price: "), "model")).cast("double")).otherwise(cost)
    return sums.join(prices, "model", "left").select("model", "calls", "input_tokens", "output_tokens", cost.alias("cost"))


def unpriced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    return calls.select("model").distinct().join(prices, "model", "left_anti")


def repair_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cell, before, after, delta) of (cell, value) and (cell, value); a cell that one side lacks has null there."""
    both = before.select("cell", F.col("value").alias("before")).join(after.select("cell", F.col("value").alias("after")), "cell", "full")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def record_repair(path: str, name: str, reason: str, before: Mapping[str, float], after: Mapping[str, float]) -> dict:
    """Log what a repair changed, cell by cell; refused unless both cover the same cells."""
    refuse(LogError, [] if set(before) == set(after) and before else ["a repair is measured on the same cells before and after"])
    deltas = {c: after[c] - before[c] for c in sorted(before)}
    return append(path, {"kind": "repair", "name": name, "reason": reason, "deltas": deltas, "mean_delta": sum(deltas.values()) / len(deltas)})


@dataclass(frozen=True)
class PriceTable:
    models: Mapping[str, Mapping]
    currency: str = "USD"

    @classmethod
    def from_dict(cls, raw: Mapping) -> PriceTable:
        out = []
        for m, p in (raw.get("models") or {}).items():
            out += [f"price of {m}: {k} is required" for k in ("input_per_1k", "output_per_1k", "read_on", "source_url") if k not in p]
            out += [f"price of {m}: {k} must be a number from 0 on" for k in ("input_per_1k", "output_per_1k") if k in p and (isinstance(p[k], bool) or not isinstance(p[k], int | float) or p[k] < 0)]
        refuse(UnpricedModel, out or ([] if raw.get("models") else ["a price table needs models"]))
        return cls(dict(raw["models"]), raw.get("currency", "USD"))


@dataclass
class Meter:
    """Tallies a run's calls; a call that can't be priced is refused before it is made."""

    prices: PriceTable | None
    calls: dict[str, list[int]] = field(default_factory=dict)

    def record(self, model: str, input_tokens: int, output_tokens: int) -> float:
        if self.prices is None:
            raise UnpricedModel("no price table was given")
        if model not in self.prices.models:
            raise UnpricedModel(f"the price table lacks {model}; the call is not made")
        own = self.calls.setdefault(model, [0, 0, 0])
        for i, n in enumerate((1, input_tokens, output_tokens)):
            own[i] += n
        return self.cost(model, input_tokens, output_tokens)

    def cost(self, model: str, input_tokens: int, output_tokens: int) -> float:
        p = self.prices.models[model]
        return (input_tokens * p["input_per_1k"] + output_tokens * p["output_per_1k"]) / 1000

    def totals(self) -> dict:
        by = {m: {"calls": c, "input_tokens": i, "output_tokens": o, "cost": self.cost(m, i, o)} for m, (c, i, o) in self.calls.items()}
        return {"currency": self.prices.currency if self.prices else None, "by_model": by, "total": sum(x["cost"] for x in by.values())}
