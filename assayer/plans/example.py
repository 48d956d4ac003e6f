"""A whole project on made-up trials, from the construct to checked claims: ``python -m assayer.plans.example FOLDER``."""

from __future__ import annotations

import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from assayer import cli
from assayer.sources.synthetic import trials

FILES = {
    "construct.yaml": """version: 1
stated_on: 2026-01-05
owner: The team
question: Which method should order new trials for review, and does the summary add to the structured fields?
decision: The order in which trials are read, and whether summaries are still collected.
target: {name: mortality, definition: a death reported in the results of the made-up trial}
metric: {name: pr_auc, reason: only the top of the list is read}
tasks:
  - {name: mortality, reason: the review is about mortality}
reported_numbers:
  - {name: pr_auc_by_cell, decision: which method serves each phase}
""",
    "fixtures.yaml": """construct: construct.yaml
id_column: trial_id
tasks:
  mortality: {source: data/trials.parquet, type: binary, label_rule: {column: died}, cell_by: phase}
split:
  test: {fraction: 0.25, key: test-v1}
  validation: 0.2
  keys: [split-0, split-1]
cutoffs: {model: 2023-01-01}
arms:
  seen: {cutoff: model, before: [results_posted_on]}
  unseen: {cutoff: model, after: [registered_on]}
""",
    "channels.yaml": """channels:
  tabular: {kind: numeric, columns: [age, enrollment], scale: true}
  sponsor: {kind: categorical, columns: [sponsor], encoding: one_hot}
  summary: {kind: text, columns: [summary]}
ignore:
  trial_id: the id
  phase: defines the cells
  died: the label
  registered_on: dates an arm
  results_posted_on: dates an arm
""",
    "methods.py": """from assayer.operators.methods import Method, REGISTRY


class Recall(Method):
    kinds = ("text",)

    def unavailable(self):
        return "no language model is at hand"


REGISTRY.setdefault("recall", Recall)
""",
    "grid.yaml": """construct: construct.yaml
fixture: fixtures.yaml
registry: channels.yaml
channel_manifest: channel_manifest.json
methods: [majority, logreg, hist_gbm, tfidf_logreg, recall]
methods_module: methods.py
split_keys: [split-0, split-1]
fit_seeds: [0, 1]
threads: 8
out: runs
""",
    "questions.yaml": """grid: grid.yaml
resolution: resolution.json
questions:
  - id: Q1
    question: Does the text model beat the better structured model on Phase1?
    rule: difference_clears_floor
    params: {cell: mortality/Phase1, a: tfidf_logreg, b: {select: [logreg, hist_gbm]}}
  - id: Q2
    question: Does the text model beat the better structured model in two phases or more?
    rule: k_of_n_cells
    params: {cells: [mortality/Phase1, mortality/Phase2, mortality/Phase3], a: tfidf_logreg, b: {select: [logreg, hist_gbm]}, k: 2}
""",
    "report.md": "The text helps on one phase [claim:C1] and not across them [claim:C2]; recall was not tested [claim:C3].\n",
}
CLAIMS = (("C1", "Q1", "effect:tfidf_logreg", "The text model is better on Phase1."), ("C2", "Q2", "no_effect", "The text model is not better across phases."), ("C3", "Q1", "effect", "A language model recalls outcomes."))


def write(spark: SparkSession, folder: str | Path, per_phase: int = 600) -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    trials(spark, per_phase).coalesce(1).write.mode("overwrite").parquet(str(folder / "data/trials.parquet"))


def before_runs() -> list[list[str]]:
    claims = [["claims", "register", c, "--question", q, "--prediction", p, "--statement", s] for c, q, p, s in CLAIMS]
    return [["construct", "check"], ["fixtures", "freeze"], ["channels", "check"], *claims, ["claims", "untested", "C3", "--reason", "no language model is at hand"]]


def after_runs(draws: int = 300) -> list[list[str]]:
    return [["coverage"], ["resolve", "--draws", str(draws)], ["verdict"], ["claims", "resolve"], ["claims", "show"], ["claims", "check-doc", "report.md", "--require-all"]]


def steps(folder: str | Path, commands: list[list[str]]) -> None:
    """Run commands in a project's folder; the first that is refused ends it."""
    back = os.getcwd()
    os.chdir(folder)
    try:
        for c in commands:
            if cli.main(c):
                raise SystemExit(f"refused: {' '.join(c)}")
    finally:
        os.chdir(back)


def main(folder: str) -> None:
    write(cli._spark(), folder)
    steps(folder, [*before_runs(), ["run"], *after_runs()])


if __name__ == "__main__":
    main(sys.argv[1])
