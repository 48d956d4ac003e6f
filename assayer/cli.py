"""Command line. Refusals are printed and end with status 1."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

import yaml

from assayer.errors import Refusal
from assayer.operators import construct, freeze, project, rules
from assayer.operators.claims import Register
from assayer.operators.provenance import file_digest, read_artifact
from assayer.operators.resolution import THRESHOLD


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("assayer").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _channels(a) -> None:
    found = project.check_channels(_spark(), a.registry, a.fixture, a.fixtures_dir, a.out)
    print(f"every column of {len(found)} tasks is registered; see {a.out}")


def _rules(a) -> int:
    """The null-input test of the rules named, of those a questions file uses, or of all."""
    names = a.rule or (sorted({q["rule"] for q in project.load_questions(a.questions)["questions"]}) if a.questions else sorted(rules.RULES))
    found = rules.null_suite(_spark(), names, a.draws).orderBy("rule").collect()
    for r in found:
        print(f"{'passed' if r['passed'] else 'FAILED'}: {r['rule']}, {r['effects']} of {r['draws']} draws claim an effect, {r['exact_claims']} of one method against itself")
    return 0 if all(r["passed"] for r in found) else 1


def _run(a) -> None:
    project.run(_spark(), a.grid, a.rerun_stale).show(100, truncate=False)


def _coverage(a) -> None:
    project.status(_spark(), a.grid).show(100, truncate=False)


def _resolve(a) -> None:
    found = project.resolve(_spark(), a.grid, a.out, a.draws, a.threshold, a.methods)
    for c, r in sorted(found["cells"].items()):
        print(f"{c}: floor {r['floor']:.4f} by {r['source']}{', underpowered' if r['underpowered'] else ''}")


def _verdict(a) -> None:
    for v in project.decide(_spark(), a.questions, a.out)["verdicts"]:
        print(f"{v['id']}: {v['outcome']}{' (by oracle selection)' if v['oracle'] else ''}, {v['summary']}")
        for s in v["selections"]:
            print(f"    {s['cell']}: {s['chosen']} of {', '.join(s['candidates'])} by {s['on']} scores")


def _snapshot(questions: str, name: str) -> dict:
    found = [q for q in project.load_questions(questions)["questions"] if q["id"] == name]
    if not found:
        raise Refusal(f"{questions} has no question {name!r}")
    return project.snapshot(found[0])


def _register(a) -> None:
    version = construct.load(a.construct)["version"]
    print(Register(a.log).register(a.claim, a.question, a.prediction, _snapshot(a.questions, a.question), version, a.statement, a.exploratory)["hash"])


def _amend(a) -> None:
    own = Register(a.log)
    known = own.known(a.claim)
    question = a.question or known["question"]
    version = construct.load(a.construct)["version"]
    print(own.amend(a.claim, a.prediction or known["prediction"], _snapshot(a.questions, question), version, a.reason, a.statement, question)["hash"])


def _claims(a) -> None:
    found = read_artifact(a.verdicts)
    grid = Path(a.verdicts).parent / yaml.safe_load((Path(a.verdicts).parent / found["_provenance"]["inputs"]["questions"]["path"]).read_text(encoding="utf-8"))["grid"]
    first = project.first_run(project.prepare(_spark(), grid))
    if first is None:
        raise Refusal(f"the history of {grid} has no run")
    for e in Register(a.log).resolve({v["id"]: v for v in found["verdicts"]}, file_digest(a.verdicts), first, str(a.verdicts)):
        print(f"{e['claim']}: {e['status']}")


def _table(a) -> None:
    for name, c in sorted(Register(a.log).state().items()):
        kind = "exploratory" if c.get("exploratory") else "registered"
        late = " (amended after results)" if (c.get("resolution") or {}).get("amended_after_results") else " (amended)" if c["amendments"] else ""
        print(f"{name:10} {c['status']:12} {kind:12} {c.get('statement') or ''}{late}")


def _document(a) -> None:
    for name, state in Register(a.log).check_document(Path(a.path).read_text(encoding="utf-8"), a.require_all).items():
        print(f"{name}: {state}")


def _show(a) -> None:
    freeze.report(_spark(), a.folder).show(1000, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assayer")
    kinds = top.add_subparsers(required=True, dest="unit")

    def command(unit, name: str, run, *args: tuple) -> None:
        p = unit.add_parser(name)
        for flags, options in args:
            p.add_argument(*flags, **options)
        p.set_defaults(run=run)

    arg = lambda *flags, **options: (flags, options)
    unit = lambda name: kinds.add_parser(name).add_subparsers(required=True)
    command(unit("construct"), "check", lambda a: print("version", construct.load(a.path)["version"]), arg("path", nargs="?", default="construct.yaml"))
    frozen = unit("fixtures")
    command(frozen, "freeze", lambda a: print(freeze.freeze(_spark(), a.spec, a.out)), arg("spec", nargs="?", default="fixtures.yaml"), arg("--out", default="fixtures"))
    command(frozen, "show", _show, arg("folder"))
    fixture = [arg("--fixture", default="fixtures.yaml"), arg("--fixtures-dir", default="fixtures")]
    command(unit("channels"), "check", _channels, arg("registry", nargs="?", default="channels.yaml"), *fixture, arg("--out", default="channel_manifest.json"))
    grid = arg("grid", nargs="?", default="grid.yaml")
    command(kinds, "run", _run, grid, arg("--rerun-stale", action="store_true"))
    command(kinds, "coverage", _coverage, grid)
    command(kinds, "resolve", _resolve, grid, arg("--out"), arg("--methods", nargs="+"), arg("--draws", "--n-boot", type=int, default=1000), arg("--threshold", type=float, default=THRESHOLD))
    command(unit("rules"), "test", _rules, arg("questions", nargs="?"), arg("--rule", nargs="+"), arg("--draws", type=int, default=rules.DRAWS))
    command(kinds, "verdict", _verdict, arg("questions", nargs="?", default="questions.yaml"), arg("--out"))
    claim = unit("claims")
    log = arg("--log", default="claims.jsonl")
    stated = [arg("--questions", default="questions.yaml"), arg("--construct", default="construct.yaml"), log]
    need = {"required": True}
    command(claim, "register", _register, arg("claim"), arg("--statement", **need), arg("--question", **need), arg("--prediction", **need), arg("--exploratory", action="store_true"), *stated)
    command(claim, "amend", _amend, arg("claim"), arg("--reason", **need), arg("--prediction"), arg("--statement"), arg("--question"), *stated)
    command(claim, "untested", lambda a: print(Register(a.log).untested(a.claim, a.reason)["hash"]), arg("claim"), log, arg("--reason", **need))
    command(claim, "resolve", _claims, arg("--verdicts", default="verdicts.json"), log)
    command(claim, "show", _table, log)
    command(claim, "check-doc", _document, arg("path"), log, arg("--require-all", action="store_true"))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a) or 0
    except Refusal as e:
        print("\n".join(f"refused: {p}" for p in e.problems), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
