"""Refusals. Each guard raises one of these; all derive from ``Refusal``."""


class Refusal(Exception):
    """A guard refused. ``problems`` lists everything found wrong, not the first thing only."""

    def __init__(self, problems: str | list[str]) -> None:
        self.problems = [problems] if isinstance(problems, str) else list(problems)
        super().__init__("; ".join(self.problems))


class ConstructError(Refusal):
    """The statement of what is measured, and why, is missing or malformed."""


class FixtureError(Refusal):
    """Rows can't be labelled, split or frozen as specified."""


class ChannelError(Refusal):
    """A column would reach a model outside its registered channel."""


class RunError(Refusal):
    """The grid can't run as planned."""


class StaleInput(Refusal):
    """An artifact's input, or the code, changed after it was written."""


class IncompleteGrid(Refusal):
    """Results were asked for over a grid with missing, stale or failed runs."""


class RuleError(Refusal):
    """A decision rule's inputs don't fit, or the rule fails its null-input test."""


class ClaimError(Refusal):
    """A claim is registered, amended or resolved out of order."""


class LogError(Refusal):
    """An append-only log was edited or can't be read."""


class UnpricedModel(Refusal):
    """A model was called that the pinned price table lacks."""


def refuse(kind: type[Refusal], problems: list[str]) -> None:
    if problems:
        raise kind(problems)
