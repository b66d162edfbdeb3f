"""Errors raised while a plan is built or a gate is checked."""


class TallylineError(Exception):
    """Base of all errors of this package."""


class UnknownColumn(TallylineError):
    """A name matches no column, or more than one."""


class UnknownOperation(TallylineError):
    """An operation, format, rule or step type that does not exist."""


class ConfigError(TallylineError):
    """A description that cannot be turned into a plan."""


class MissingInput(TallylineError):
    """An input path that has no file."""


class GateFailed(TallylineError):
    """A count, date or existence check that did not hold."""


class InvalidRows(TallylineError):
    """Rows broke validation rules and the step is set to abort."""

    def __init__(self, step: str, count: int, samples: list[str]):
        self.step = step
        self.count = count
        self.samples = samples
        super().__init__(f"{step}: {count} invalid row(s), first errors: {samples}")


class RunInterrupted(TallylineError):
    """An earlier attempt of the run ended where doing it again could add rows twice."""
