"""Names of a panel's roles, options of a fit, and the errors of the engine."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

#: At or above this a nuclear-norm penalty leaves no low-rank part.
LARGE_PENALTY = 1e10


class PanelError(Exception):
    """Base of the engine's errors; ``code`` is stable."""

    code = 1


class InvalidSpec(PanelError):
    code = 2


class InvalidPanel(PanelError):
    code = 3


class NoTreatedCell(PanelError):
    code = 4


class NoControlCell(PanelError):
    code = 5


class MissingTreatmentCell(PanelError):
    code = 6


class SearchFailed(PanelError):
    code = 7


class PanelWarning(UserWarning):
    """A result stands, but on fewer fits than were asked for."""


@dataclass(frozen=True)
class SurveyDesign:
    stratum: str
    psu: str
    fpc: str | None = None
    nest: bool = False
    lonely: str = "skip"

    def __post_init__(self) -> None:
        if self.lonely not in ("skip", "centered", "fail"):
            raise InvalidSpec("lonely must be skip, centered or fail")


@dataclass(frozen=True)
class PanelSpec:
    outcome: str = "y"
    treatment: str = "d"
    unit: str = "unit"
    time: str = "time"
    covariates: tuple[str, ...] = ()
    weight: str | None = None

    def check(self, schema: T.StructType) -> None:
        """Roles are there, distinct, and numeric where they must be."""
        roles = [self.outcome, self.treatment, self.unit, self.time, *self.covariates, *([self.weight] if self.weight else [])]
        if len(set(roles)) < len(roles):
            raise InvalidSpec("a column has two roles")
        for c in roles:
            if c not in schema.names:
                raise InvalidSpec(f"no column {c}")
        for c in [r for r in roles if r not in (self.unit, self.time)]:
            if not isinstance(schema[c].dataType, (T.NumericType, T.BooleanType)):
                raise InvalidSpec(f"{c} is not numeric")


@dataclass(frozen=True)
class FitOptions:
    method: str = "twostep"
    lambdas: tuple[float, float, float] | None = None
    tol: float = 1e-6
    maxiter: int = 500
    n_boot: int = 200
    seed: int = 42
    ddof: int = 1
    ci: str = "percentile"
    level: float = 95.0
    #: How penalties are searched: ``cycling`` or ``exhaustive``; by default the first for twostep, the second for joint.
    cv: str | None = None
    #: Give up a combination once its score exceeds the best one's: the winner is the same. By default where the search is cycling.
    prune: bool | None = None

    def __post_init__(self) -> None:
        method = {"local": "twostep", "global": "joint"}.get(self.method, self.method)
        object.__setattr__(self, "method", method)
        if method not in ("twostep", "joint"):
            raise InvalidSpec("method is twostep or joint")
        if self.cv not in (None, "cycling", "exhaustive"):
            raise InvalidSpec("cv is cycling or exhaustive")
        if self.tol <= 0 or self.maxiter <= 0:
            raise InvalidSpec("tol and maxiter must be positive")
        if self.n_boot < 0 or self.n_boot == 1:
            raise InvalidSpec("n_boot is 0 or at least 2")
        if self.ddof not in (0, 1) or self.ci not in ("percentile", "t", "normal") or not 0 < self.level < 100:
            raise InvalidSpec("ddof is 0 or 1; ci percentile, t or normal; level between 0 and 100")
        if self.lambdas is not None:
            lt, lu, ln = self.lambdas
            if min(lt, lu, ln) < 0 or math.isinf(lt) or math.isinf(lu):
                raise InvalidSpec("penalties are not negative, and only the last may be infinite")


def search_mode(options: FitOptions) -> str:
    return options.cv or ("exhaustive" if options.method == "joint" else "cycling")


def effective_penalty(ln: float) -> float:
    """An infinite (or missing) nuclear-norm penalty as the large number that kernels use."""
    return LARGE_PENALTY if ln is None or math.isinf(ln) or ln >= 1e99 else float(ln)
