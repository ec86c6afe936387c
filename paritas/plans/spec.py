"""What a decoder and a window are asked to do. A specification that can't be followed isn't made."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

from paritas.functions.fixedpoint import grid

BOUNDARIES = ("exact", "uniform")
FAILURE_POLICIES = ("commit_anyway", "flag", "defer")
STOPPING_RULES = ("after_leg0", "after_n_converged", "all_legs")


def insist(what: str, *rules: tuple[str, bool]) -> None:
    """Raises one error that lists every rule that doesn't hold."""
    broken = [rule for rule, holds in rules if not holds]
    if broken:
        raise ValueError(f"{what}: " + "; ".join(broken))


class FromFields:
    """Specifications travel as flat objects with exactly their fields."""

    @classmethod
    def parse(cls, values: dict):
        expected = {f.name for f in fields(cls)}
        insist(cls.__name__, (f"the fields must be {sorted(expected)}", set(values) == expected))
        return cls(**values)

    def json(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class WindowSpec(FromFields):
    """Windows of ``width`` rounds that commit the first ``commit`` and must converge on ``converge_rounds``.

    iteration_cap: most iterations of the inner decoder in one attempt, None for its own limit.
    """

    width: int
    commit: int
    converge_rounds: int
    boundary: str = "exact"
    on_failure: str = "commit_anyway"
    max_deferrals: int = 0
    merge_truncated: bool = True
    iteration_cap: int | None = None

    def __post_init__(self) -> None:
        insist(
            f"window {self.width}/{self.commit}",
            ("rounds must satisfy 1 <= commit <= converge_rounds <= width", 1 <= self.commit <= self.converge_rounds <= self.width),
            (f"boundary is one of {BOUNDARIES}", self.boundary in BOUNDARIES),
            (f"on_failure is one of {FAILURE_POLICIES}", self.on_failure in FAILURE_POLICIES),
            ("only deferring windows have deferrals", self.max_deferrals == 0 or self.on_failure == "defer"),
            ("a cap allows one iteration at least", self.iteration_cap is None or self.iteration_cap >= 1),
            ("only exact windows may keep cut columns apart", self.merge_truncated or self.boundary == "exact"),
        )


@dataclass(frozen=True)
class RelaySpec(FromFields):
    """A first leg of ``pre_iter`` iterations, then up to ``num_sets`` legs of ``set_max_iter``.

    gamma0: memory strength of the first leg, None for none. stopping: one of STOPPING_RULES. alpha:
    the damping of check messages, None for 1 - 2^-(t + 1) at iteration t. cap: most iterations of a
    whole decode. arithmetic: "float" or a fixed-point grid.
    """

    pre_iter: int
    num_sets: int = 0
    set_max_iter: int = 0
    gamma0: float | None = None
    stopping: str = "after_n_converged"
    stop_count: int = 1
    alpha: float | None = 1.0
    cap: int | None = None
    arithmetic: str = "float"

    def __post_init__(self) -> None:
        fixed = self.arithmetic != "float"
        if fixed:
            grid(self.arithmetic)
        insist(
            "relay",
            ("every leg needs iterations", self.pre_iter > 0 and self.num_sets >= 0 and (self.num_sets == 0 or self.set_max_iter > 0)),
            (f"stopping is one of {STOPPING_RULES}", self.stopping in STOPPING_RULES),
            ("integers are damped by shifts only: alpha 1 or 1 - 2^-k", not fixed or self.alpha in (None, 1.0) or self.damping_bits(0) is not None),
        )

    def damping(self, t: int) -> float:
        """The factor of check messages at iteration t of a leg."""
        return self.alpha if self.alpha is not None else 1.0 - math.ldexp(1.0, -1 - t)

    def damping_bits(self, t: int) -> int | None:
        """k where the factor is 1 - 2^-k, so that a shift by k bits damps; None if there is no such k up to 30 or it is 1."""
        mantissa, exponent = math.frexp(1.0 - self.damping(t)) if self.alpha is not None else (0.5, -t)
        return 1 - exponent if mantissa == 0.5 and (self.alpha is None or 1 <= 1 - exponent <= 30) else None
