"""Operators by name, with the suffix of their outputs and their parameters.

Anything that takes a DataFrame and keyword parameters and returns a DataFrame can be registered; `run`
looks a name up, takes the parameters that the operator has and rejects others. `plans.batch` runs them over folders: a spec
says what kind of result to write, which files an operator wants, and whether it needs pixels at all.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Spec:
    name: str
    suffix: str
    func: Callable[..., DataFrame]
    description: str = ""
    defaults: dict = field(default_factory=dict)
    #: What comes back: an image (or several, told apart by `file`), a table of points or measurements, paths of what was written, or none.
    kind: str = "image"
    #: Takes a catalog (path) and those of the operator's parameters that it names; gives the files to read.
    wanted: Callable[..., DataFrame] | None = None
    #: False where the operator needs the plan of planes only.
    loads: bool = True


KINDS = ("image", "table", "path", "none")


REGISTRY: dict[str, Spec] = {}


def register(name: str, suffix: str, kind: str = "image", wanted: Callable[..., DataFrame] | None = None, loads: bool = True) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"{kind} is no kind of result")

    def keep(func: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        own = {k: p.default for k, p in inspect.signature(func).parameters.items() if p.default is not p.empty}
        REGISTRY[name] = Spec(name, suffix, func, (inspect.getdoc(func) or "").split("\n")[0], own, kind, wanted, loads)
        return func

    return keep


def names() -> list[str]:
    return sorted(REGISTRY)


def run(name: str, df: DataFrame, **parameters) -> DataFrame:
    spec = REGISTRY[name]
    if unknown := set(parameters) - set(inspect.signature(spec.func).parameters):
        raise TypeError(f"{name} has no parameters {sorted(unknown)}")
    return spec.func(df, **parameters)
