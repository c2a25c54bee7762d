"""Named strategies that a user can add or replace: kernels, policies, validators, embedders, exporters, decomposers."""

from __future__ import annotations

from collections.abc import Callable

_STRATEGIES: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str, strategy: Callable) -> Callable:
    """Make a strategy known under a name of its kind; one of that name is replaced."""
    _STRATEGIES.setdefault(kind, {})[name] = strategy
    return strategy


def get(kind: str, name: str) -> Callable:
    """The strategy of that name; KeyError that lists the known ones, if there is none."""
    found = _STRATEGIES.get(kind, {})
    if name not in found:
        raise KeyError(f"no {kind} named {name}; there are {sorted(found)}")
    return found[name]


def names(kind: str) -> list[str]:
    return sorted(_STRATEGIES.get(kind, {}))
