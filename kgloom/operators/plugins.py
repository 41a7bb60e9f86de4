"""What a configuration names: factories by kind and name, built with their parameters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_FACTORIES: dict[tuple[str, str], Callable[..., Any]] = {}


def register(kind: str, name: str):
    """Registers a factory, a decorator; a name stands for one factory of its kind."""

    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        if (kind, name) in _FACTORIES:
            raise ValueError(f"{kind} {name!r} is registered already")
        _FACTORIES[kind, name] = f
        return f

    return add


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _FACTORIES if k == kind)


def build(kind: str, config: dict[str, Any]) -> Any:
    """The thing that ``config`` describes: its ``name`` picks the factory, its other entries are parameters; entries that are descriptions themselves (``kind`` and ``name``) are built first."""
    config = dict(config)
    name = config.pop("name")
    if (kind, name) not in _FACTORIES:
        raise KeyError(f"no {kind} {name!r}; there are {names(kind)}")
    made = {k: build(v["kind"], {x: y for x, y in v.items() if x != "kind"}) if isinstance(v, dict) and {"kind", "name"} <= v.keys() else v for k, v in config.items()}
    return _FACTORIES[kind, name](**made)
