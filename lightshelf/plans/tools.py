"""A registry of operations that are called by name with arguments as they come, and the filters that a caller pins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from lightshelf.plans import parse

Handler = Callable[..., DataFrame]


@dataclass(frozen=True)
class Operation:
    """A name, what it does, its parameters (as JSON schema properties) and the function that plans it.

    Types are integer, number, boolean, string and array (of strings); a
    parameter may have `default`, `minimum`, `maximum` and `enum`.
    """

    name: str
    description: str
    parameters: dict[str, dict[str, Any]]
    handler: Handler
    filters: bool = True
    required: tuple[str, ...] = ()
    writes: bool = False

    def schema(self) -> dict[str, Any]:
        return {"type": "object", "properties": self.parameters, "required": list(self.required)}

    def coerced(self, arguments: dict[str, Any]) -> dict[str, Any]:
        """Arguments in the types of the parameters; unknown ones are left out, defaults added."""
        out = {}
        for key, kind in self.parameters.items():
            value = arguments.get(key)
            if value is None or value == "":
                if key in self.required:
                    raise ValueError(f"{self.name}: {key} is missing")
                if "default" in kind:
                    out[key] = kind["default"]
                continue
            if kind["type"] == "integer":
                out[key] = parse.clamp(value, kind.get("minimum", -(1 << 62)), kind.get("maximum", 1 << 62), kind.get("default", 0))
            elif kind["type"] == "number":
                out[key] = parse.number(value)
            elif kind["type"] == "boolean":
                out[key] = parse.truthy(value)
            elif kind["type"] == "array":
                out[key] = parse.strings(value)
            else:
                out[key] = str(value)
            if "enum" in kind and out[key] not in kind["enum"]:
                raise ValueError(f"{self.name}: unknown {key}: {value}")
        return out


#: Pinned parameters that only some operations take: name and operations.
SCOPED = {"per_day": ("daily_highlights",)}


def with_pinned(operation: Operation, arguments: dict[str, Any], pinned: dict[str, Any]) -> dict[str, Any]:
    """Arguments with the pinned filters: people are added, all others replace what was asked."""
    out = dict(arguments)
    for key, value in pinned.items():
        if key in SCOPED:
            if operation.name in SCOPED[key]:
                out[key] = value
        elif operation.filters:
            out[key] = list(dict.fromkeys(parse.strings(out.get(key)) + parse.strings(value))) if key == "people" else value
    return out


@dataclass
class Tools:
    """Operations by name."""

    held: dict[str, Operation] = field(default_factory=dict)

    def register(self, operation: Operation) -> Operation:
        if operation.name in self.held:
            raise ValueError(f"there is an operation {operation.name}")
        self.held[operation.name] = operation
        return operation

    def schemas(self, writes: bool = False) -> dict[str, dict[str, Any]]:
        """Parameters of all operations; those that write only if asked."""
        return {n: o.schema() for n, o in self.held.items() if writes or not o.writes}

    def call(self, name: str, arguments: dict[str, Any] | None = None, pinned: dict[str, Any] | None = None, **context: Any) -> DataFrame:
        """The plan of an operation; `context` (tables) is handed on."""
        if name not in self.held:
            raise ValueError(f"unknown operation: {name}")
        operation = self.held[name]
        return operation.handler(**context, **operation.coerced(with_pinned(operation, arguments or {}, pinned or {})))
