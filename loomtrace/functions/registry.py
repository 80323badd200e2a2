"""Functions by name, for programs and the command line.

A function says what its arguments are by annotation: an OCLog or a case log is given as a path and
read by its format, other arguments as JSON or text.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomtrace.log import OCLog

_FUNCTIONS: dict[str, Function] = {}


@dataclass(frozen=True)
class Function:
    name: str
    call: Callable
    doc: str
    parameters: dict[str, Any]

    def schema(self) -> dict:
        """Arguments as a JSON schema; those without a default are required."""
        kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
        props = {}
        for n, p in self.parameters.items():
            text = str(p.annotation)
            kind = next((v for k, v in kinds.items() if text.startswith(k)), "object" if "OCLog" not in text and "DataFrame" not in text else "string")
            props[n] = {"type": kind, "description": text} | ({} if p.default is inspect.Parameter.empty else {"default": repr(p.default)})
        return {"type": "object", "properties": props, "required": [n for n, p in self.parameters.items() if p.default is inspect.Parameter.empty]}


def register(call: Callable, name: str | None = None) -> Callable:
    f = Function(name or call.__name__, call, (inspect.getdoc(call) or "").split("\n\n")[0], dict(inspect.signature(call).parameters))
    _FUNCTIONS[f.name] = f
    return call


def functions() -> dict[str, Function]:
    if not _FUNCTIONS:
        _fill()
    return dict(_FUNCTIONS)


def _fill() -> None:
    from loomtrace.operators import abstraction, cases, conformance, declare, negative, objects, paths

    for module, prefix in ((cases, "log_"), (objects, "oc_"), (paths, "path_"), (conformance, "conformance_"), (abstraction, "language_")):
        for n, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not n.startswith("_"):
                register(f, prefix + n)
    for f, n in ((declare.check, "declare_check"), (declare.discover, "declare_discover"), (declare.candidate_table, "declare_candidate_table"), (negative.discover, "negative_discover"), (negative.discover_reduced, "negative_discover_reduced")):
        register(f, n)


def resolve(spark: SparkSession, parameter: inspect.Parameter, value: Any) -> Any:
    """An argument as the function wants it: paths of logs are read, texts parsed as JSON if they can be."""
    kind = str(parameter.annotation)
    if isinstance(value, str) and "OCLog" in kind:
        from loomtrace.sources.ocel import read_ocel

        return read_ocel(spark, value)
    if isinstance(value, str) and "DataFrame" in kind:
        from loomtrace.sources.xes import read_log

        return read_log(spark, value)
    if isinstance(value, str) and not kind.startswith("str"):
        try:
            value = json.loads(value)
        except ValueError:
            pass
    if kind.startswith(("Options",)) and isinstance(value, dict):
        from loomtrace.operators.declare import Options

        return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
    if kind.startswith("tuple") or kind.startswith("TypeRef"):
        return tuple(value) if isinstance(value, list) else value
    return value


def call(spark: SparkSession, name: str, arguments: dict[str, Any]) -> Any:
    f = functions()[name]
    unknown = set(arguments) - set(f.parameters)
    if unknown:
        raise TypeError(f"{name} has no argument {sorted(unknown)[0]!r}")
    return f.call(**{k: resolve(spark, f.parameters[k], v) for k, v in arguments.items()})


def plain(value: Any) -> Any:
    """A result as values that JSON can hold; frames become lists of rows."""
    if isinstance(value, DataFrame):
        return [plain(r.asDict(recursive=True)) for r in value.toLocalIterator()]
    if isinstance(value, OCLog):
        return {k: plain(getattr(value, k)) for k in ("ev", "ob", "e2o", "o2o", "obj_attr", "ev_attr")}
    if hasattr(value, "text") and callable(value.text):
        return value.text()
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)
