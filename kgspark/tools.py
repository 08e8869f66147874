"""Commands as tools: a manifest with argument schemas, validation, and execution in process."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from typing import Any

from . import cli

MAX_LENGTH = 4096
#: Error codes that a caller may see; anything else is internal.
CODES = ("invalid_input", "not_found", "secrets_left", "tls_required", "rule_pack", "internal")
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list}


class ToolError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code if code in CODES else "internal"


def manifest() -> list[dict[str, Any]]:
    """One tool for each command, its arguments taken from the command line's parser."""
    actions = next(a for a in cli.parser()._actions if isinstance(a, argparse._SubParsersAction))
    tools = []
    for name, sub in actions.choices.items():
        properties, required = {}, []
        for a in sub._actions:
            if a.dest == "help":
                continue
            kind = "boolean" if a.nargs == 0 else "array" if isinstance(a, argparse._AppendAction) else {int: "integer", float: "number"}.get(a.type, "string")
            properties[a.dest] = {"type": kind} | ({"maxLength": MAX_LENGTH} if kind == "string" else {}) | ({"enum": list(a.choices)} if a.choices else {})
            if a.required:
                required.append(a.dest)
        tools.append({"name": name.replace("-", "_"), "parameters": {"type": "object", "properties": properties, "required": required, "additionalProperties": False}})
    return tools


def validate(schema: dict[str, Any], arguments: dict[str, Any]) -> None:
    for name in schema["required"]:
        if name not in arguments:
            raise ToolError("invalid_input", f"{name} is missing")
    for name, value in arguments.items():
        spec = schema["properties"].get(name)
        if spec is None:
            raise ToolError("invalid_input", f"{name} is unknown")
        if not isinstance(value, KINDS[spec["type"]]) or (isinstance(value, bool) and spec["type"] != "boolean"):
            raise ToolError("invalid_input", f"{name} is no {spec['type']}")
        for text in value if isinstance(value, list) else [value]:
            if isinstance(text, str) and len(text) > MAX_LENGTH:
                raise ToolError("invalid_input", f"{name} is too long")
        if "enum" in spec and value not in spec["enum"]:
            raise ToolError("invalid_input", f"{name} is none of {', '.join(spec['enum'])}")


def argv(name: str, arguments: dict[str, Any]) -> list[str]:
    """The command line of a call; positionals come first."""
    actions = next(a for a in cli.parser()._actions if isinstance(a, argparse._SubParsersAction))
    first, rest = [], []
    for a in actions.choices[name.replace("_", "-")]._actions:
        value = arguments.get(a.dest)
        if value is None or value is False:
            continue
        if not a.option_strings:
            first.append(str(value))
        elif value is True:
            rest.append(a.option_strings[0])
        else:
            for v in value if isinstance(value, list) else [value]:
                rest.append(f"{a.option_strings[0]}={v}")
    return [name.replace("_", "-"), *rest, *(["--", *first] if first else [])]


def call(name: str, arguments: dict[str, Any], store: str = ".kg", run: Callable[[argparse.Namespace], dict] = cli.run) -> dict[str, Any]:
    """The tool's result, or an error object with a known code."""
    try:
        tool = next((t for t in manifest() if t["name"] == name), None)
        if tool is None:
            raise ToolError("not_found", f"no tool {name}")
        validate(tool["parameters"], arguments)
        return run(cli.parser().parse_args(["--store", store, *argv(name, arguments)]))
    except ToolError as error:
        return {"error": {"code": error.code, "message": str(error)}}
    except Exception as error:  # callers get a code, the log gets the rest
        print(repr(error), file=sys.stderr)
        codes = {"PostconditionFailed": "secrets_left", "TlsRequired": "tls_required", "RulePackError": "rule_pack"}
        return {"error": {"code": codes.get(type(error).__name__, "internal"), "message": type(error).__name__}}
