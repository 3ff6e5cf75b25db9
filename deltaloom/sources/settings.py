"""Layered settings on the driver: defaults, file, template, environment, command line; later layers win."""

from __future__ import annotations

import argparse
import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

Value = bool | int | float | str | list


def scalar(text: str) -> Value:
    """Boolean word, else integer, else number, else text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def expand(text: str, env: Mapping[str, str]) -> str:
    """``${NAME}`` becomes the variable's value, or nothing."""
    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], ""), text)


def flatten(tree: Mapping, prefix: str = "") -> dict[str, Value]:
    out: dict[str, Value] = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": v}
    return out


def parse_yaml(text: str, env: Mapping[str, str] | None = None) -> dict[str, Value]:
    """Nested mappings, scalars and lists of scalars by indentation: what settings files use. Other YAML isn't read."""
    env = os.environ if env is None else env
    out: dict[str, Value] = {}
    path: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip() or body.strip() == "---":
            continue
        indent = len(body) - len(body.lstrip())
        body = body.strip()
        if body.startswith("- "):
            key = ".".join(k for _, k in path)
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(scalar(expand(body[2:].strip().strip("'\""), env)))
            continue
        key, mark, value = body.partition(":")
        if not mark:
            raise ValueError(f"not a setting: {line!r}")
        path = [(i, k) for i, k in path if i < indent] + [(indent, key.strip())]
        value = value.strip()
        if not value:
            continue
        name = ".".join(k for _, k in path)
        if value.startswith("[") and value.endswith("]"):
            out[name] = [scalar(expand(v.strip().strip("'\""), env)) for v in value[1:-1].split(",") if v.strip()]
        elif value[0] in "'\"":
            out[name] = expand(value.strip(value[0]), env)
        else:
            out[name] = scalar(expand(value, env))
    return out


@dataclass(frozen=True)
class Rule:
    """What a setting must be: its type, range, allowed values, and whether it must be there."""

    kind: type | tuple[type, ...]
    low: float | None = None
    high: float | None = None
    allowed: tuple = ()
    required: bool = False


def check(settings: Mapping[str, Value], rules: Mapping[str, Rule]) -> list[str]:
    """A message for each fault; none if all is well."""
    faults = []
    for name, rule in rules.items():
        if name not in settings:
            if rule.required:
                faults.append(f"{name} is missing")
            continue
        v = settings[name]
        kinds = rule.kind if isinstance(rule.kind, tuple) else (rule.kind,)
        if not isinstance(v, kinds) or (isinstance(v, bool) and bool not in kinds):
            faults.append(f"{name} has the wrong type")
        elif rule.low is not None and v < rule.low or rule.high is not None and v > rule.high:
            faults.append(f"{name} is out of range")
        elif rule.allowed and v not in rule.allowed:
            faults.append(f"{name} isn't an allowed value")
    return faults


def from_environment(prefix: str, env: Mapping[str, str] | None = None) -> dict[str, Value]:
    """``PREFIX_A__B=x`` sets ``a.b``."""
    env = os.environ if env is None else env
    return {k[len(prefix) + 1 :].lower().replace("__", "."): scalar(v) for k, v in env.items() if k.startswith(prefix + "_")}


def from_command_line(args: list[str]) -> dict[str, Value]:
    """``--set a.b=x`` any number of times, and ``--config-json`` for whole trees."""
    parser = argparse.ArgumentParser()
    parser.add_argument("--set", action="append", default=[])
    parser.add_argument("--config-json", default="{}")
    given = parser.parse_args(args)
    pairs = (x.partition("=") for x in given.set)
    return flatten(json.loads(given.config_json)) | {k: scalar(v) for k, _, v in pairs}


def layered(*layers: Mapping[str, Value]) -> dict[str, Value]:
    out: dict[str, Value] = {}
    for layer in layers:
        out |= layer
    return out
