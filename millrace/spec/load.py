"""Reading specifications: files, inheritance, templates."""

from __future__ import annotations

import copy
import json
import os
import re
from pathlib import Path

import yaml

_TEMPLATE = re.compile(r"\{\{\s*(\w+)\s*\((.*?)\)\s*\}\}", re.S)
_ARGUMENT = re.compile(r"\s*(?:(\w+)\s*=\s*)?(?:'([^']*)'|\"([^\"]*)\"|(none|null))\s*(?:,|$)", re.I)


class SpecError(ValueError):
    """A specification that cannot be used. `problems` holds (place, message) pairs."""

    def __init__(self, problems: list[tuple[str, str]]):
        self.problems = problems
        super().__init__("; ".join(f"{place}: {message}" for place, message in problems))


def read(path: str | Path) -> dict:
    """A YAML or JSON document; an empty file is an empty mapping."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        loaded = json.loads(text) if str(path).endswith(".json") and text.strip() else yaml.safe_load(text)
    except (yaml.YAMLError, json.JSONDecodeError) as e:
        raise SpecError([("$", f"cannot be parsed: {e}")]) from e
    if loaded is None:
        return {}
    if not isinstance(loaded, dict):
        raise SpecError([("$", "a specification is a mapping")])
    return loaded


def find_parent(name: str, child: Path, search: list[Path]) -> Path:
    """The file of a parent: that of the child's folder first, then of each search path; names ignore case."""
    for folder in [child.parent, *search]:
        if not folder.is_dir():
            continue
        found = [p for p in sorted(folder.iterdir()) if p.suffix.lower() in (".yaml", ".yml") and p.stem.casefold() == name.casefold() and p.resolve() != child.resolve()]
        if len(found) > 1:
            raise SpecError([("$.extends", f"parent `{name}` is ambiguous: {', '.join(p.name for p in found)}")])
        if found:
            return found[0]
    raise SpecError([("$.extends", f"parent `{name}` was not found")])


def overlay(parent: dict, child: dict) -> dict:
    """The child on its parent: mappings merge, lists are replaced, target fields merge by id in the parent's order."""
    out = copy.deepcopy(parent)
    for key, value in child.items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key] = _overlay_target(out[key], value) if key == "target" else overlay(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def _overlay_target(parent: dict, child: dict) -> dict:
    out = overlay({k: v for k, v in parent.items() if k != "fields"}, {k: v for k, v in child.items() if k != "fields"})
    if "fields" in parent or "fields" in child:
        out["fields"] = _overlay_fields(parent.get("fields") or [], child.get("fields") or [])
    return out


def _overlay_fields(parent: list[dict], child: list[dict]) -> list[dict]:
    fields = {str(f.get("id")).casefold(): copy.deepcopy(f) for f in parent}
    for f in child:
        name = str(f.get("id")).casefold()
        fields[name] = overlay(fields[name], f) if name in fields else copy.deepcopy(f)
    return list(fields.values())


def inherit(path: str | Path, search: list[str | Path] = ()) -> dict:
    """The document of a file laid over all its ancestors."""
    at, chain, seen = Path(path), [], set()
    while True:
        doc = read(at)
        if at.resolve() in seen:
            raise SpecError([("$.extends", f"inheritance comes back to `{at.name}`")])
        seen.add(at.resolve())
        chain.append(doc)
        parent = doc.get("extends")
        if parent is None:
            break
        at = find_parent(str(parent), at, [Path(s) for s in search])
        found = read(at).get("id")
        if str(found).casefold() != str(parent).casefold():
            raise SpecError([("$.extends", f"`{at.name}` has id `{found}`, not `{parent}`")])
    out: dict = {}
    for doc in reversed(chain):
        out = overlay(out, doc)
    out.pop("extends", None)
    return out


def _arguments(text: str) -> list[tuple[str | None, str | None]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _ARGUMENT.match(text, at)
        if not m:
            raise SpecError([("$", f"template arguments cannot be read: {text}")])
        out.append((m[1], None if m[4] else m[2] if m[2] is not None else m[3]))
        at = m.end()
    return out


def is_bookmark_call(name: str) -> bool:
    return name.endswith("incremental_bookmark_predicate")


def bookmark_calls(query: str) -> list[tuple[str, str, str | None]]:
    """(template, timestamp expression, filter) of each bookmark predicate in a query."""
    out = []
    for m in _TEMPLATE.finditer(query or ""):
        if is_bookmark_call(m[1]):
            named = _arguments(m[2])
            places = [v for k, v in named if k is None]
            keys = {k: v for k, v in named if k}
            out.append((m[0], places[0] if places else keys["timestamp_column"], places[1] if len(places) > 1 else keys.get("watermark_filter")))
    return out


def substitute(node, variables: dict, place: str = "$", strict: bool = True):
    """Templates in every string replaced: var('name'[, 'default']) with or without a prefix, env_var alike.

    A missing value without default is an error, or stays where strict is false. Bookmark predicates stay for the load.
    """
    if isinstance(node, dict):
        return {k: substitute(v, variables, f"{place}.{k}", strict) for k, v in node.items()}
    if isinstance(node, list):
        return [substitute(v, variables, f"{place}[{i}]", strict) for i, v in enumerate(node)]
    if not isinstance(node, str) or "{{" not in node:
        return node

    def value(m: re.Match) -> str:
        if is_bookmark_call(m[1]):
            return m[0]
        if m[1] != "env_var" and m[1] != "var" and not m[1].endswith("_var"):
            raise SpecError([(place, f"template function `{m[1]}` is not allowed")])
        args = [v for _, v in _arguments(m[2])]
        known = os.environ if m[1] == "env_var" else variables
        if args and args[0] in known:
            return str(known[args[0]])
        if len(args) > 1:
            return "" if args[1] is None else args[1]
        if strict:
            raise SpecError([(place, f"variable `{args[0] if args else ''}` has no value")])
        return m[0]

    out = _TEMPLATE.sub(value, node)
    if strict and "{{" in _TEMPLATE.sub("", out):
        raise SpecError([(place, "a template cannot be read")])
    return out


def parse_variables(text: str | None) -> dict:
    """Variables of a command line: a YAML or JSON mapping."""
    loaded = yaml.safe_load(text) if text else {}
    if loaded is None:
        return {}
    if not isinstance(loaded, dict):
        raise SpecError([("--vars", "variables are a mapping")])
    return loaded


def resolve(path: str | Path, search: list[str | Path] = (), variables: dict | None = None, strict: bool = True) -> dict:
    """A file's document with its ancestors and variables."""
    return substitute(inherit(path, search), variables or {}, strict=strict)
