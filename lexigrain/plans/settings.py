"""Settings of an audit: JSON in, checked values out."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexigrain.operators.report import RANKS
from lexigrain.operators.transform import PROFILES, Profile


class SettingsError(ValueError):
    """All problems of one settings file."""


@dataclass(frozen=True)
class Settings:
    threshold: str = "critical"
    zalgo: bool = True
    zalgo_max_combining: int = 4
    context_radius: int = 12
    bidi: bool = True
    tags: bool = True
    variation_selectors: bool = True
    exclude_paths: tuple[str, ...] = ()
    overrides: tuple[tuple[int, str, str, str], ...] = ()
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(PROFILES))
    workspaces: dict[str, dict[str, int]] = field(default_factory=dict)


#: Least and most of the numeric settings.
BOUNDS = {"zalgo_max_combining": (2, 64), "context_radius": (0, 80), "max_blank_lines": (0, 10_000), "max_chars": (1, 1_000_000), "max_words": (1, 1_000_000), "max_lines": (1, 1_000_000)}


class Reading:
    """Values of a settings file as they are looked at: problems gather, and a wrong value gives null."""

    def __init__(self):
        self.problems: list[str] = []
        self.warnings: list[str] = []

    def fail(self, where: str, wanted: str) -> None:
        self.problems.append(f"{where}: {wanted}")

    def record(self, v: Any, where: str, known: Iterable[str] | None = None) -> dict:
        if not isinstance(v, dict):
            self.fail(where, "a record")
            return {}
        if known is not None:
            self.warnings += [f"{where}.{k}: not known" for k in v if k not in known]
            return {k: x for k, x in v.items() if k in known}
        return v

    def number(self, v: Any, where: str) -> int | None:
        low, high = BOUNDS[where.rpartition(".")[2]]
        if isinstance(v, int) and not isinstance(v, bool) and low <= v <= high:
            return v
        return self.fail(where, f"a whole number from {low} to {high}")

    def flag(self, v: Any, where: str) -> bool | None:
        return v if isinstance(v, bool) else self.fail(where, "true or false")

    def text(self, v: Any, where: str) -> str | None:
        return v if isinstance(v, str) else self.fail(where, "a text")

    def choice(self, v: Any, where: str, of: Iterable[str]) -> str | None:
        return v.lower() if isinstance(v, str) and v.lower() in of else self.fail(where, f"one of {', '.join(of)}")

    def texts(self, v: Any, where: str) -> tuple[str, ...] | None:
        if isinstance(v, list) and all(isinstance(x, str) for x in v):
            return tuple(v)
        return self.fail(where, "a list of texts")

    def code_point(self, v: Any, where: str) -> int | None:
        try:
            n = int(v, 16) if isinstance(v, str) else v if isinstance(v, int) and not isinstance(v, bool) else -1
        except ValueError:
            n = -1
        return n if 0 <= n <= 0x10FFFF else self.fail(where, "a code point in hexadecimal")


def _scanner(r: Reading, v: Any) -> dict[str, Any]:
    out = r.record(v, "scanner", ["threshold", "zalgo", "zalgo_max_combining", "context_radius", "bidi", "tags", "variation_selectors", "exclude_paths"])
    for k, x in out.items():
        at = f"scanner.{k}"
        out[k] = r.number(x, at) if k in BOUNDS else r.choice(x, at, RANKS) if k == "threshold" else r.texts(x, at) if k == "exclude_paths" else r.flag(x, at)
    return out


def _artifacts(r: Reading, v: Any) -> list[tuple[int, str, str, str]]:
    if not isinstance(v, list):
        r.fail("artifacts", "a list of records")
        return []
    out = []
    for i, a in enumerate(v):
        at = f"artifacts[{i}]"
        wrong = not isinstance(a, dict)
        a = r.record(a, at, ["code_point", "name", "severity", "fix_action"])
        if wrong:
            continue
        action = r.text(a.get("fix_action"), f"{at}.fix_action")
        if action is not None and action not in ("remove", "keep", "review"):
            if action.startswith("replace:"):
                r.code_point(action.removeprefix("replace:"), f"{at}.fix_action")
            else:
                r.fail(f"{at}.fix_action", "remove, keep, review or replace: with a code point")
        out.append((r.code_point(a.get("code_point"), f"{at}.code_point"), r.text(a.get("name"), f"{at}.name"), r.choice(a.get("severity"), f"{at}.severity", RANKS), action))
    twice = {c for c, *_ in out if c is not None and [o[0] for o in out].count(c) > 1}
    for c in sorted(twice):
        r.fail("artifacts", f"code point {c:#x} is given twice")
    return out


def _profile(r: Reading, v: Any, at: str) -> Profile | None:
    kinds = {f.name: f.type for f in fields(Profile)}
    v = r.record(v, at, [*kinds, "remove_invisibles"])
    before = len(r.problems)
    for k, x in v.items():
        if k in BOUNDS:
            r.number(x, f"{at}.{k}")
        elif "bool" in str(kinds.get(k, "bool")):
            r.flag(x, f"{at}.{k}")
        else:
            r.text(x, f"{at}.{k}")
    v.pop("remove_invisibles", None)
    if len(r.problems) > before:
        return None
    try:
        return Profile(**v)
    except (TypeError, ValueError) as e:
        r.fail(at, str(e))
        return None


def _workspaces(r: Reading, v: Any, profiles: dict) -> dict[str, dict]:
    out = {}
    for name, w in r.record(v, "workspaces").items():
        at = f"workspaces.{name}"
        out[name] = r.record(w, at)
        for k, x in out[name].items():
            if k in BOUNDS:
                r.number(x, f"{at}.{k}")
            elif k == "transform" and not (isinstance(x, str) and x in profiles):
                r.fail(f"{at}.transform", f"no profile named {x!r}")
    return out


def parsed(text: str) -> tuple[Settings, list[str]]:
    """(settings, warnings) from JSON; every problem is gathered before ``SettingsError`` is raised. Sections that are not known are warnings."""
    try:
        data = json.loads(text)
    except json.JSONDecodeError as e:
        raise SettingsError(f"invalid JSON: {e}") from e
    if not isinstance(data, dict):
        raise SettingsError("the top level must be a record")
    r = Reading()
    data = r.record(data, "settings", ["scanner", "artifacts", "profiles", "workspaces"])
    values = _scanner(r, data.get("scanner", {}))
    overrides = _artifacts(r, data.get("artifacts", []))
    profiles = dict(PROFILES)
    given = r.record(data.get("profiles", {}), "profiles")
    profiles |= {name: _profile(r, p, f"profiles.{name}") for name, p in given.items()}
    workspaces = _workspaces(r, data.get("workspaces", {}), profiles)
    if r.problems:
        raise SettingsError("\n".join(r.problems))
    return Settings(**values, overrides=tuple(overrides), profiles=profiles, workspaces=workspaces), r.warnings


def loaded(spark: SparkSession, path: str) -> tuple[Settings, list[str]]:
    """``parsed`` of a file that Spark reads; problems name it."""
    try:
        rows = spark.read.text(path, wholetext=True).head(2)
        if len(rows) != 1:
            raise SettingsError("not one file")
        return parsed(rows[0].value)
    except SettingsError as e:
        raise SettingsError("\n".join(f"{path}: {line}" for line in str(e).split("\n"))) from e


def overrides_table(spark: SparkSession, settings: Settings) -> DataFrame:
    """(code_point, name, severity, fix_action): the few rows of a settings file."""
    return spark.createDataFrame(list(settings.overrides), "code_point long, name string, severity string, fix_action string")
