"""Parameter grids and their reports."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame

from tessera.sources.shipping import sound_unions


def combinations(grid: dict[str, list]) -> list[dict]:
    """Every choice of one value for each name, the last name varying fastest, as nested settings with a ``_name``.

    A name with dots is a path: ``a.b`` is b of a. A null value leaves its path out, of the name too. The name is that of each path's
    last part and its value, in letters, digits and underscores; an empty grid, and a choice of nulls alone, is ``default``.
    """
    out = []
    for values in itertools.product(*grid.values()):
        settings: dict = {}
        parts = []
        for path, value in zip(grid, values, strict=True):
            if value is None:
                continue
            *above, last = path.split(".")
            level = settings
            for name in above:
                level = level.setdefault(name, {})
            level[last] = value
            parts.append(segment(last + _said(value)))
        out.append({**settings, "_name": "_".join(parts) or "default"})
    return out


def _said(value: object) -> str:
    """A value in a name: the entries of settings and lists one after the other."""
    if isinstance(value, dict):
        return "_".join(f"{k}{_said(v)}" for k, v in value.items())
    return "_".join(map(_said, value)) if isinstance(value, (list, tuple)) else str(value)


def by_rebuild_cost(settings: list[dict], slowest: str | tuple[str, ...] = "hnsw") -> list[dict]:
    """Stable order in which settings that need a rebuild change least often, the first of ``slowest`` least."""
    names = (slowest,) if isinstance(slowest, str) else slowest
    sortable = lambda x: repr(sorted((k, sortable(v)) for k, v in x.items())) if isinstance(x, dict) else repr(x)
    return sorted(settings, key=lambda s: tuple(sortable(s.get(n)) for n in names))


def flattened(row: dict, prefix: str = "") -> dict:
    """Nested settings as one level, with names joined by dots."""
    out = {}
    for name, value in row.items():
        out |= flattened(value, f"{prefix}{name}.") if isinstance(value, dict) else {f"{prefix}{name}": value}
    return out


def segment(name: str) -> str:
    """A name of letters, digits and underscores, fit for indexes, collections and paths."""
    return re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_")


def route(settings: dict, search_names: set[str]) -> dict[str, dict]:
    """Settings by what they change: the query, the search parameters, or the load."""
    out: dict[str, dict] = {"query": {}, "search_params": {}, "load": {}}
    for name, value in settings.items():
        out["query" if name in ("top_k", "rbo_p") else "search_params" if name in search_names else "load"][name] = value
    return out


def insert_action(exists: bool, always: bool = False, skip_existing: bool = False) -> str:
    if always:
        return "recreate"
    if not exists:
        return "load"
    return "skip" if skip_existing else "abort"


def expanded(text: str, environment: dict[str, str]) -> str:
    """``${NAME}`` and ``${NAME:-default}`` by an environment; a name without a value is an error."""

    def value(m: re.Match) -> str:
        name, default = m.group(1), m.group(2)
        if name not in environment and default is None:
            raise ValueError(f"{name} is not set")
        return environment.get(name, default)

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text)


def human(size: float) -> str:
    """A number of bytes to be read: 1536 is 1.5 KiB."""
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            return f"{size:.0f} {unit}" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024


def report(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    sound_unions(parts[0].sparkSession)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
