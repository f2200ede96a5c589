"""Categories of junk files: built-in ones and a user's own (FL12)."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import names

#: Patterns of the built-in categories.
BUILT_IN = {
    "system": ("Thumbs.db", "ehthumbs.db", ".DS_Store"),
    "temp": ("*.tmp", "~$*"),
    "downloads": ("*.crdownload", "*.part", "*.partial"),
    "installer": ("*.exe", "*.msi"),
}


@dataclass(frozen=True)
class Category:
    """Files directly in one of ``dirs`` (None: anywhere) whose names match; older than ``min_age`` days, if set."""

    name: str
    patterns: tuple[str, ...]
    dirs: tuple[str, ...] | None = None
    min_age: int | None = None


def categories(active: list[str] = tuple(BUILT_IN), downloads: list[str] = (), installer_days: int = 90, own: list[Category] = ()) -> list[Category]:
    """The active categories in the order in which they are tried; ``installer`` looks only into ``downloads``."""
    mine = {c.name: c for c in own}
    out = []
    for name in active:
        if name == "installer":
            out.append(Category(name, BUILT_IN[name], tuple(downloads), installer_days))
        elif name in BUILT_IN:
            out.append(Category(name, BUILT_IN[name]))
        elif name in mine:
            out.append(mine[name])
        else:
            raise ValueError(f"{name}: no such category of junk")
    return out


def _fits(c: Category, name: Column, dir_key: Column) -> Column:
    fits = name.rlike("(?i)^(?:" + "|".join(fnmatch.translate(p).replace(r"\Z", "").replace(r"\z", "") for p in c.patterns) + ")$")
    return fits if c.dirs is None else fits & dir_key.isin([d.lower() for d in c.dirs])


def match(name: Column, dir_key: Column, active: list[Category]) -> Column:
    """The first category that fits by name and folder; its age is not asked."""
    out = F.lit(None).cast("string")
    for c in reversed(active):
        out = F.when(_fits(c, name, dir_key), c.name).otherwise(out)
    return out


def too_recent(category: Column, mtime: Column, now: int, active: list[Category]) -> Column:
    """The file is not yet older than its category asks; a file of another category is never."""
    out = F.lit(False)
    for c in active:
        if c.min_age is not None:
            out = out | ((category == c.name) & (names.age_days(mtime, now) <= c.min_age))
    return out
