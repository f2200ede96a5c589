"""Categories of content from definitions in TOML (SRC16, ST01, ST03, JN13, SF10, SF11).

``[[categories]]`` have ``name``, ``keywords`` and ``patterns`` with weights of
1 to 10, ``exclude_keywords`` and ``ext``. The keywords of all categories make
one automaton that goes over a text once; its size is that of the definitions.
Phrases count where no letter or digit adjoins them, each once for a document,
found in the text or else in the file's name.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .text import fold

#: Most definitions' text (characters): they go to every executor. A result's points, at least, and keywords, at most.
MAX_DEFINITIONS = 1 << 20
LEAST, MAX_HITS = 3, 8
RESULT = "category string, score long, confidence double, category2 string, confidence2 double, hits array<string>"


@dataclass(frozen=True)
class Category:
    name: str
    keywords: dict[str, int] = field(default_factory=dict)
    patterns: dict[str, int] = field(default_factory=dict)
    exclude_keywords: tuple[str, ...] = ()
    ext: tuple[str, ...] = ()
    description: str = ""
    kind: str = "text"


def _read(text: str) -> tuple[dict[str, Category], list[str]]:
    if len(text) > MAX_DEFINITIONS:
        raise ValueError(f"definitions of more than {MAX_DEFINITIONS} characters")
    held, found = tomllib.loads(text), {}
    for i, raw in enumerate(held.get("categories", [])):
        name = raw.get("name") or f"category {i + 1}"
        if unknown := set(raw) - set(Category.__dataclass_fields__):
            raise ValueError(f"{name}: unknown key {sorted(unknown)[0]}")
        if name in found:
            raise ValueError(f"{name}: the name is used twice")
        for key in ("keywords", "patterns"):
            if bad := [k for k, w in raw.get(key, {}).items() if not k or not isinstance(w, int) or not 1 <= w <= 10]:
                raise ValueError(f"{name}: the weight of {bad[0]!r} is not 1 to 10")
        for pattern in raw.get("patterns", {}):
            try:
                regex.compile(pattern)
            except regex.error as e:
                raise ValueError(f"{name}: {e}") from None
        lower = {key: tuple(x.lower() for x in raw.get(key, ())) for key in ("exclude_keywords", "ext")}
        found[name] = Category(**(raw | {"name": name, "keywords": {k.lower(): w for k, w in raw.get("keywords", {}).items()}} | lower))
    return found, held.get("disable_builtin", [])


def load(base: str, own: str = "") -> list[Category]:
    """The categories of ``base`` without those that ``own`` disables or replaces, and those of ``own``, by name."""
    first, _ = _read(base)
    second, disabled = _read(own)
    if unknown := [n for n in disabled if n not in first]:
        raise ValueError(f"disable_builtin: {unknown[0]} is no category")
    return sorted(({k: v for k, v in first.items() if k not in disabled} | second).values(), key=lambda c: c.name)


def name_text(name: Column) -> Column:
    """A file's name without its extension, folded, with its separators as spaces."""
    return fold(F.regexp_replace(F.regexp_replace(name, r"(?s)^(.*)\.[^.]*$", "$1"), "[_.()-]", " "))


class Scorer:
    """One pass over a text for all keywords."""

    def __init__(self, categories: list[Category]):
        self.categories = [c for c in categories if c.kind == "text"]
        self.patterns = [{p: regex.compile(p) for p in c.patterns} for c in self.categories]
        slots: dict[str, set[str]] = {}
        for c in self.categories:
            for k in (*c.keywords, *c.exclude_keywords):
                slots.setdefault(k, set()).add(k)
                # the spelling without umlauts counts for the same keyword
                slots.setdefault(_spelled(k), set()).add(k)
        self.automaton = ahocorasick.Automaton()
        for form, keywords in slots.items():
            self.automaton.add_word(form, (form, tuple(sorted(keywords))))
        if slots:
            self.automaton.make_automaton()
        self.empty = not slots

    def found(self, text: str) -> set[str]:
        out: set[str] = set()
        if self.empty or not text:
            return out
        for last, (form, keywords) in self.automaton.iter(text):
            first = last - len(form) + 1
            left = first and form[0].isalnum() and text[first - 1].isalnum()
            right = last + 1 < len(text) and form[-1].isalnum() and text[last + 1].isalnum()
            if not left and not right:
                out.update(keywords)
        return out

    def score(self, text: str | None, folded: str | None, name: str, ext: str) -> tuple:
        in_text, in_name, scored = self.found(folded or ""), self.found(name), []
        for c, patterns in zip(self.categories, self.patterns, strict=True):
            if (c.ext and ext not in c.ext) or any(k in in_text or k in in_name for k in c.exclude_keywords):
                continue
            hits = [(w, k if k in in_text else f"{k} (name)") for k, w in c.keywords.items() if k in in_text or k in in_name]
            hits += [(c.patterns[p], p) for p, r in patterns.items() if r.search(text or "") or r.search(name)]
            if hits:
                scored.append((sum(w for w, _ in hits), c.name, [h for _, h in sorted(hits, key=lambda x: (-x[0], x[1]))[:MAX_HITS]]))
        scored.sort(key=lambda x: (-x[0], x[1]))
        if not scored or scored[0][0] < LEAST:
            return None, None, None, None, None, None
        best, name1, hits1 = scored[0]
        second, name2, _ = scored[1] if len(scored) > 1 else (0, None, None)
        sure = _rounded(min(1.0, best / 8) * (1 - (second / best) ** 2))
        return name1, best, sure, name2, _rounded(min(1.0, second / 8) * second / best) if name2 else None, hits1


def _spelled(keyword: str) -> str:
    return keyword.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")


def _rounded(x: float) -> float:
    """Two decimals, half away from zero."""
    return int(x * 100 + 0.5) / 100


def categorize(files: DataFrame, categories: list[Category], text_col: str = "text", name_col: str = "name", ext_col: str = "ext", out_col: str = "found") -> DataFrame:
    """``files`` with a struct of ``RESULT``; its values are null where no category has ``LEAST`` points. Null texts and names are empty."""
    shared = files.sparkSession.sparkContext.broadcast(categories)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        columns = [part.split()[0] for part in RESULT.split(", ")]
        for batch in batches:
            rows = [scorer.score(*row) for row in zip(*batch, strict=True)]
            out = pd.DataFrame(rows, columns=columns, index=batch[0].index)
            yield out.astype({"score": "Int64", "confidence": "Float64", "confidence2": "Float64"})

    text, empty = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit("")
    return files.withColumn(out_col, run(text, fold(text), F.coalesce(name_text(F.col(f"`{name_col}`")), empty), F.coalesce(F.lower(F.col(f"`{ext_col}`")), empty)))
