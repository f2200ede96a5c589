"""A whole report in files: JSON, CSV, HTML and text (SNK04)."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from ..operators import dups, files as ops, order, tree
from .readers import safe

BOM = "\ufeff"


def build(files: DataFrame, dirs: DataFrame, errors: DataFrame, root: str, now: int, hosts: list[str] = (), old_days: int = 365, top: int = 50) -> dict[str, DataFrame]:
    """The lists of a report by name; ``overview`` is one row. Groups of duplicates carry their number."""
    groups = order.duplicate_groups(dups.exact_dups(files))
    members = dups.dup_members(files).select("size", "full_hash", "path", "mtime").join(groups.select("size", "full_hash", "group_no", "wasted", "instances"), ["size", "full_hash"])
    equal = tree.folder_groups(tree.fingerprints(files, dirs, root))
    return {
        "overview": ops.overview(files, dirs, errors),
        "extensions": ops.by_extension(files),
        "categories": ops.by_category(files),
        "ages": ops.age_classes(files, now),
        "top_files": ops.top_files(files, top),
        "top_dirs": tree.top_dirs(tree.size_tree(files, dirs, root), root, top),
        "old_files": ops.old_files(files, now, old_days),
        "duplicates": members.select("group_no", "size", "wasted", "instances", "path", "mtime"),
        "probable_duplicates": dups.probable_dups(files),
        "folder_duplicates": equal.select("fingerprint", "dir_key", "files", "bytes", "folders"),
        "similar": ops.similar_groups(files).select("dir_key", "normal", "group_ext", "path", "size", "exact_duplicate"),
        "problems": ops.problems(files, dirs, list(hosts)).withColumn("problems", F.array_join("problems", ",")),
        "structure": tree.structure_issues(files, dirs, root),
        "errors": errors,
    }


def write_json(report: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each list."""
    for name, rows in report.items():
        rows.write.mode("errorifexists").json(f"{path}/{name}")


def write_csv(report: dict[str, DataFrame], path: str) -> None:
    """A folder for each list: semicolons, a header that starts with a byte order mark, texts that no spreadsheet takes for a formula."""
    for name, rows in report.items():
        guarded = [safe(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema.fields]
        first = rows.columns[0]
        rows.select(*guarded).withColumnRenamed(first, BOM + first).write.mode("errorifexists").option("sep", ";").option("header", True).option("escape", '"').csv(f"{path}/{name}")


def _shown(rows: DataFrame, most: int) -> list[list[str]]:
    """The first rows in order of all columns; a report for people shows no more."""
    some = rows.orderBy(*rows.columns).limit(most).collect()
    return [["" if v is None else str(v) for v in row] for row in some]


def html_page(report: dict[str, DataFrame], title: str, most: int = 200) -> str:
    """One page with a table for each list, at most ``most`` rows of each."""
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, rows in report.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(v)}</td>" for v in row) + "</tr>" for row in _shown(rows, most))
        parts.append(f"<section id='{name}'><h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table></section>")
    return "".join(parts) + "</body></html>"


def text_page(report: dict[str, DataFrame], most: int = 10) -> str:
    """The report for a terminal: each list as aligned columns, at most ``most`` rows of each."""
    out = []
    for name, rows in report.items():
        table = [rows.columns, *_shown(rows, most)]
        widths = [max(len(row[i]) for row in table) for i in range(len(rows.columns))]
        out += [f"== {name}", *("  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip() for row in table), ""]
    return "\n".join(out)


def parse_formats(text: str) -> list[str]:
    """The formats in a comma-separated list, each once; ValueError for unknown ones and for none."""
    found = list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))
    if not found or (odd := [x for x in found if x not in ("json", "csv", "html", "terminal")]):
        raise ValueError(f"formats: {', '.join(odd) if found else 'none'}")
    return found


def write(report: dict[str, DataFrame], path: str, formats: str, title: str = "Report") -> str:
    """Writes the formats below ``path`` (``html`` as one file of a local folder) and returns the terminal's text, if asked for."""
    wanted = parse_formats(formats)
    if "json" in wanted:
        write_json(report, f"{path}/json")
    if "csv" in wanted:
        write_csv(report, f"{path}/csv")
    if "html" in wanted:
        Path(path).mkdir(parents=True, exist_ok=True)
        (Path(path) / "report.html").write_text(html_page(report, title), encoding="utf-8")
    return text_page(report) if "terminal" in wanted else ""
