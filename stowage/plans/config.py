"""Settings in TOML with profiles, and the fingerprint of those that decide metrics (SRC18, AG36)."""

from __future__ import annotations

import hashlib
import json
import tomllib

from ..functions import junk, text as texts

#: Settings and their defaults.
DEFAULTS = {
    "exclude": [], "summary_only": [], "no_default_excludes": False, "old_after": "1y", "top": 50, "max_depth_warning": 8, "huge_dir_entries": 1000,
    "onedrive_conflict_hostnames": [], "threads": 0, "protected_paths": [], "quarantine_days": 30, "junk_categories": ["system", "temp", "downloads", "installer"],
    "installer_min_age": "90d", "downloads_dirs": [], "junk_rules": [], "archive_older_than": "2y", "versions_min_age": "30d",
    "dedupe_dirs_copy_patterns": [], "dedupe_dirs_partial_threshold": 0.8, "onedrive_max_move_files": 1000, "onedrive_max_move_bytes": "5GB",
    "rules_file": None, "reports_keep": 12,
}
SECTIONS = {
    "weights": {"junk": 20, "duplicates": 25, "problems": 20, "structure": 20, "versions": 15, "template": 20},
    "notify": {"score_drop": 5, "score_below": 60},
}
#: Settings that a profile adds to, and those that it replaces.
EXTENDS = ["exclude", "summary_only", "protected_paths", "junk_categories"]
REPLACES = [
    "no_default_excludes", "old_after", "installer_min_age", "archive_older_than", "versions_min_age", "top", "max_depth_warning", "huge_dir_entries", "threads", "rules_file",
]
PROFILE_ONLY = ["root", "plans", "template", "force", "classify", "llm", "categories_file"]
#: Sections that other parts read.
OTHER = ["classify", "llm", "gui"]
RULE = ["name", "patterns", "min_age", "dirs"]
SETS = ["exclude", "summary_only", "downloads_dirs", "onedrive_conflict_hostnames"]


def _known(given: dict, names: list[str], where: str) -> None:
    if odd := sorted(set(given) - set(names)):
        raise ValueError(f"{where}: unknown {', '.join(odd)}")


def parse(text: str, profile: str | None = None) -> dict:
    """All settings; with ``profile`` those of ``[profiles.<name>]`` on top: lists are added to, single values replaced.

    ValueError for unknown names, wrong types, durations that are none and profiles that are not there.
    """
    given = tomllib.loads(text)
    _known(given, [*DEFAULTS, *OTHER, "health", "notify", "profiles"], "settings")
    health = given.pop("health", {})
    _known(health, ["weights"], "health")
    out = {k: list(v) if isinstance(v, list) else v for k, v in DEFAULTS.items()}
    for name, value in given.items():
        if name in DEFAULTS:
            out[name] = _typed(name, value)
    for name, section in (("weights", health.get("weights", {})), ("notify", given.get("notify", {}))):
        _known(section, list(SECTIONS[name]), name)
        out[name] = SECTIONS[name] | section
    for rule in out["junk_rules"]:
        _known(rule, RULE, "junk_rules")
    if profile is not None:
        if profile not in given.get("profiles", {}):
            raise ValueError(f"no profile {profile}")
        own = given["profiles"][profile]
        _known(own, [*EXTENDS, *REPLACES, *PROFILE_ONLY], f"profile {profile}")
        for name in EXTENDS:
            out[name] += [x for x in dict.fromkeys(own.get(name, [])) if x not in out[name]]
        out |= {name: _typed(name, own[name]) for name in REPLACES if name in own} | {name: own[name] for name in PROFILE_ONLY if name in own}
    for name in ("old_after", "installer_min_age", "archive_older_than", "versions_min_age"):
        texts.parse_days(out[name])
    junk_categories(out)
    return out


def _typed(name: str, value: object) -> object:
    want = DEFAULTS[name]
    kind = str if want is None else type(want)
    if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
        raise ValueError(f"{name}: {value!r} is no {kind.__name__}")
    return value


def junk_categories(config: dict) -> list[junk.Category]:
    """The active categories of junk that the settings name."""
    own = [
        junk.Category(r["name"], tuple(r["patterns"]), tuple(r["dirs"]) if r.get("dirs") else None, texts.parse_days(r["min_age"]) if r.get("min_age") else None) for r in config["junk_rules"]
    ]
    return junk.categories(config["junk_categories"], config["downloads_dirs"], texts.parse_days(config["installer_min_age"]), own)


def fingerprint(config: dict, template: str | None = None) -> str:
    """Equal for settings that give comparable metrics: the order of plain sets and repeats in them don't matter, that of the categories of junk does."""
    unordered = lambda xs: sorted(set(xs))
    plain = {k: unordered(config[k]) for k in SETS} | {k: config[k] for k in ("no_default_excludes", "junk_categories", "old_after", "max_depth_warning", "huge_dir_entries")}
    rules = [{"name": r["name"], "patterns": unordered(r["patterns"]), "min_age": r.get("min_age"), "dirs": unordered(r.get("dirs", []))} for r in config["junk_rules"]]
    whole = plain | {"junk_rules": rules, "installer_min_age": texts.parse_days(config["installer_min_age"]), "weights": config["weights"], "template": template}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
