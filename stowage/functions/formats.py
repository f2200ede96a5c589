"""Texts for people and times of runs (SF18, SF21, SF24, WN11, PR17)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def delta_text(delta: Column) -> Column:
    """``±0``, ``+3``, ``−3``."""
    number = F.abs(delta).cast("string")
    return F.when(delta == 0, "±0").when(delta > 0, F.concat(F.lit("+"), number)).otherwise(F.concat(F.lit("−"), number))


def score_line(score: Column, delta: Column, since: Column, limited: Column) -> Column:
    """The score and, if ``delta`` is not null, how it changed since a time."""
    head = F.concat(F.lit("Health-Score "), score.cast("string"))
    more = F.concat(F.lit(" ("), delta_text(delta), F.lit(" seit "), F.date_format(since, "dd.MM."), F.when(limited, ", eingeschränkt vergleichbar").otherwise(""), F.lit(")"))
    return F.concat(head, F.when(delta.isNull(), " (erster Lauf)").otherwise(more))


def relative_time(now: Column, when: Column) -> Column:
    """How long ago, in words up to six days, then the date; the date also for times more than a minute ahead."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(when)
    days, clock, date = F.date_diff(now, when), F.date_format(when, "HH:mm"), F.date_format(when, "dd.MM.yyyy")
    return (
        F.when(seconds < -60, date)
        .when(seconds < 60, "gerade eben")
        .when(seconds < 3600, F.concat(F.lit("vor "), F.floor(seconds / 60).cast("string"), F.lit(" Min.")))
        .when(days == 0, F.concat(F.lit("heute "), clock))
        .when(days == 1, F.concat(F.lit("gestern "), clock))
        .when(days <= 6, F.concat(F.lit("vor "), days.cast("string"), F.lit(" Tagen")))
        .otherwise(date)
    )


def next_run(now: Column, clock: Column, day: Column) -> Column:
    """The next run at ``clock`` (``HH:mm``), on ``day`` (0 Monday to 6, null: every day); one at ``now`` itself counts."""
    at = lambda days: F.to_timestamp(F.concat(F.date_format(F.date_add(F.to_date(now), days), "yyyy-MM-dd "), clock, F.lit(":00")))
    ahead = F.coalesce(F.pmod(day - F.weekday(now), F.lit(7)), F.lit(0)).cast("int")
    period = F.when(day.isNull(), 1).otherwise(7).cast("int")
    return F.when(at(ahead) >= now, at(ahead)).otherwise(at(ahead + period))


def first_or_null(found: Column) -> Column:
    """The first of an array of problems, null if there is none (PR17)."""
    return F.get(found, F.lit(0))


def fields_json(fields: Column) -> Column:
    """A map of fields as JSON with its keys in order, ``{}`` for none."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,string>"))))))


def fields_from_json(text: Column) -> Column:
    """What ``fields_json`` wrote; empty for null and for what is no JSON object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def quarantine_target(path: Column, root: str, run: str) -> Column:
    """Where a file of a run's quarantine lies: its path below the root is kept; null outside the root and with ``..`` in it."""
    rest = F.substr(path, F.lit(len(root) + 1))
    fits = F.startswith(F.lower(path), F.lit(root.lower())) & (rest != "") & ~rest.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(fits, F.concat(F.lit(f"{root}.quarantine/{run}/"), rest))
