"""Checks of metadata, answers and ids (SF07, SF08, SF12, SF13, SF25-SF27)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .text import normalize_amount, word_count

#: Beginnings of titles that say nothing. After the first three anything may follow, after the others only digits.
PROGRAMS = ["microsoft word", "microsoft excel", "microsoft powerpoint"]
PLACEHOLDERS = ["untitled", "unbenannt", "dokument", "document", "präsentation", "presentation", "mappe", "arbeitsmappe", "folie", "slide", "scan", "img_", "image", "pdf"]
#: Endings of titles that are file names.
FILE_ENDINGS = [".doc", ".docx", ".pdf", ".xls", ".xlsx", ".ppt", ".pptx", ".tmp", ".indd"]
#: Sizes of screens, in either orientation.
SCREENS = [
    (1280, 720), (1280, 800), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1680, 1050), (1920, 1080), (1920, 1200), (2048, 1152),
    (2560, 1080), (2560, 1440), (2560, 1600), (2880, 1800), (3440, 1440), (3840, 2160),
    (750, 1334), (828, 1792), (1080, 1920), (1080, 2340), (1080, 2400), (1125, 2436), (1170, 2532), (1179, 2556), (1284, 2778), (1290, 2796), (1440, 3200),
]
#: Fixed value: beginnings of the names of screenshots.
SCREENSHOT = r"(?i)^(screenshot|bildschirmfoto|screen shot|bildschirmaufnahme)"
#: White space beyond ASCII, too.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FORBIDDEN = r'[\x00-\x1F\x7F-\x{9F}<>:"/\\|?*]'
ANSWER = "category string, confidence double, date string, amount string, sender string, number string, title string"


def is_junk_title(title: Column, file_name: Column) -> Column:
    """Empty, digits only, the file's name, a program's default, or a file name."""
    t, name = F.lower(F.regexp_replace(title, f"^{SPACE}+|{SPACE}+$", "")), F.lower(file_name)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    start = rf"^(?:(?:{'|'.join(PROGRAMS)})|(?:{'|'.join(PLACEHOLDERS)})[ _:-]*[0-9 ]*$)"
    end = rf"(?:{'|'.join(e.replace('.', '[.]') for e in FILE_ENDINGS)})$"
    return t.rlike(rf"^(?:[0-9]|{SPACE})*$") | (t == stem) | (t == name) | t.rlike(start) | t.rlike(end)


def clean_value(raw: Column) -> Column:
    """A value that may be part of a file's name: no forbidden or control characters, single spaces, no points at the end."""
    single = F.regexp_replace(F.regexp_replace(raw, _FORBIDDEN, " "), f"{SPACE}+", " ")
    return F.regexp_replace(F.regexp_replace(single, "^ ", ""), "[. ]+$", "")


def is_run_id(text: Column) -> Column:
    """``YYYYMMDD-HHMMSS-xxxx``, x a lower-case hexadecimal digit."""
    return text.rlike(r"\A[0-9]{8}-[0-9]{6}-[0-9a-f]{4}\z")


def rfc3339(ticks: Column) -> Column:
    """Ticks of 100 ns as a time with seconds, in the session's zone."""
    return F.date_format(F.timestamp_seconds(((ticks - F.pmod(ticks, F.lit(10_000_000))) / 10_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ssxxx")


def layer_usable(text: Column, pages: Column, total: int = 50, each: int = 20, most_pages: int = 30) -> Column:
    """Whether a document's text layer has enough words, in all or for a page that was read."""
    words = F.coalesce(word_count(text), F.lit(0))
    read = F.greatest(F.lit(1), F.least(F.coalesce(pages, F.lit(1)), F.lit(most_pages)))
    return (words >= total) | (F.floor(words / read) >= each)


def media_category(name: Column, ext: Column, meta: Column) -> Column:
    """struct(category, confidence, hit) of an image by its name and metadata (a map of strings), or null."""

    def found(category: str, confidence: float, hit: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(hit).alias("hit"))

    def side(key: str) -> Column:
        return F.when(meta[key].rlike("^[0-9]{1,9}$"), meta[key]).cast("int")

    camera = F.coalesce(meta["exif.camera"].isNotNull(), F.lit(False))
    width, height = side("img.width"), side("img.height")
    screen = F.concat_ws("x", F.greatest(width, height), F.least(width, height)).isin([f"{max(s)}x{min(s)}" for s in SCREENS])
    trimmed = F.regexp_replace(name, f"^{SPACE}+", "")
    by_size = (ext == "png") & ~camera & F.coalesce(width.isNotNull() & height.isNotNull() & screen, F.lit(False))
    return F.when(trimmed.rlike(SCREENSHOT), found("screenshot", 0.95, "name")).when(camera, found("foto", 0.95, "camera")).when(by_size, found("screenshot", 0.8, "screen"))


def by_text_or_media(text_category: Column, media: Column, text: Column, least_words: int = 25) -> Column:
    """The category by text wins against the one by metadata only with enough words."""
    enough = F.coalesce(word_count(text), F.lit(0)) >= least_words
    return F.when(text_category.isNotNull() & (enough | media.isNull()), text_category).otherwise(media["category"])


def checked_answer(answer: Column, categories: Iterable[str], today: str, max_confidence: float = 0.75) -> Column:
    """struct(category, confidence, date, amount, sender, number, title) of a model's JSON answer; what fails its check is null.

    Dates lie between 1990 and a year (366 days) after ``today``; an answer
    that is no JSON object has no values.
    """
    raw = F.from_json(answer, ANSWER)
    name = F.lower(F.regexp_replace(raw["category"], f"^{SPACE}+|{SPACE}+$", ""))
    known = F.coalesce(name.isin(sorted(categories)), F.lit(False))
    claimed = F.when(raw["confidence"].isNull() | F.isnan(raw["confidence"]) | (F.abs(raw["confidence"]) == float("inf")), max_confidence).otherwise(raw["confidence"])
    confidence = F.round(F.least(F.greatest(claimed, F.lit(0.0)), F.lit(1.0), F.lit(max_confidence)), 2)
    spelled = F.trim(raw["date"])
    day = F.when(spelled.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(spelled, "yyyy-M-d"))
    last = F.date_add(F.lit(today).cast("date"), 366)
    date = F.when((F.year(day) >= 1990) & (day <= last) & (F.year(day) <= F.year(F.lit(today).cast("date")) + 1), F.date_format(day, "yyyy-MM-dd"))

    def value(key: str, most: int, also: str = "") -> Column:
        v = clean_value(raw[key])
        return F.when((v != "") & (F.length(v) <= most) & v.rlike(also), v)

    return F.struct(
        F.when(known, name).alias("category"), F.when(known, confidence).alias("confidence"), date.alias("date"), normalize_amount(raw["amount"]).alias("amount"),
        value("sender", 80).alias("sender"), value("number", 40, "[0-9]").alias("number"), value("title", 120).alias("title"),
    )
