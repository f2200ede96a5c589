"""Text of documents: cleaning, fields, classification (SF01-SF13, JN13)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

_UNITS = {"d": 1, "m": 30, "y": 365}
_SIZES = {"": 1, "b": 1, "kb": 1000, "mb": 1000**2, "gb": 1000**3, "tb": 1000**4, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def parse_days(text: str) -> int:
    """``90d``, ``6m`` or ``2y`` in days; above zero."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([dmy])\s*", text.lower())
    if not m or not int(m[1]):
        raise ValueError(f"no duration: {text}")
    return int(m[1]) * _UNITS[m[2]]


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in _SIZES:
        raise ValueError(f"no size: {text}")
    return int(float(m[1]) * _SIZES[m[2]])


def clean(text: Column, most: int = 200_000) -> Column:
    """Words cut at line ends joined, soft hyphens gone, white space one space, at most so many characters (a limit of the operator)."""
    out = F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), r"(\p{L})-[ \t\r]*\n\s*(\p{Ll})", "$1$2")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def fold(text: Column) -> Column:
    return F.lower(text)


def expand_umlauts(text: Column) -> Column:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


_MONTHS = {
    "januar": 1, "january": 1, "jan": 1, "februar": 2, "february": 2, "feb": 2, "märz": 3, "maerz": 3, "march": 3, "mär": 3, "mar": 3, "april": 4, "apr": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "oktober": 10, "october": 10, "okt": 10, "oct": 10, "november": 11, "nov": 11, "dezember": 12, "december": 12, "dez": 12, "dec": 12,
}
_MONTH = "|".join(_MONTHS)
#: Forms of a date and their groups of year, month and day; after a label tried in this order.
_DATES = [
    (r"([0-9]{1,2})\.\s?([0-9]{1,2})\.\s?([0-9]{4}|[0-9]{2})\b", (3, 2, 1)),
    (r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b", (1, 2, 3)),
    (rf"\b([0-9]{{1,2}})\.?\s+({_MONTH})\.?\s+([0-9]{{4}})\b", (3, 2, 1)),
    (rf"\b({_MONTH})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+([0-9]{{4}})\b", (3, 1, 2)),
]
_DATE_LABEL = r"(?:^|[^\p{L}])(?:rechnungsdatum|rechnungs-datum|belegdatum|buchungsdatum|invoice date|ausstellungsdatum|ausgestellt am|datum|date|vom)\s*[:.]?\s*"
_FLAGS = "(?iuU)"  # letters, spaces and ends of words as Unicode has them


def _date(raw: Column, form: int) -> Column:
    """The date that ``raw``, which starts with this form, says; null if there is none."""
    pattern, groups = _DATES[form]
    year, month, day = (F.regexp_extract(raw, f"{_FLAGS}^(?:{pattern})", g) for g in groups)
    names_ = F.create_map(*(F.lit(x) for pair in _MONTHS.items() for x in pair))
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    month = F.coalesce(F.try_element_at(names_, F.lower(month)).cast("string"), month)
    return F.try_to_date(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def find_date(text: Column, today: Column | None = None) -> Column:
    """A plausible date as ISO text: the first right after a label, else one without.

    Forms are 5.3.24 and 05.03.2024, 2024-03-05, 5. März 2024 and March 5th,
    2024. Plausible is from 1990 to 366 days after ``today`` and at most in its
    next year. Without a label only the first date of each form counts, ISO
    first, as in the query's SQL.
    """
    today = F.current_date() if today is None else today
    plausible = lambda x: F.when((F.year(x) >= 1990) & (F.year(x) <= F.year(today) + 1) & (x <= F.date_add(today, 366)), x)
    forms = [re.sub(r"\((?!\?)", "(?:", p) for p, _ in _DATES]
    # the first form that a text starts with decides
    starts = lambda x: F.coalesce(*(F.when(x.rlike(f"{_FLAGS}^(?:{p})"), F.struct(_date(x, i).alias("d"))) for i, (p, _) in enumerate(_DATES)))["d"]
    after = "|".join(p.removeprefix(r"\b") for p in forms)
    labelled = F.transform(F.regexp_extract_all(text, F.lit(f"{_FLAGS}{_DATE_LABEL}({after})"), F.lit(1)), lambda x: plausible(starts(x)))
    plain = [_date(F.regexp_extract(text, f"{_FLAGS}({forms[i]})", 1), i) for i in (1, 0, 2, 3)]
    return F.date_format(F.coalesce(F.try_element_at(F.filter(labelled, lambda x: x.isNotNull()), F.lit(1)), plausible(F.coalesce(*plain))), "yyyy-MM-dd")


def normalize_amount(raw: Column) -> Column:
    """``1.234,56`` and ``1,234.56`` as ``1234,56``; null without two decimals or with more than nine digits before them."""
    cents = F.regexp_extract(raw, r"[.,]([0-9]{2})$", 1)
    whole = F.regexp_replace(F.regexp_replace(raw, r"[.,][0-9]{2}$", ""), "[^0-9]", "")
    sign = F.when(F.startswith(raw, F.lit("-")), "-").otherwise("")
    return F.when((cents != "") & F.length(whole).between(1, 9), F.concat(sign, F.regexp_replace(whole, "^0+(?=[0-9])", ""), F.lit(","), cents))


#: Labels by tier, the strongest first.
_AMOUNTS = ["gesamtbetrag|endbetrag|rechnungsbetrag|zahlbetrag|gesamtsumme|amount due|total amount|zu zahlen", "summe|total|gesamt|betrag|amount"]
_NUMBERS = [
    r"rechnungs-?\s?nr\.?|rechnungsnummer|invoice\s*(?:no\.?|number|#)", r"vertrags-?\s?nr\.?|vertragsnummer|contract\s*(?:no\.?|number)",
    r"kunden-?\s?nr\.?|kundennummer|customer\s*(?:no\.?|number)", r"nr\.?",
]


def find_amount(text: Column) -> Column:
    """The last amount after a label of the strongest tier that has one."""
    number = r"(-?[0-9]{1,3}(?:[., ][0-9]{3})*[,.][0-9]{2}|-?[0-9]+[,.][0-9]{2})"
    def last(labels: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"{_FLAGS}(?:^|[^\p{{L}}])(?:{labels})\s*(?:\((?:brutto|inkl\.?[^)]*)\))?\s*:?\s*(?:eur|€|\$)?\s*{number}"), F.lit(1))
        return F.try_element_at(F.filter(F.transform(found, normalize_amount), lambda x: x.isNotNull()), F.lit(-1))

    return F.coalesce(*(last(x) for x in _AMOUNTS))


def find_number(text: Column) -> Column:
    """The first labelled number of three and more characters with a digit: of an invoice, a contract, a customer, else after a mere ``Nr``."""
    def first(labels: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"{_FLAGS}(?:^|[^\p{{L}}])(?:{labels})\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9/_\-.]{{2,30}})"), F.lit(1))
        cut = F.transform(found, lambda x: F.regexp_replace(x, r"[.\-/_]+$", ""))
        return F.try_element_at(F.filter(cut, lambda x: x.rlike("[0-9]") & (F.length(x) >= 3)), F.lit(1))

    return F.coalesce(*(first(x) for x in _NUMBERS))


def find_sender(text: Column, senders: list[str]) -> Column:
    """The known sender that comes first in the text; of several at one place the first listed."""
    places = [F.struct(F.when(F.locate(s.lower(), F.lower(text)) > 0, F.locate(s.lower(), F.lower(text))).otherwise(1 << 30).alias("p"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(senders)]
    best = F.array_min(F.array(*places))
    return F.when(best["p"] < 1 << 30, best["s"])


def shorten(text: Column, most: int) -> Column:
    """Cut at a word's end, if one keeps 40 % of ``most``; no points or spaces at the end of what was cut."""
    cut = F.substring(text, 1, most)
    at = F.length(F.regexp_extract(cut, r"(?s)^(.*) ", 1))
    whole = F.substring(text, most + 1, 1).rlike(r"\s") | (at * 10 < most * 4)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.when(whole, cut).otherwise(F.substr(cut, F.lit(1), at)), "[. ]+$", ""))


def classify(texts: DataFrame, keywords: DataFrame, least: int = 3) -> DataFrame:
    """``id, category, score, confidence, category2, confidence2``.

    ``texts`` is (id, text), ``keywords`` (category, keyword of one word,
    weight). A keyword counts once for a document. Tokens are joined by word
    after they became distinct in their document.
    """
    words = texts.select("id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("keyword"))
    hits = words.join(keywords, "keyword").groupBy("id", "category").agg(F.sum("weight").alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "category"))
    ranked = hits.withColumn("_r", rank).where("_r <= 2")
    best = ranked.where("_r = 1").select("id", "category", "score")
    second = ranked.where("_r = 2").select("id", F.col("category").alias("category2"), F.col("score").alias("score2"))
    out = texts.select("id").join(best, "id", "left").join(second, "id", "left")
    s, t = F.col("score").cast("double"), F.coalesce("score2", F.lit(0)).cast("double")
    strength = lambda x: F.least(F.lit(1.0), x / 8)
    return out.select(
        "id", "category", F.col("score").cast("long").alias("score"), F.round(strength(s) * (1 - F.pow(t / s, 2)), 2).alias("confidence"),
        "category2", F.when(F.col("category2").isNotNull(), F.round(strength(t) * t / s, 2)).alias("confidence2"),
    )


def content_summary(found: DataFrame, least: float = 0.8) -> DataFrame:
    """Of each category: documents, their share of all, and how many are too uncertain."""
    total = found.agg(F.count("*").alias("_all"))
    grouped = found.groupBy(F.coalesce("category", F.lit("(keine)")).alias("category")).agg(F.count("*").alias("documents"), F.count_if(F.col("confidence") < least).alias("review"))
    return grouped.join(total).select("category", "documents", F.round(F.col("documents") / F.col("_all"), 6).alias("share"), "review")
