"""File names: categories, problems, normal forms (PR09-PR22, SF15)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Extensions of the eight categories.
CATEGORIES = {
    "Dokumente": "doc docx dot dotx odt rtf txt md pdf xls xlsx xlsm ods csv ppt pptx odp msg eml one vsd vsdx".split(),
    "Bilder": "jpg jpeg png gif bmp tif tiff webp heic svg ico raw cr2 nef psd".split(),
    "Video": "mp4 mkv avi mov wmv flv webm m4v mpg mpeg".split(),
    "Audio": "mp3 wav flac aac ogg m4a wma opus".split(),
    "Archive": "zip rar 7z tar gz bz2 xz iso cab tgz".split(),
    "Code": "rs py js ts tsx jsx java c h cpp hpp cs go rb php sql sh ps1 bat cmd html htm css json xml yaml yml toml sln csproj".split(),
    "Ausführbar": "exe msi dll sys com scr msix appx".split(),
}
OTHER = "Sonstige"
ALL_CATEGORIES = [*CATEGORIES, OTHER]
AGE_CLASSES = ["<30", "30-181", "182-364", "365-1094", ">=1095"]
#: The order of problems is part of the result.
PROBLEMS = ["path_too_long", "invalid_chars", "reserved_name", "leading_trailing_space", "trailing_dot", "zero_byte", "office_lock", "temp_file", "partial_download", "system_junk", "onedrive_conflict"]
JUNK_NAMES = r"(?i)^(thumbs\.db|ehthumbs\.db|\.ds_store|.*\.tmp|~\$.*|.*\.crdownload|.*\.part|.*\.partial)$"


def age_days(mtime: Column, now: int) -> Column:
    """Whole days, 0 for times ahead."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.lit(now) - mtime) / 864_000_000_000).cast("long"))


def age_class(days: Column) -> Column:
    return F.when(days < 30, AGE_CLASSES[0]).when(days < 182, AGE_CLASSES[1]).when(days < 365, AGE_CLASSES[2]).when(days < 1095, AGE_CLASSES[3]).otherwise(AGE_CLASSES[4])


def file_category(ext: Column) -> Column:
    out = None
    for name, exts in CATEGORIES.items():
        fits = F.lower(ext).isin(exts)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(OTHER)


def split_stem(name: Column) -> tuple[Column, Column]:
    """(stem, lower-case extension): the last dot counts if something is before it."""
    has = name.rlike(r"^.+\.[^.]*$")
    return F.when(has, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name), F.when(has, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise("")


def is_reserved(name: Column) -> Column:
    return F.rtrim(F.regexp_extract(name, r"^([^.]*)", 1)).rlike("(?i)^(con|prn|aux|nul|(com|lpt)[1-9])$")


def is_conflict(name: Column, hosts: list[str]) -> Column:
    """The stem ends in a host's name, or that and a number, with something before it."""
    stem, _ = split_stem(name)
    return stem.rlike("(?i)^.+-(" + "|".join(hosts) + ")(-[0-9]+)?$") if hosts else F.lit(False)


def name_problems(name: Column, path: Column) -> list[tuple[str, Column]]:
    return [
        ("path_too_long", F.length(path) > 260),
        ("invalid_chars", name.rlike(r'["*:<>?/|\\\x00-\x1f]')),
        ("reserved_name", is_reserved(name)),
        ("leading_trailing_space", name.rlike("^ | $")),
        ("trailing_dot", name.rlike(r"\.$")),
    ]


#: Keys of a file's problems in their fixed order.
FILE_PROBLEMS = [
    "path_too_long", "invalid_chars", "reserved_name", "leading_trailing_space", "trailing_dot", "zero_byte", "office_lock", "temp_file",
    "partial_download", "system_junk", "onedrive_conflict",
]


def file_problems(name: Column, path: Column, size: Column, hosts: list[str]) -> Column:
    """Array of problem keys in their fixed order."""
    checks = [
        *name_problems(name, path),
        ("zero_byte", size == 0),
        ("office_lock", F.startswith(name, F.lit("~$"))),
        ("temp_file", name.rlike(r"(?i)\.(tmp|temp)$")),
        ("partial_download", name.rlike(r"(?i)\.(crdownload|part|partial)$")),
        ("system_junk", F.lower(name).isin("thumbs.db", "ehthumbs.db", "desktop.ini", ".ds_store")),
        ("onedrive_conflict", is_conflict(name, hosts)),
    ]
    return F.filter(F.array(*(F.when(c, k) for k, c in checks)), lambda x: x.isNotNull())


def dir_problems(name: Column, path: Column) -> Column:
    return F.filter(F.array(*(F.when(c, k) for k, c in name_problems(name, path))), lambda x: x.isNotNull())


# What copies and versions of a name differ in.
_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
_COPIES = r"((\s?-\s?|\s)(kopie|copy)(\s?\([0-9]+\))?|\s?\([0-9]+\))+$"
_TOKEN = r"(^|[\s-])(v[0-9]+|version\s*[0-9]+|rev\s*[0-9]+|final|endgültig|neu|new|alt|old)($|[\s-])"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _until_stable(text: Column, pattern: str, step) -> Column:
    """``step`` applied until it changes nothing: texts without the pattern need none, each useful step takes a character at least."""
    loop = lambda t: F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), t, lambda s, _: F.when(s.rlike(pattern), step(s)).otherwise(s))
    return _let(text, lambda t: F.when(t.rlike(pattern), loop(t)).otherwise(t))


def normalize_name(stem: Column) -> Column:
    """The form that copies and versions of a name have in common."""
    dates = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, rf"^{_DATE}([\s-]+|$)", ""), rf"(^|[\s-]+){_DATE}$", ""))

    def normal(original: Column) -> Column:
        # runs of white space are one space in the end, so they can be so from the start
        out = dates(F.regexp_replace(F.replace(original, F.lit("_"), F.lit(" ")), r"\s+", " "))
        out = F.regexp_replace(out, "^(copy of|kopie von) ", "")
        out = F.trim(F.regexp_replace(out, _COPIES, ""))
        # versions share separators, and one that goes can leave the parts of another side by side
        out = _until_stable(out, _TOKEN, lambda s: F.trim(F.regexp_replace(s, _TOKEN, " ")))
        out = F.trim(F.regexp_replace(dates(out), r"[\s-]+", " "))
        return _let(out, lambda o: F.when(o == "", original).otherwise(o))

    return _let(F.lower(F.trim(stem)), normal)


def copy_name_score(name: Column, extra: list[str] | None = None) -> Column:
    """2 for each strong word, 1 for each weak word, 1 for a number in parentheses at the end, 2 for each of the user's words."""
    words = F.split(F.lower(name), r"[^\p{L}\p{N}]+")
    strong = F.size(F.filter(words, lambda w: w.isin("kopie", "copy", "backup", "sicherung"))) * 2
    weak = F.size(F.filter(words, lambda w: w.isin("alt", "old", "bak")))
    score = strong + weak + F.when(F.trim(name).rlike(r"\([0-9]+\)$"), 1).otherwise(0)
    for word in extra or ():
        score = score + F.when(F.contains(F.lower(name), F.lit(word.lower())), 2).otherwise(0)
    return score.cast("long")


# Endings that copies get.
_COPY_END = r"(?i)(\s*-\s*(kopie|copy)(\s*\([0-9]+\))?|\s+\([0-9]+\)|_final(_v[0-9]+)?)$"
_UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss", "ẞ": "SS"}
#: A name is cleaned at most so often (part of the definition).
TIDY_PASSES = 8


def tidy_name(name: Column, copies: bool = True, umlauts: bool = True, spaces: str | None = "_", lower_ext: bool = True, date: Column | None = None) -> Column:
    """File-name clean-up of rules: copy suffixes go (unless nothing is left), umlauts are written out, white space becomes
    ``spaces``, ``date`` (``yyyy-MM-dd``) stands before names that start with none, the extension is lower-case; repeated
    until nothing changes."""

    def cleaned(n: Column) -> Column:
        has = n.rlike(r"(?s)^.+\.[^.]*$")
        stem, ext = F.when(has, F.regexp_extract(n, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(n), F.regexp_extract(n, r"(?s)^.+(\.[^.]*)$", 1)
        if copies:
            bare = _until_stable(stem, _COPY_END, lambda s: F.rtrim(F.regexp_replace(s, _COPY_END, "")))
            stem = F.when(bare == "", stem).otherwise(bare)
        if umlauts:
            for a, b in _UMLAUTS.items():
                stem = F.replace(stem, F.lit(a), F.lit(b))
        if spaces is not None:
            stem = F.regexp_replace(stem, r"\s+", spaces)
        if date is not None:
            stem = F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), stem).otherwise(F.concat(date, F.lit("_"), stem))
        return F.concat(stem, F.lower(ext) if lower_ext else ext)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TIDY_PASSES)), name, lambda n, _: cleaned(n))
