"""Scalar functions and rules on small tables."""

import pytest
from pyspark.sql import functions as F

from stowage.functions import names, paths, text
from stowage.plans import planners, rules


def values(spark, column, *rows):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in frame.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_paths(spark):
    assert values(spark, paths.path_key, r"\\?\C:\A\b\\", "c:\\", "/x//Y/") == ["C:/a/b", "C:/", "/x/y"]
    assert values(spark, lambda x: paths.is_under(x, F.lit("/c/a/")), "/c/a", "/c/a/b", "/c/ab") == [True, True, False]
    assert values(spark, lambda x: F.array_join(paths.ancestors(x, "/c/"), " "), "/c/", "/c/a/b/") == ["/c/", "/c/ /c/a/ /c/a/b/"]


@pytest.mark.parametrize(
    ("name", "normal"),
    [("Report_v2", "report"), ("report - kopie (3)", "report"), ("2024-03-01 report final", "report"), ("copy of report", "report"), ("v1 final", "v1 final"), ("Report (2) (3)", "report"), ("old new plan", "plan")],
)
def test_normal_form(spark, name, normal):
    assert values(spark, names.normalize_name, name) == [normal]
    assert values(spark, names.normalize_name, normal) == [normal]


def test_problems(spark):
    check = lambda x: F.array_join(names.file_problems(x, x, F.lit(1), ["laptop"]), " ")
    assert values(spark, check, "CON.txt", " a", "b.", "~$c", "d.tmp", "e.part", "Thumbs.db", "f-laptop-2.doc", "ok.txt", "x" * 261) == [
        "reserved_name", "leading_trailing_space", "trailing_dot", "office_lock", "temp_file", "partial_download", "system_junk", "onedrive_conflict", "", "path_too_long",
    ]


def test_tidy_is_idempotent(spark):
    made = values(spark, names.tidy_name, "Bär  Übersicht - Kopie (2).PDF", "a - copy (1) (2).txt", "x", "plan final.txt", "b_copy.txt", " (2)", "y_final_v2 (3) - Kopie", ".env")
    # the separator of a copy's suffix is a hyphen; a name is never emptied
    assert made == ["Baer_Uebersicht.pdf", "a.txt", "x", "plan.txt", "b_copy.txt", "_(2)", "y", ".env"] and values(spark, names.tidy_name, *made) == made
    dated = lambda n: names.tidy_name(n, spaces=None, date=F.lit("2024-05-01"))
    assert values(spark, dated, "a b.txt", "2020-01-02 c.txt") == ["2024-05-01_a b.txt", "2020-01-02 c.txt"]


def test_normal_form_is_a_fixpoint(spark):
    """Against the definition, loop by loop: parts of versions that only meet once others are gone, any number of suffixes."""
    import random
    import re

    date = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"

    def dates(s):
        return re.sub(rf"(?:^|[\s-]+){date}$", "", re.sub(rf"^{date}(?:[\s-]+|$)", "", s, count=1), count=1).strip()

    def until(s, step):
        while (after := step(s)) != s:
            s = after
        return s

    def brute(stem):
        original = stem.strip().lower()
        s = re.sub(r"^(?:copy of|kopie von)\s+", "", dates(original.replace("_", " ")))
        s = until(s, lambda x: re.sub(r"\s*\([0-9]+\)$", "", re.sub(r"(?:\s*-\s*|\s+)(?:kopie|copy)(?:\s*\([0-9]+\))?$", "", x)).strip())
        s = until(s, lambda x: re.sub(r"(?:^|[\s-])(?:v[0-9]+|version\s*[0-9]+|rev\s*[0-9]+|final|endgültig|neu|new|alt|old)(?:$|[\s-])", " ", x, count=1).strip())
        return " ".join(p for p in re.split(r"[\s-]+", dates(s)) if p) or original

    rng = random.Random(7)
    words = ["plan", "v1", "version", "rev", "2", "final", "old", "kopie", "copy", "(3)", "copy of", "2024-03-01", "20240301", "-", "Neu"]
    stems = ["version " * 9 + "1 " * 9 + "x", "a" + " (1)" * 12, "b" + " - kopie" * 7 + " copy (2) (3)"]
    stems += ["".join(w + rng.choice([" ", "_", "-", "  ", ""]) for w in rng.choices(words, k=rng.randint(1, 9))).strip() or "x" for _ in range(600)]
    assert values(spark, names.normalize_name, *stems) == [brute(s) for s in stems]


def test_junk_categories(spark):
    from stowage.functions import junk

    day = 864_000_000_000
    rows = [("setup.EXE", "/c/dl/", 0), ("setup.exe", "/c/dl/sub/", 0), ("new.msi", "/c/dl/", 950 * day), ("a.bak", "/c/x/", 0), ("a.tmp", "/c/x/", 999 * day), ("x.tmp.exe", "/c/dl/", 0), ("tmp", "/c/dl/", 0)]
    files = spark.createDataFrame([(d + n, n, d, m) for n, d, m in rows], "path string, name string, dir_key string, mtime long").withColumns({"cloud_only": F.lit(False), "is_link": F.lit(False)})
    own = [junk.Category("mine", ("*.bak", "*.exe"), dirs=("/c/x/",))]
    plan = planners.plan_junk(files, 1000 * day, active=junk.categories(["installer", "mine", "temp"], ["/C/dl/"], 90, own))
    assert {(r.path, r.reason) for r in plan.collect()} == {("/c/dl/setup.EXE", "junk:installer"), ("/c/dl/new.msi", "too-recent"), ("/c/x/a.bak", "junk:mine"), ("/c/x/a.tmp", "junk:temp"), ("/c/dl/x.tmp.exe", "junk:installer")}
    with pytest.raises(ValueError):
        junk.categories(["other"])


def test_durations_and_sizes():
    assert [text.parse_days(x) for x in ("3d", "2m", "1y")] == [3, 60, 365]
    assert [text.parse_size(x) for x in ("10", "2kb", "1.5MiB")] == [10, 2000, 1572864]
    for bad in ("0d", "3w", "x"):
        with pytest.raises(ValueError):
            text.parse_days(bad)


def test_partial_tree_pairs(spark):
    from stowage.operators import tree

    def pairs(*rows):
        files = spark.createDataFrame([(p.rsplit("/", 1)[0] + "/", p.rsplit("/", 1)[1], p, size, h) for p, size, h in rows], "dir_key string, name string, path_key string, size long, full_hash string").selectExpr("*", "false is_link", "false cloud_only")
        none = spark.createDataFrame([], "dir_key string, fingerprint string")
        return sorted(tuple(r) for r in tree.partial_tree_pairs(files, none, "/c/").collect())

    # shared below three folders, of which each alone is no pair at the threshold, but the trees are
    small = [(f"/c/{t}/{s}/{i}", 10, f"{s}{i}" if i else f"{t}{s}") for t in "ab" for s in "xyz" for i in range(4)]
    whole = [(f"/c/{t}/big", 400, "big") for t in "ab"]
    assert pairs(*small) == []
    assert pairs(*small, *whole) == [("/c/a/", "/c/b/", 490, 520, 520, 0.942308)]
    # one small shared file, much more below that is not shared
    assert pairs(("/c/a/f", 5, "f"), ("/c/b/f", 5, "f"), ("/c/a/s/g", 900, "g"), ("/c/b/s/h", 900, "h")) == []
    # the topmost only; a folder and one inside it make no pair; nor the tool's folder; copies count once on the smaller side
    assert pairs(("/c/a/s/t/f", 5, "f"), ("/c/b/s/t/f", 5, "f")) == [("/c/a/", "/c/b/", 5, 5, 5, 1.0)]
    assert pairs(("/c/a/f", 5, "f"), ("/c/a/s/f", 5, "f"), ("/c/.quarantine/f", 5, "f")) == []
    assert pairs(("/c/a/f", 5, "f"), ("/c/a/f2", 5, "f"), ("/c/b/f", 5, "f")) == [("/c/a/", "/c/b/", 5, 10, 5, 1.0)]
    assert pairs(*[(f"/c/{i}/f", 5, "f") for i in range(33)]) == []


def test_fields(spark):
    assert values(spark, text.find_date, "12.03.1980 Datum: 05.11.2021", "on 2024-02-31 or 1999-01-02", "none") == ["2021-11-05", None, None]
    assert values(spark, text.find_amount, "Summe: 1.234,56 Total: 7.50", "Total: x") == ["7,50", None]
    assert values(spark, text.find_number, "Nr: abc Nr: RE-12") == ["RE-12"]
    assert values(spark, lambda x: text.shorten(x, 10), "one two three", "abcdefghijkl") == ["one two", "abcdefghij"]


def test_all_forms_and_tiers_of_fields(spark):
    dates = {
        "Rechnungsdatum: 30.09.2025": "2025-09-30", "Rechnungsdatum 30. 09. 2025 Seite 1": "2025-09-30", "Invoice Date: 12 March 2024": "2024-03-12", "Date: March 3rd, 2024": "2024-03-03",
        "Berlin, den 1. Juli 2023": "2023-07-01", "Rechnung vom 03.02.25": "2025-02-03", "on 5.3.2024": "2024-03-05", "Stand: 7. Okt. 2025": "2025-10-07", "M\u00c4RZ 4, 2022": "2022-03-04",
        "Geboren 12.05.1950, Rechnungsdatum 01.02.2025": "2025-02-01", "Datum: 31.02.2025 vom 1.3.2025": "2025-03-01", "zu neu 01.01.2034": None, "Datum: 12.05.2027": "2027-05-12", "Datum: 02.01.2028": None,
    }
    assert values(spark, lambda x: text.find_date(x, F.lit("2026-10-04").cast("date")), *dates) == list(dates.values())
    amounts = {
        "Rechnungsbetrag: 119,00": "119,00", "Gesamtbetrag 119,00": "119,00", "Total: EUR 5,00": "5,00", "Gesamtbetrag 35,50 Summe 10,00": "35,50", "Zwischensumme 10,00 Summe 20,00": "20,00",
        "Rechnungsbetrag (brutto): 119,00 EUR": "119,00", "Gesamtbetrag: -12,30": "-12,30", "Gesamtbetrag: 1 234,56 \u20ac": "1234,56", "Total: $1,234.56": "1234,56", "Gesamtbetrag: 12 EUR": None,
    }
    assert values(spark, text.find_amount, *amounts) == list(amounts.values())
    numbers = {
        "Kundennummer: 4400123 Rechnungsnummer: R-99-1": "R-99-1", "Rechnungs-Nr.: 2026/0042.": "2026/0042", "Invoice #12345": "12345", "Vertragsnummer 88-1234-5": "88-1234-5", "Nr. 777 Kunden-Nr. 123": "123",
        "Rechnungsnummer: abc": None,
    }
    assert values(spark, text.find_number, *numbers) == list(numbers.values())


def test_globs(spark):
    assert values(spark, lambda x: x.rlike(rules.glob_regex("**/*.jpg")), "a.JPG", "x/y/a.jpg", "a.jpg/b") == [True, True, False]
    assert values(spark, lambda x: x.rlike(rules.glob_regex("x/*.txt")), "x/a.txt", "x/y/a.txt") == [True, False]


@pytest.mark.parametrize("bad", ['[[rule]]\nname="a"', '[[rule]]\ntarget="{2}"\nname_regex="(x)"', '[[rule]]\ntarget="{what}"', '[[rule]]\ntarget="x"\nodd=1', '[[rule]]\nname="a"\ntarget="x"\n[[rule]]\nname="a"\ntarget="x"'])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        rules.parse(bad)


def test_second_plan_is_empty(spark, sf_dir):
    """After the files of a plan are gone, planning again finds nothing."""
    from stowage.sources import bindings

    files = bindings.files(spark, sf_dir)
    plan = planners.plan_dedupe(files)
    left = files.join(plan.where("action = 'quarantine'").select("path"), "path", "left_anti")
    assert plan.where("action = 'quarantine'").count() and planners.plan_dedupe(left).where("action = 'quarantine'").count() == 0
    junk = planners.plan_junk(files, bindings.NOW)
    left = files.join(junk.where("action = 'quarantine'").select("path"), "path", "left_anti")
    assert planners.plan_junk(left, bindings.NOW).where("action = 'quarantine'").count() == 0


def test_validate_finds_what_is_wrong(spark):
    rows = [("/c/a/x", "move", "/c/b", "r"), ("/d/x", "move", "/c/B", "r"), ("/c/../x", "move", "/c/a/x", "r"), ("/c/a/", "move", "/c/q/", "r")]
    plan = spark.createDataFrame(rows, "path string, action string, target string, reason string")
    assert {r.rule for r in planners.validate(plan, "/c/").collect()} == {"outside", "dots", "same target", "target is a source", "inside a moved folder", "target inside a moved folder"}


def test_checks(spark):
    from stowage.functions import checks

    assert values(spark, checks.is_run_id, "20240101-120000-00af", "20240101-120000-00AF", "20240101-120000-00af\n", "x") == [True, False, False, False]
    assert values(spark, checks.clean_value, " a:b\u00a0 c. .", "...", "\x85x") == ["a b c", "", "x"]
    assert values(spark, lambda x: checks.rfc3339(x.cast("long")), "17172000000000000", "-1") == ["2024-06-01T00:00:00+00:00", "1969-12-31T23:59:59+00:00"]
    assert values(spark, lambda x: checks.is_junk_title(x, F.lit("Plan.v2.pdf")), "plan.v2", "PLAN.V2.PDF", "Scan_12", "scanner", "Microsoft Word x", "12 3", "") == [True, True, True, False, True, True, True]
    assert values(spark, lambda x: checks.layer_usable(x, F.lit(3)), "w " * 50, "w " * 49) == [True, False]
    assert values(spark, lambda x: checks.layer_usable(x, F.lit(None).cast("int")), "w " * 20, "w " * 19) == [True, False]
    answer = values(spark, lambda x: checks.checked_answer(x, ["a"], "2024-06-01"), '{"category":"A","confidence":-3,"title":"' + "t" * 121 + '","date":"2025-6-2","sender":"?"}')[0]
    assert answer.asDict() == {"category": "a", "confidence": 0.0, "date": "2025-06-02", "amount": None, "sender": None, "number": None, "title": None}


def test_conditions_on_content(spark):
    text_ = """
[[rules]]
name = "bills"
ext = ["pdf"]
category = "Rechnung"
category_source = "rules"
fields = { "doc.sender" = "ACME" }
fields_regex = { "doc.number" = "^RE-[0-9]+$" }
min_dwell = "3d"
target = "Bills/"

[[rules]]
name = "photos"
ext = ["jpg"]
target = "Fotos/{exif.date:%Y}/{exif.date:%Y-%m-%d}_{name}"

[[rules]]
name = "dated"
ext = ["png"]
target = "Fotos/{exif.date:%Y}/"
exif_fallback = "skip"

[[rules]]
name = "letters"
ext = ["txt", "pdf"]
text_regex = "(?i)dear"
target = "Letters/"
"""
    day = 864_000_000_000
    now = 20_000 * day
    schema = "name string, category string, source string, confidence double, number string, first_seen long, text string, taken timestamp"
    rows = [
        ("a.pdf", "rechnung", "rules", 0.9, "RE-1", None, None, None),
        ("b.pdf", "rechnung", "llm", 0.9, "RE-1", None, "Dear X", None),
        ("c.pdf", "rechnung", "rules", 0.5, "RE-1", now, None, None),
        ("d.pdf", "rechnung", "rules", 0.9, "RE-1", now, None, None),
        ("e.pdf", "rechnung", "rules", 0.9, "7", None, None, None),
        ("f.pdf", None, None, None, None, None, "dear", None),
        ("g.txt", None, None, None, None, None, "dear", None),
        ("h.txt", None, None, None, None, None, None, None),
        ("i.jpg", None, None, None, None, None, None, None),
        ("j.png", None, None, None, None, None, None, None),
    ]
    files = spark.createDataFrame(rows, schema).selectExpr(
        "*", "'/c/' || name AS path", "'/c/' || name AS path_key", "'/c/' AS dir_key", "substring_index(name, '.', -1) AS ext", "1L AS size", f"{now - 10 * day}L AS mtime", "false AS is_link",
        "false AS cloud_only", "unhex('00') AS full_hash", "CASE WHEN number IS NOT NULL THEN map('doc.sender', 'Acme', 'doc.number', number) END AS fields",
    )
    made = rules.parse(text_)
    got = {r.name: (r.rule, r.near) for r in rules.match(files, made, now, "/c/").collect()}
    assert got == {
        "a.pdf": ("bills", None), "b.pdf": ("letters", None), "c.pdf": ("bills", "low-confidence"), "d.pdf": ("bills", "too-recent-arrival"), "e.pdf": (None, None),
        "f.pdf": ("bills", "not-classified"), "g.txt": ("letters", None), "h.txt": (None, None), "i.jpg": ("photos", None), "j.png": ("dated", None),
    }
    known = files.withColumn("classified", F.lit(True))
    assert {r.name for r in rules.match(known, made, now, "/c/").where("near = 'not-classified'").collect()} == set()
    plan = {r.path: (r.action, r.target, r.reason) for r in rules.plan_rules(files, made, now, "/c/").collect()}
    assert plan["/c/i.jpg"][1] == "/c/Fotos/2024/2024-09-24_i.jpg" and plan["/c/j.png"] == ("skip", None, "missing-field")
    assert plan["/c/d.pdf"] == ("skip", None, "too-recent-arrival")


def _walked(rows, taken_files, folders, wanted):
    """Targets by trying one number after the other; rows are (path, size, hash), in the order of their keys."""
    import re

    taken = {p.lower(): (size, full) for p, size, full in taken_files} | {p.lower(): None for p in folders}
    out = {}
    for path, size, full in sorted(rows, key=lambda r: r[0].lower()):
        if path not in wanted:
            continue
        stem, ext = re.match(r"^(.*/[^/]+?)(\.[^./]*)?$", wanted[path]).groups(default="")
        out[path] = ("invalid-target", None)
        for n in range(1, 1001):
            target = wanted[path] if n == 1 else f"{stem} ({n}){ext}"
            if len(target) > 260:
                out[path] = ("path-too-long", None)
            elif target.lower() == path.lower():
                out[path] = ("already-there", None) if target == path else ("rule:r", target)
            elif target.lower() not in taken:
                taken[target.lower()] = ("assigned", None)
                out[path] = ("rule:r", target)
            elif taken[target.lower()] is None:
                out[path] = ("invalid-target", None)
            elif taken[target.lower()] == (size, full):
                out[path] = ("duplicate-at-target", None)
            else:
                continue
            break
    return out


def test_rules_numbering(spark):
    """Names that are taken, also numbered ones; equal files and folders at the target; files that are there already."""
    made = rules.parse('[[rules]]\nname="r"\nglob="**/in*/*"\ntarget="t/{name}"\n[[rules]]\nname="r2"\nglob="t/x (2).txt"\ntarget="t/x.txt"\n[[rules]]\nname="r3"\nglob="t/Y.txt"\ntarget="t/y.txt"')
    rows = [("/c/t/x.txt", 9, "aa"), ("/c/t/x (2).txt", 8, "bb"), ("/c/t/x (4).txt", 7, "cc"), ("/c/t/Y.txt", 5, "dd"), ("/c/t/h (2)", 4, "ee"), ("/c/t/g.txt", 1, "ff")]
    rows += [(f"/c/in{i}/x.txt", 100 + i, "00") for i in range(5)] + [("/c/in7/x.txt", 8, "bb"), ("/c/in8/x.txt", 7, "cc"), ("/c/in9/x.txt", 9, "aa")]
    rows += [(f"/c/in{i}/{n}", 50, f"0{i}") for i in range(3) for n in ("z.txt", "h", "g.txt", "Q.tar.gz")] + [("/c/in0/" + "l" * 250, 1, "01"), ("/c/in1/" + "l" * 250, 1, "02")]
    schema = "path string, size long, hash string"
    files = spark.createDataFrame(rows, schema).selectExpr(
        "path", "lower(path) AS path_key", "regexp_extract(path, '([^/]+)$', 1) AS name", "regexp_replace(lower(path), '[^/]+$', '') AS dir_key", "element_at(split(path, '[.]'), -1) AS ext", "size", "0L AS mtime",
        "false AS is_link", "false AS cloud_only", "unhex(hash) AS full_hash", "cast(null AS string) AS category", "cast(null AS double) AS confidence", "cast(null AS map<string,string>) AS fields",
    )
    folders = ["/c/t/z.txt", "/c/t/q (2).tar.gz", "/c/t/Q.tar (2).gz"]
    dirs = spark.createDataFrame([(f.lower() + "/",) for f in folders], "dir_key string")
    plan = {r.path: (r.reason.replace("r2", "r").replace("r3", "r"), r.target) for r in rules.plan_rules(files, made, 0, "/c/", dirs).collect()}
    wanted = {p: "/c/t/" + p.rsplit("/", 1)[1] for p, _, _ in rows if "/in" in p} | {"/c/t/x (2).txt": "/c/t/x.txt", "/c/t/Y.txt": "/c/t/y.txt"}
    assert plan == _walked(rows, rows, folders, wanted)
    assert plan["/c/in0/x.txt"] == ("rule:r", "/c/t/x (3).txt") and plan["/c/in1/x.txt"] == ("rule:r", "/c/t/x (5).txt")


def test_file_categories(spark):
    from stowage.functions import names

    want = {"docx": "Dokumente", "PDF": "Dokumente", "xlsm": "Dokumente", "eml": "Dokumente", "ico": "Bilder", "flv": "Video", "mp4": "Video", "opus": "Audio", "cab": "Archive", "bat": "Code", "csproj": "Code", "exe": "Ausführbar", "scr": "Ausführbar", "epub": "Sonstige", "lnk": "Sonstige", "": "Sonstige", None: "Sonstige"}
    got = spark.createDataFrame([(x,) for x in want], "ext string").select("ext", names.file_category(F.col("ext")).alias("c")).collect()
    assert {r.ext: r.c for r in got} == want


@pytest.mark.parametrize("bad", ['text_regex="("', 'category_source="x"', 'exif_fallback="x"', 'fields_regex={a="["}'])
def test_bad_content_rules(bad):
    with pytest.raises(ValueError):
        rules.parse(f'[[rules]]\nname="a"\ntarget="x"\n{bad}')
    with pytest.raises(ValueError):
        rules.parse('[[rules]]\nname="a"\ntarget="{exif.date:%Q}"')


def test_categories(spark):
    from stowage.functions import categories as cats

    base = '[[categories]]\nname="mahnung"\nkeywords={"mahngebühr"=4,"in verzug"=3}\n[[categories]]\nname="angebot"\nkeywords={"angebot"=3}\nexclude_keywords=["absage"]\next=["pdf"]\n'
    own = 'disable_builtin=["angebot"]\n[[categories]]\nname="mahnung"\nkeywords={"neu"=3}\n'
    assert [c.name for c in cats.load(base)] == ["angebot", "mahnung"] and [list(c.keywords) for c in cats.load(base, own)] == [["neu"]]
    rows = [(1, "Die Mahngebuehr, in Verzug!", "x.pdf", "pdf"), (2, "Mahngebühren inverzug", "x.pdf", "pdf"), (3, None, "Ein_Angebot.pdf", "PDF"), (4, "Angebot", "a.txt", "txt"), (5, "Angebot und Absage", "a.pdf", "pdf"), (6, None, None, None)]
    files = spark.createDataFrame(rows, "id int, text string, name string, ext string")
    got = {r.id: r.found for r in cats.categorize(files, cats.load(base)).collect()}
    assert (got[1].category, got[1].score, got[1].confidence, got[1].hits) == ("mahnung", 7, 0.88, ["mahngebühr", "in verzug"])
    assert got[3].category == "angebot" and got[3].hits == ["angebot (name)"]
    assert [got[i].category for i in (2, 4, 5, 6)] == [None] * 4
    assert cats.categorize(files.limit(0), cats.load(base)).collect() == [] and all(r.found.category is None for r in cats.categorize(files, []).collect())


@pytest.mark.parametrize("bad", ['keywords={a=11}', 'patterns={"("=1}', "odd=1", 'name="b"'])
def test_bad_categories(bad):
    from stowage.functions import categories as cats

    with pytest.raises(ValueError):
        cats.load('[[categories]]\nname="b"\n[[categories]]\n' + bad)


def test_templates(spark):
    from stowage.operators import template

    dirs = spark.createDataFrame(
        [(k, False, m) for k, m in (("/r/", "full"), ("/r/1 projekte/", "full"), ("/r/2 bereiche/", "full"), ("/r/4 archiv/", "full"), ("/r/neu/", "full"), ("/r/neu/x/", "full"), ("/r/_archiv/", "full"), ("/r/.stowage/", "full"))],
        "dir_key string, is_link boolean, mode string",
    )
    files = spark.createDataFrame([("/r/a", "/r/", False), ("/r/l", "/r/", True), ("/r/neu/b", "/r/neu/", False), ("/r/_archiv/c", "/r/_archiv/", False)], "path string, dir_key string, is_link boolean")
    found = template.checked(files, dirs, "/r/", template.parse("PARA"))
    assert {(r.kind, r.path) for r in template.deviations(found).collect()} == {("missing_required", "/r/3 Ressourcen/"), ("unexpected_dir", "/r/neu/"), ("file_not_allowed", "/r/a")}
    assert {r.bucket: (r.checked, r.deviations) for r in template.by_bucket(found).collect()} == {"": (2, 2), "/r/1 projekte/": (1, 0), "/r/2 bereiche/": (1, 0), "/r/4 archiv/": (1, 0), "/r/neu/": (1, 1)}
    deep = template.checked(files, dirs, "/r/", template.parse("max_depth = 1"))
    assert [(r.kind, r.path) for r in deep.collect()] == [("too_deep", "/r/neu/x/")]
    assert [len(level.patterns) for level in template.parse("johnny-decimal").levels] == [1, 1, 1]
    assert template.checked(files.limit(0), dirs.limit(0), "/r/", template.parse("johnny-decimal")).collect() == []


@pytest.mark.parametrize("bad", ["", "max_depth = 0", "x = 1", '[[levels]]\npatterns = ["("]', '[[levels]]\nallowed = ["a/b"]', "max_depth = 1\n[[levels]]\n[[levels]]"])
def test_bad_templates(bad):
    from stowage.operators import template

    with pytest.raises(ValueError):
        template.parse(bad)
