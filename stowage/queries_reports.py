"""Queries of reviews, orders, checks of plans and texts, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import checks, formats, names, paths
from .operators import content, health, order, review, template, tree
from .plans import planners, protect
from .queries import _DUPS, _HEALTH, _PARTS, _STATS, _VALUE, ORACLE, PROTECT, _dirs, _files, _metrics, _template, exact_dups, plan_empty_dirs, plan_versions, problems, query, structure_issues
from .sources import bindings, readers
from .sources.bindings import FILES_SQL, ROOT, TREE_SQL
from .sources.listing import excluded_file

# ---------------------------------------------------------------- reviews of plans
_ROWS = FILES_SQL + f""",
vp AS ({ORACLE['plan_versions']}),
rr AS (SELECT vp.*, CASE WHEN action <> 'skip' THEN coalesce(f.size, 0) ELSE 0 END AS size FROM vp LEFT JOIN files f USING (path))"""


def _rows(spark, d):
    return review.rows(plan_versions(spark, d), _files(spark, d))


@query(_ROWS + " SELECT path, action, size FROM rr WHERE action = 'move' AND starts_with(lower(path), '/c/src1/') AND size BETWEEN 200 AND 20000 AND contains(lower(path || ' ' || coalesce(target, '') || ' ' || reason), 'bericht1')")
def review_rows(spark, d):
    return review.matching(_rows(spark, d), action="move", folder="/c/src1", min_size=200, max_size=20000, text=" Bericht1 ").select("path", "action", "size")


@query(_ROWS + " SELECT path, reason FROM rr WHERE action = 'skip' AND contains(lower(path || ' ' || reason), 'cloud')")
def review_skips(spark, d):
    return review.matching(_rows(spark, d), skipped=True, text="CLOUD").select("path", "reason")


@query(_ROWS + """ SELECT count(*) FILTER (size > 500) AS selected, coalesce(sum(size) FILTER (size > 500), 0)::BIGINT AS selected_bytes, count(*) AS total, coalesce(sum(size), 0)::BIGINT AS total_bytes,
  count(*) FILTER (size > 500 AND action = 'quarantine') AS quarantine, count(*) FILTER (size > 500 AND action = 'move') AS moves, count(*) FILTER (size > 500 AND action = 'remove-dir') AS remove_dirs FROM rr WHERE action <> 'skip'""")
def review_summary(spark, d):
    return review.summary(_rows(spark, d), F.col("size") > 500)


@query(TREE_SQL + f""", e AS (SELECT path FROM ({ORACLE['plan_empty_dirs']}) WHERE action <> 'skip')
SELECT path, NOT regexp_matches(path, 'n5/$') AND NOT EXISTS (SELECT 1 FROM e x WHERE regexp_matches(x.path, 'n5/$') AND starts_with(x.path, e.path) AND x.path <> e.path) AS selected FROM e""")
def review_deselected(spark, d):
    return review.deselect(plan_empty_dirs(spark, d), F.col("path").rlike("n5/$"), ROOT).select("path", "selected")


@query(_ROWS + " SELECT action, reason, count(*) AS n, sum(size)::BIGINT AS bytes FROM rr WHERE action <> 'skip' GROUP BY ALL")
def plan_totals(spark, d):
    return review.totals(_rows(spark, d))


@query(_ROWS + " SELECT reason, count(*) AS n FROM rr WHERE action = 'skip' GROUP BY ALL")
def plan_skips(spark, d):
    return review.skips_by_reason(_rows(spark, d))


# ---------------------------------------------------------------- plans that break rules
_MOVES = """SELECT o_orderkey AS id,
  CASE o_orderkey % 9 WHEN 0 THEN '/d/' WHEN 1 THEN '/c/a/../' WHEN 2 THEN '/c/Box' || cast(o_orderkey % 50 AS string) || '/' ELSE '/c/' || cast(o_custkey % 20 AS string) || '/' END || cast(o_orderkey AS string) || CASE WHEN o_orderkey % 12 = 7 THEN '/' ELSE '' END AS path,
  CASE WHEN o_orderkey % 17 = 3 THEN 'quarantine' ELSE 'move' END AS action,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '/e/' || cast(o_orderkey AS string) WHEN o_orderkey % 10 = 2 THEN '/c/_Archiv/' || cast(o_orderkey AS string) WHEN o_orderkey % 10 = 3 THEN '/c/z/' || cast(floor(o_orderkey / 100) AS string)
    WHEN o_orderkey % 10 = 4 THEN '/c/' || cast(o_custkey % 20 AS string) || '/' || cast(o_orderkey - 1 AS string) || '/in' ELSE '/c/t/' || cast(o_orderkey AS string) END AS target,
  'r' AS reason, CASE WHEN o_orderkey % 19 = 5 THEN NULL ELSE 'docs' END AS rule FROM {orders}"""
_KEY = lambda c: f"rtrim(lower({c}), '/')"
_BROKEN = f"WITH pl AS ({_MOVES.replace('string', 'varchar').replace('floor(o_orderkey / 100) AS', 'o_orderkey // 100 AS').format(orders='orders')})" + f""",
p AS (SELECT *, {_KEY('path')} AS k, {_KEY('target')} AS t, ends_with(path, '/') AS folder FROM pl)"""


@query(_BROKEN + r"""
SELECT path, 'outside' AS rule FROM p WHERE NOT starts_with(k, '/c/')
UNION ALL SELECT path, 'dots' FROM p WHERE regexp_matches(path, '/\.\.?(/|$)') OR regexp_matches(target, '/\.\.?(/|$)')
UNION ALL SELECT path, 'not a move' FROM p WHERE action <> 'move'
UNION ALL SELECT path, 'name of the rule' FROM p WHERE rule IS NULL
UNION ALL SELECT path, 'folder in quarantine' FROM p WHERE action = 'quarantine' AND folder
UNION ALL SELECT path, 'number of files' FROM p WHERE action = 'move' AND folder
UNION ALL SELECT path, 'target not allowed' FROM p WHERE action = 'quarantine' AND target IS NOT NULL
UNION ALL SELECT path, 'no target' FROM p WHERE action = 'move' AND target IS NULL
UNION ALL SELECT path, 'target outside' FROM p WHERE action = 'move' AND NOT starts_with(t, '/c/')
UNION ALL SELECT path, 'target reserved' FROM p WHERE action = 'move' AND (starts_with(t, '/c/_archiv/') OR starts_with(t, '/c/.quarantine/'))
UNION ALL SELECT path, 'folder by rule' FROM p WHERE action = 'move' AND folder
UNION ALL SELECT path, 'target in source' FROM p WHERE action = 'move' AND starts_with(t, k || '/')
UNION ALL SELECT min(path), 'same target' FROM p WHERE target IS NOT NULL GROUP BY lower(target) HAVING count(*) > 1
UNION ALL SELECT path, 'target is a source' FROM p WHERE t <> k AND t IN (SELECT k FROM p)
UNION ALL SELECT path, 'target inside a moved folder' FROM p WHERE EXISTS (SELECT 1 FROM p f WHERE f.folder AND f.path <> p.path AND (p.t = f.k OR starts_with(p.t, f.k || '/')))
UNION ALL SELECT path, 'inside a moved folder' FROM p WHERE EXISTS (SELECT 1 FROM p f WHERE f.folder AND f.action = 'move' AND starts_with(p.k, f.k || '/'))""")
def plan_violations(spark, d):
    """A plan of rules in which each rule of sound plans is broken somewhere."""
    return planners.validate(spark.sql(_MOVES, orders=bindings.table(spark, d, "orders")), ROOT, kind="rules")


_COPIES = """SELECT 1 + o_orderkey % 3000 AS id, '/c/' || cast(o_custkey % 300 AS string) || '/' || cast(o_orderkey % 60 AS string) || CASE WHEN o_orderkey % 23 = 1 THEN '' ELSE '/' END AS path, CASE WHEN o_orderkey % 29 = 2 THEN 'skip' ELSE 'quarantine' END AS action,
  CASE WHEN o_orderkey % 31 = 4 THEN '/c/q' END AS target, 'r' AS reason, CASE WHEN o_orderkey % 13 = 6 THEN NULL WHEN o_orderkey % 13 = 7 THEN '/c/' || cast(o_custkey % 300 AS string) || '/' ELSE '/k/' || cast(o_custkey % 300 AS string) || '/' || cast(o_orderkey % 70 AS string) || '/' END AS keep,
  CASE WHEN o_orderkey % 37 = 3 THEN 'XY' WHEN o_orderkey % 13 = 6 AND o_orderkey % 2 = 0 THEN NULL ELSE md5(cast(o_orderkey AS string)) END AS hash, CASE WHEN o_orderkey % 13 = 6 AND o_orderkey % 2 = 0 THEN NULL ELSE md5(cast(o_orderkey - o_orderkey % 2 AS string)) END AS keep_hash,
  CASE WHEN o_orderkey % 41 > 0 THEN cast(3 AS bigint) END AS files, CASE WHEN o_orderkey % 43 > 0 THEN md5('k') END AS keep_fingerprint, CASE WHEN o_orderkey % 47 = 1 THEN 'zz' END AS source_fingerprint FROM {orders}"""


@query(f"WITH pl AS ({_COPIES.replace('string', 'varchar').format(orders='orders')})" + f""",
p AS (SELECT *, {_KEY('path')} AS k, {_KEY('target')} AS t, {_KEY('keep')} AS kp, ends_with(path, '/') AS folder, (hash IS NOT NULL)::INT + (keep IS NOT NULL)::INT + (keep_hash IS NOT NULL)::INT AS given FROM pl WHERE action <> 'skip')""" + r"""
SELECT path, 'keep_fingerprint' AS rule FROM p WHERE folder AND NOT coalesce(regexp_full_match(keep_fingerprint, '[0-9a-f]{32}'), false)
UNION ALL SELECT path, 'source_fingerprint' FROM p WHERE source_fingerprint IS NOT NULL
UNION ALL SELECT path, 'not a folder' FROM p WHERE NOT folder
UNION ALL SELECT path, 'number of files' FROM p WHERE folder AND files IS NULL
UNION ALL SELECT path, 'hash and keep' FROM p WHERE given NOT IN (0, 3)
UNION ALL SELECT path, 'no hash' FROM p WHERE given = 0
UNION ALL SELECT path, 'not a hash' FROM p WHERE given = 3 AND NOT (regexp_full_match(hash, '[0-9a-f]{32}') AND regexp_full_match(keep_hash, '[0-9a-f]{32}'))
UNION ALL SELECT path, 'other hash' FROM p WHERE given = 3 AND hash <> keep_hash
UNION ALL SELECT path, 'keeps itself' FROM p WHERE given = 3 AND kp = k
UNION ALL SELECT path, 'keep nested' FROM p WHERE given = 3 AND folder AND (starts_with(k, kp || '/') OR starts_with(kp, k || '/'))
UNION ALL SELECT path, 'target not allowed' FROM p WHERE target IS NOT NULL
UNION ALL SELECT min(path), 'id twice' FROM p GROUP BY id HAVING count(*) > 1
UNION ALL SELECT min(path), 'twice' FROM p GROUP BY lower(path) HAVING count(*) > 1
UNION ALL SELECT min(path), 'same target' FROM p WHERE target IS NOT NULL GROUP BY lower(target) HAVING count(*) > 1
UNION ALL SELECT path, 'target is a source' FROM p WHERE t <> k AND t IN (SELECT k FROM p)
UNION ALL SELECT path, 'keep is a source' FROM p WHERE kp IN (SELECT k FROM p)
UNION ALL SELECT DISTINCT path, 'target inside a moved folder' FROM p WHERE EXISTS (SELECT 1 FROM p f WHERE f.folder AND f.path <> p.path AND (p.t = f.k OR starts_with(p.t, f.k || '/')))
UNION ALL SELECT DISTINCT path, 'inside a kept folder' FROM p WHERE EXISTS (SELECT 1 FROM p f WHERE f.folder AND f.kp IS NOT NULL AND f.path <> p.path AND (p.k = f.kp OR starts_with(p.k, f.kp || '/')))
UNION ALL SELECT DISTINCT path, 'inside a removed folder' FROM p WHERE EXISTS (SELECT 1 FROM p f WHERE f.folder AND f.path <> p.path AND (p.k = f.k OR starts_with(p.k, f.k || '/')))
UNION ALL SELECT DISTINCT path, 'keep inside a removed folder' FROM p WHERE EXISTS (SELECT 1 FROM p f WHERE f.folder AND f.path <> p.path AND (p.kp = f.k OR starts_with(p.kp, f.k || '/')))""")
def plan_violations_folders(spark, d):
    """The same for a plan of duplicate folders."""
    return planners.validate(spark.sql(_COPIES, orders=bindings.table(spark, d, "orders")), ROOT, kind="dedupe-dirs")


# ---------------------------------------------------------------- health with a template
_WITH_TEMPLATE = _HEALTH + f""", tb AS ({ORACLE['template_buckets']}),
ht AS (SELECT hm.* REPLACE (coalesce(tb.checked, 0)::BIGINT AS template_checked, coalesce(tb.deviations, 0)::BIGINT AS template_deviations) FROM hm LEFT JOIN tb ON tb.bucket = hm.folder),
hv AS (SELECT folder, """ + ", ".join(f"{_VALUE(b)} AS {k}" for k, (_, b) in _PARTS.items()) + f""", {_VALUE('(CASE WHEN template_checked > 0 THEN template_deviations / template_checked ELSE 0.0 END) / 0.30')} AS template FROM ht)"""
_SIX = [*((k, w) for k, (w, _) in _PARTS.items()), ("template", 20)]


@query(_WITH_TEMPLATE + " SELECT folder, " + ", ".join(f"round({k}, 4) AS {k}" for k, _ in _SIX) + ", round((" + " + ".join(f"{k} * {w}" for k, w in _SIX) + ") / 120, 0)::INT AS score, "
       + ", ".join(f"CASE WHEN {w} / 120 * (100 - {k}) >= 0.5 THEN round({w} / 120 * (100 - {k}), 1) ELSE 0.0 END::DOUBLE AS {k}_deduction" for k, w in _SIX) + " FROM hv")
def health_score_template(spark, d):
    return health.scores(_metrics(spark, d, template.by_bucket(_template(spark, d))))


@query(_WITH_TEMPLATE + ", dd AS (" + " UNION ALL ".join(f"SELECT folder, '{k}' AS part, {i} AS i, round({w} / 120 * (100 - {k}), 1)::DOUBLE AS points, {w} / 120 * (100 - {k}) AS exact FROM hv" for i, (k, w) in enumerate(_SIX))
       + ") SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY points DESC, i)::INT AS place, part, points FROM dd WHERE exact >= 0.5 QUALIFY place <= 3")
def top_deductions(spark, d):
    return health.top_deductions(health_score_template(spark, d))


# ---------------------------------------------------------------- orders
@query(FILES_SQL + "," + _DUPS + " SELECT size, full_hash, first_path, row_number() OVER (ORDER BY size * (instances - 1) DESC, first_path) AS group_no FROM grp")
def dup_group_numbers(spark, d):
    return order.duplicate_groups(exact_dups(spark, d)).select("size", "full_hash", "first_path", "group_no")


@query(f"SELECT dir_key, issue, row_number() OVER (ORDER BY issue, dir_key) AS place FROM ({ORACLE['structure_issues']})")
def structure_order(spark, d):
    return order.structure_order(structure_issues(spark, d)).select("dir_key", "issue", "place")


@query(f"SELECT path, is_dir, row_number() OVER (ORDER BY path, is_dir DESC) AS place FROM ({ORACLE['problems']})")
def problem_order(spark, d):
    return order.problem_order(problems(spark, d)).select("path", "is_dir", "place")


@query(TREE_SQL + f""", fo AS ({ORACLE['folder_fingerprints']}),
hc AS (SELECT DISTINCT dir_key FROM files),
hg AS (SELECT fo.dir_key, max(length(hc.dir_key) - length(replace(hc.dir_key, '/', ''))) - min(length(fo.dir_key) - length(replace(fo.dir_key, '/', ''))) AS h FROM fo JOIN hc ON starts_with(hc.dir_key, fo.dir_key) GROUP BY 1),
fg AS (SELECT first_folder, max(h) AS height, min(length(dir_key) - length(replace(dir_key, '/', ''))) AS top, max(bytes) AS bytes FROM fo JOIN hg USING (dir_key) WHERE folders > 1 GROUP BY 1)
SELECT first_folder, height::BIGINT AS height, top::BIGINT AS top, bytes, row_number() OVER (ORDER BY height DESC, top, bytes DESC, first_folder) AS group_no FROM fg""")
def folder_group_order(spark, d):
    f = _files(spark, d)
    groups = tree.folder_groups(tree.fingerprints(f, _dirs(spark, d), ROOT)).join(order.heights(f.select("dir_key").distinct(), ROOT), "dir_key")
    return order.folder_group_order(groups).select("first_folder", "height", "top", F.col("bytes").cast("long").alias("bytes"), "group_no")


@query(TREE_SQL + "," + _STATS + """,
l AS (SELECT ancestor AS dir_key, md5(string_agg(substr(path_key, length(ancestor) + 1) || '|' || size || '|' || mtime, chr(10) ORDER BY path_key)) AS m, count(*) AS files FROM anc JOIN files USING (dir_key) GROUP BY 1)
SELECT dir_key, files, count(*) OVER (PARTITION BY m) AS equal, min(dir_key) OVER (PARTITION BY m) AS first_folder FROM l""")
def meta_fingerprints(spark, d):
    """The print itself depends on how it is made; which folders share one does not."""
    prints = tree.meta_fingerprints(_files(spark, d), ROOT)
    same = prints.groupBy("meta", F.col("files").alias("_f")).agg(F.count("*").alias("equal"), F.min("dir_key").alias("first_folder"))
    return prints.join(same, (prints["meta"] == same["meta"]) & (F.col("files") == F.col("_f"))).select("dir_key", "files", "equal", "first_folder")


# ---------------------------------------------------------------- values and texts
@query(FILES_SQL + """ SELECT path_key, lower(dir_key) || CASE WHEN ends_with(dir_key, '/') THEN '' ELSE '/' END AS dir, CASE WHEN regexp_matches(name, '^[-=+@\t\r]') THEN '''' || name ELSE name END AS safe,
  strftime(to_timestamp(mtime // 10000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS changed,
  CASE WHEN length(path) > 260 THEN 'path_too_long' WHEN regexp_matches(name, '["*:<>?/|\\\\]') THEN 'invalid_chars' WHEN starts_with(name, ' ') OR ends_with(name, ' ') THEN 'leading_trailing_space' WHEN ends_with(name, '.') THEN 'trailing_dot' END AS name_issue,
  '/c/.quarantine/20240101-000000-ab12/' || substr(path, 4) AS held, lower(name) IN ('pagefile.sys', 'hiberfil.sys', 'swapfile.sys') OR ends_with(lower(name), '.tmp') AS excluded FROM files""")
def file_texts(spark, d):
    problems_ = F.filter(F.array(*(F.when(c, k) for k, c in names.name_problems(F.col("name"), F.col("path")))), lambda x: x.isNotNull())
    return _files(spark, d).select(
        "path_key", paths.dir_key(F.rtrim(F.col("dir_key"), F.lit("/"))).alias("dir"), readers.safe(F.col("name")).alias("safe"), F.regexp_replace(checks.rfc3339(F.col("mtime")), "Z$", "+00:00").alias("changed"),
        formats.first_or_null(problems_).alias("name_issue"), formats.quarantine_target(F.col("path"), ROOT, "20240101-000000-ab12").alias("held"), excluded_file(F.col("path"), F.col("name"), ["*.tmp"]).alias("excluded"),
    )


_STAMPS = "SELECT event_id, user_id, cast(1704067200 + event_id * 977 AS bigint) AS s, '2024010' || cast(event_id % 10 AS string) || '-12' || cast(1000 + event_id % 9000 AS string) || CASE WHEN event_id % 3 = 0 THEN '-AB12' ELSE '-ab1' || cast(event_id % 7 AS string) END AS run FROM {events}"
_CLOCKS = ["06:30", "00:00", "23:59"]


@query(f"WITH t AS (SELECT *, to_timestamp(s) AT TIME ZONE 'UTC' AS now FROM ({_STAMPS.replace('string', 'varchar').format(events='events')})),"
       + """ u AS (SELECT *, CASE user_id % 8 WHEN 7 THEN NULL ELSE user_id % 8 END AS day, CASE user_id % 3 WHEN 0 THEN 390 WHEN 1 THEN 0 ELSE 1439 END AS m FROM t),
v AS (SELECT *, date_trunc('day', now) + to_minutes(m::BIGINT) + to_days(CASE WHEN day IS NULL THEN 0 ELSE ((day - (isodow(now) - 1) + 7) % 7)::INT END) AS due FROM u)
SELECT event_id, strftime(CASE WHEN due >= now THEN due ELSE due + to_days(CASE WHEN day IS NULL THEN 1 ELSE 7 END) END, '%Y-%m-%d %H:%M:%S') AS next, regexp_full_match(run, '[0-9]{8}-[0-9]{6}-[0-9a-f]{4}') AS is_run FROM v""")  # fmt: skip
def next_runs(spark, d):
    t = spark.sql(_STAMPS, events=bindings.table(spark, d, "events"))
    clock = F.when(F.col("user_id") % 3 == 0, _CLOCKS[0]).when(F.col("user_id") % 3 == 1, _CLOCKS[1]).otherwise(_CLOCKS[2])
    day = F.when(F.col("user_id") % 8 < 7, F.col("user_id") % 8)
    when = formats.next_run(F.timestamp_seconds("s"), clock, day)
    return t.select("event_id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("next"), checks.is_run_id(F.col("run")).alias("is_run"))


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 21 - 10 AS dl, o_orderkey % 7 = 0 AS first, o_orderkey % 4 = 0 AS lim, o_orderkey % 101 AS score, TIMESTAMP '2024-06-01 14:30:00' AS now, TIMESTAMP '2024-06-01 14:32:00' - to_seconds((o_orderkey * o_orderkey) % 900000) AS seen FROM orders),
x AS (SELECT *, CASE WHEN dl = 0 THEN '±0' WHEN dl > 0 THEN '+' || dl ELSE '−' || (-dl) END AS change, epoch(now - seen)::BIGINT AS sec, date_diff('day', seen, now) AS days FROM t)
SELECT id, 'Health-Score ' || score || CASE WHEN first THEN ' (erster Lauf)' ELSE ' (' || change || ' seit ' || strftime(seen, '%d.%m.') || CASE WHEN lim THEN ', eingeschränkt vergleichbar' ELSE '' END || ')' END AS line,
  CASE WHEN sec < -60 THEN strftime(seen, '%d.%m.%Y') WHEN sec < 60 THEN 'gerade eben' WHEN sec < 3600 THEN 'vor ' || (sec // 60) || ' Min.' WHEN days = 0 THEN 'heute ' || strftime(seen, '%H:%M') WHEN days = 1 THEN 'gestern ' || strftime(seen, '%H:%M')
    WHEN days <= 6 THEN 'vor ' || days || ' Tagen' ELSE strftime(seen, '%d.%m.%Y') END AS ago FROM x""")
def score_lines(spark, d):
    key = F.col("o_orderkey")
    now = F.lit("2024-06-01 14:30:00").cast("timestamp")
    at = F.timestamp_seconds(F.unix_timestamp(now) + 120 - (key * key) % 900000)
    delta = F.when(key % 7 != 0, key % 21 - 10)
    return bindings.table(spark, d, "orders").select(key.alias("id"), formats.score_line(key % 101, delta, at, key % 4 == 0).alias("line"), formats.relative_time(now, at).alias("ago"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{}' ELSE '{"lang":"' || coalesce(lang, '-') || '","source":"' || source || '"}' END AS json, CASE WHEN doc_id % 3 > 0 THEN source END AS source_back FROM documents""")
def fields_as_json(spark, d):
    docs = bindings.table(spark, d, "documents")
    fields = F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("source"), "source", F.lit("lang"), F.coalesce("lang", F.lit("-"))))
    text = formats.fields_json(fields)
    return docs.select("doc_id", text.alias("json"), F.element_at(formats.fields_from_json(text), "source").alias("source_back"))


@query(r"""WITH w AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 50 END AS pages, len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, n >= 50 OR n // greatest(1, least(coalesce(pages, 1), 30)) >= 20 AS usable FROM w""")
def layers_usable(spark, d):
    pages = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 50)
    return bindings.table(spark, d, "documents").select("doc_id", checks.layer_usable(F.col("text"), pages).alias("usable"))


# ---------------------------------------------------------------- classified content
_CACHE = """SELECT path_key, CASE WHEN file_id % 10 = 9 THEN size + 1 ELSE size END AS size, mtime, CASE file_id % 8 WHEN 1 THEN 'unsupported' WHEN 2 THEN 'too_large' WHEN 3 THEN 'unreadable' ELSE 'ok' END AS status,
  CASE WHEN file_id % 8 = 3 THEN CASE WHEN file_id % 16 = 3 THEN 'password' ELSE 'broken' END END AS why, CASE file_id % 5 WHEN 0 THEN 'foto' WHEN 1 THEN 'rechnung' WHEN 2 THEN 'vertrag' END AS category,
  (file_id % 10) / 10 + 0.05 AS confidence, CASE file_id % 7 WHEN 0 THEN 'llm' ELSE 'rules' END AS source, CASE file_id % 4 WHEN 0 THEN 'layer' WHEN 1 THEN 'office' WHEN 2 THEN 'ocr' ELSE 'none' END AS text_source, file_id FROM {files} WHERE file_id % 6 > 0"""
_CONTENT = FILES_SQL + f""",
ca AS ({_CACHE.format(files='files')}),
fd AS (SELECT f.path, f.size, CASE WHEN f.cloud_only THEN 'cloud' WHEN coalesce(ca.size = f.size AND ca.mtime = f.mtime, false) THEN 'known' ELSE 'new' END AS state, ca.* EXCLUDE (path_key, size, mtime, file_id), f.file_id
  FROM files f LEFT JOIN ca USING (path_key) WHERE NOT f.is_link),
kn AS (SELECT *, source = 'llm' OR file_id % 21 = 5 AS bymodel, status = 'ok' AND category IS NOT NULL AND confidence < 0.8 AS rev FROM fd WHERE state = 'known')"""


def _content(spark, d):
    made = spark.sql(_CACHE, files=_files(spark, d))
    k = F.col("file_id")
    exif = F.map_concat(
        F.when(k % 2 == 0, F.create_map(F.lit("exif.country"), F.concat(F.lit("L"), (k % 17).cast("string")))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(k % 4 == 0, F.create_map(F.lit("exif.city"), F.concat(F.lit("S"), (k % 3).cast("string")))).otherwise(F.create_map().cast("map<string,string>")),
        F.when(k % 3 == 0, F.create_map(F.lit("exif.camera"), F.concat(F.lit("K"), (k % 13).cast("string")))).otherwise(F.create_map().cast("map<string,string>")),
    )
    sources = F.when(k % 21 == 5, F.create_map(F.lit("doc.date"), F.lit("llm"))).otherwise(F.create_map(F.lit("doc.date"), F.lit("pattern")))
    cache = made.withColumns({"fields": exif, "field_sources": sources, "category2": F.lit(None).cast("string"), "confidence2": F.lit(None).cast("double")}).drop("file_id")
    return content.records(_files(spark, d), cache), cache


_COUNTS = """count(*) FILTER (status = 'unsupported') AS unsupported, count(*) FILTER (status = 'too_large') AS too_large, count(*) FILTER (status = 'unreadable') AS unreadable, count(*) FILTER (category IS NULL) AS uncategorized,
  count(*) FILTER (text_source IN ('layer', 'office')) AS text, count(*) FILTER (text_source = 'ocr') AS ocr, count(*) FILTER (text_source = 'none' AND (file_id % 2 = 0 OR file_id % 3 = 0)) AS meta, count(*) FILTER (bymodel) AS llm, count(*) FILTER (rev) AS review"""


@query(_CONTENT + f" SELECT (SELECT count(*) FROM fd) AS files, count(*) AS classified, (SELECT count(*) FROM fd WHERE state = 'cloud') AS cloud_only, (SELECT count(*) FROM fd WHERE state = 'new') AS not_classified, {_COUNTS} FROM kn")
def content_totals(spark, d):
    return content.totals(_content(spark, d)[0])


@query(_CONTENT + f", al AS (SELECT *, source = 'llm' OR file_id % 21 = 5 AS bymodel, status = 'ok' AND category IS NOT NULL AND confidence < 0.8 AS rev FROM ca) SELECT count(*) AS files, count(*) AS classified, 0::BIGINT AS cloud_only, 0::BIGINT AS not_classified, {_COUNTS} FROM al")
def classify_summary(spark, d):
    return content.totals(content.of_records(_content(spark, d)[1]))


@query(_CONTENT + " SELECT category, count(*) AS files, sum(size)::BIGINT AS size, round(count(*) / (SELECT count(*) FROM kn), 6) AS share, count(*) FILTER (source = 'llm') AS llm FROM kn WHERE category IS NOT NULL GROUP BY 1")
def content_categories(spark, d):
    return content.by_category(_content(spark, d)[0])


@query(_CONTENT + " SELECT why, count(*) AS files FROM kn WHERE status = 'unreadable' GROUP BY 1")
def content_unreadable(spark, d):
    return content.unreadable(_content(spark, d)[0])


@query(_CONTENT + """, la AS (SELECT 'place' AS kind, 'L' || (file_id % 17) || CASE WHEN file_id % 4 = 0 THEN ' S' || (file_id % 3) ELSE '' END AS label FROM kn WHERE category = 'foto' AND file_id % 2 = 0
  UNION ALL SELECT 'camera', 'K' || (file_id % 13) FROM kn WHERE category = 'foto' AND file_id % 3 = 0)
SELECT kind, label, count(*) AS files FROM la GROUP BY kind, label QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, label) <= 10""")
def content_places(spark, d):
    return content.places_and_cameras(_content(spark, d)[0])


@query(_CONTENT + " SELECT path, category, round(confidence, 2)::DOUBLE AS confidence, NULL::VARCHAR AS category2, NULL::DOUBLE AS confidence2 FROM kn WHERE rev")
def content_review(spark, d):
    return content.review_list(_content(spark, d)[0]).withColumn("confidence", F.round(F.col("confidence").cast("double"), 2))


# ---------------------------------------------------------------- protection
_MARKED = FILES_SQL + r""",
f2 AS (SELECT *, CASE WHEN file_id % 199 = 7 THEN 'package.json' WHEN file_id % 211 = 3 THEN 'App.SLN' WHEN file_id % 97 = 1 THEN 'cargo.toml.bak' ELSE name END AS nm FROM files),
mk AS (SELECT DISTINCT dir_key FROM f2 WHERE NOT is_link AND regexp_matches(nm, '(?i)^(cargo\.toml|package\.json|.*\.(sln|csproj))$'))"""


@query(_MARKED + r"""SELECT path_key, CASE WHEN starts_with(path_key, '/c/src0/') THEN 'system' WHEN starts_with(path_key, '/c/src7/') THEN 'user-path' WHEN starts_with(path_key, '/c/src4/en/') THEN 'appdata'
  WHEN EXISTS (SELECT 1 FROM mk WHERE starts_with(f2.dir_key, mk.dir_key)) THEN 'project-marker' END AS protection FROM f2""")
def protection(spark, d):
    k = F.col("file_id")
    named = F.when(k % 199 == 7, "package.json").when(k % 211 == 3, "App.SLN").when(k % 97 == 1, "cargo.toml.bak").otherwise(F.col("name"))
    files = _files(spark, d).withColumn("name", named)
    return protect.protection(files, ROOT, user=PROTECT, system=["/c/src0"], appdata=["/c/src4/en"]).select("path_key", "protection")
