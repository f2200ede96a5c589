"""Inventory views over the driver's tables.

The views are plain SQL that Spark and DuckDB read alike, so the oracle starts
from the same rows; everything after them is written twice.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..scratch import settle

#: Ticks of 100 ns; "now" is a constant, so that results repeat.
TICKS = 10_000_000
NOW = 1_717_200_000 * TICKS
DAY = 86_400 * TICKS
ROOT = "/c/"

_NAMED = """
b AS (
  SELECT doc_id, source, lang, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h,
    cast(floor(doc_id / 20) AS bigint) AS q, (doc_id * 7) % 41 AS z
  FROM {documents} WHERE doc_id IS NOT NULL
),
g AS (SELECT h, min(doc_id) AS m, count(*) AS cl FROM b GROUP BY h),
heads AS (SELECT source, lang, h, min(doc_id) AS first_id FROM b GROUP BY source, lang, h),
shaped AS (
  SELECT b.doc_id, b.source, b.lang, b.n, b.h, b.q, b.z, g.m, g.cl, heads.first_id = b.doc_id AS head,
    cast(floor(b.q / 5) AS bigint) AS r
  FROM b JOIN g ON b.h = g.h JOIN heads ON heads.h = b.h AND heads.source = b.source AND heads.lang = b.lang
),
y AS (
  SELECT doc_id, doc_id AS ident, source, n, h, m, '/c/' || source || '/' || lang || '/' || CASE WHEN q % 4 = 1 THEN 'd' || cast(q % 3 AS string) || '/' ELSE '' END AS dir_key,
    CASE WHEN cl > 1 AND head AND m % 2 = 0 THEN 'scan' || cast(m AS string) || '.pdf'
    ELSE CASE z WHEN 1 THEN '~$' WHEN 2 THEN ' ' ELSE '' END
      || CASE WHEN q % 5 = 4 THEN '2024-03-01 ' ELSE '' END
      || CASE WHEN doc_id % 97 = 11 THEN 'thumbs' ELSE 'bericht' || cast(r AS string) END
      || CASE q % 5 WHEN 1 THEN '_v2' WHEN 2 THEN ' - kopie (3)' WHEN 3 THEN ' final' ELSE '' END
      || CASE WHEN z = 3 THEN '-laptop' ELSE '' END
      || CASE WHEN z = 4 THEN '.tmp' WHEN z = 5 THEN '.crdownload' ELSE
           CASE r % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.jpg' WHEN 3 THEN '.mp4' ELSE '.txt' END END
    END AS name
  FROM shaped
),
u AS (
  SELECT doc_id, ident, n, h, m, dir_key, name FROM y
  UNION ALL
  SELECT doc_id + 1000000000, doc_id + 1000000000, n, h, doc_id + 1000000000, replace(dir_key, '/c/', '/c/kopie/'), name FROM y WHERE source = 'src3'
),
files AS (
  SELECT doc_id AS file_id, dir_key, name, dir_key || name AS path, lower(dir_key || name) AS path_key,
    CASE WHEN name LIKE '%_.%' THEN lower(regexp_extract(name, '[.]([^.]*)$', 1)) END AS ext,
    cast(CASE WHEN doc_id % 67 = 5 OR doc_id % 29 = 6 THEN 0 ELSE n END AS bigint) AS size,
    cast(1717200000 - ((doc_id * 37) % 2000) * 86400 - doc_id % 3600 AS bigint) * 10000000 AS mtime,
    doc_id % 17 = 3 AS hidden, doc_id % 53 = 9 AS system, doc_id % 11 = 4 AS cloud_only, doc_id % 29 = 6 AS is_link,
    cast(1 AS bigint) AS volume_serial,
    cast(CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN m ELSE ident END AS bigint) AS file_index,
    CASE WHEN doc_id % 67 = 5 OR doc_id % 29 = 6 THEN NULL ELSE h END AS full_hash,
    cast(1 + doc_id % 3 AS bigint) AS generation
  FROM u
)"""

_DIRS = """,
extra AS (
  SELECT '/c/leer/' AS dir_key, 'full' AS mode, false AS is_link, cast(0 AS bigint) AS summary_size, cast(0 AS bigint) AS summary_files, 0 AS more FROM {nation} WHERE n_nationkey = 0
  UNION ALL
  SELECT '/c/leer/n' || cast(n_nationkey AS string) || '/', CASE WHEN n_nationkey % 6 = 5 THEN 'summary' ELSE 'full' END, n_nationkey % 8 = 7,
    cast(CASE WHEN n_nationkey % 6 = 5 THEN 1000 + n_nationkey ELSE 0 END AS bigint), cast(CASE WHEN n_nationkey % 6 = 5 THEN 3 ELSE 0 END AS bigint),
    CASE WHEN n_nationkey % 9 = 4 THEN 1 ELSE 0 END
  FROM {nation}
  UNION ALL
  SELECT '/c/leer/n' || cast(n_nationkey AS string) || '/tief/', 'full', false, cast(0 AS bigint), cast(0 AS bigint), 0 FROM {nation} WHERE n_nationkey % 5 = 0
),
alldirs AS (
  SELECT dir_key, mode, is_link, summary_size, summary_files, more FROM extra
  UNION ALL
  SELECT dir_key, 'full', false, cast(0 AS bigint), cast(0 AS bigint), 0 FROM (
    SELECT dir_key FROM files
    UNION SELECT regexp_extract(dir_key, '^(/c/[^/]*/)', 1) FROM files
    UNION SELECT regexp_extract(dir_key, '^(/c/[^/]*/[^/]*/)', 1) FROM files
    UNION SELECT regexp_extract(dir_key, '^(/c/[^/]*/[^/]*/[^/]*/)', 1) FROM files
    UNION SELECT '/c/' FROM {nation}
  ) t WHERE dir_key <> ''
),
parents AS (
  SELECT dir_key, CASE WHEN dir_key = '/c/' THEN NULL ELSE regexp_extract(dir_key, '^(.*/)[^/]+/$', 1) END AS parent_key, mode, is_link, summary_size, summary_files, more FROM alldirs
),
children AS (
  SELECT k, count(*) AS n FROM (SELECT dir_key AS k FROM files UNION ALL SELECT parent_key FROM parents WHERE parent_key IS NOT NULL) t GROUP BY k
),
errors AS (SELECT '/c/leer/n' || cast(n_nationkey AS string) || '/' AS path, 'access_denied' AS kind FROM {nation} WHERE n_nationkey % 7 = 2),
dirs AS (
  SELECT p.dir_key, p.parent_key, cast(length(p.dir_key) - length(replace(p.dir_key, '/', '')) - 2 AS bigint) AS depth,
    p.mode, p.is_link, p.summary_size, p.summary_files, e.path IS NOT NULL AS read_error,
    cast(coalesce(c.n, 0) + p.more AS bigint) AS direct_entries
  FROM parents p LEFT JOIN children c ON c.k = p.dir_key LEFT JOIN errors e ON e.path = p.dir_key
)"""

_NAMES = {"documents": "documents", "nation": "nation"}
#: Prefixes of the oracle's statements.
FILES_SQL = "WITH" + _NAMED.format(**_NAMES)
TREE_SQL = FILES_SQL + _DIRS.format(**_NAMES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _settled(spark: SparkSession, application: str, sf_dir: str, kind: str) -> DataFrame:
    """The inventory is a table: derived once for each session and folder."""
    nation = {} if kind == "files" else {"nation": table(spark, sf_dir, "nation")}
    sql = "WITH" + _NAMED + ("" if kind == "files" else _DIRS) + f" SELECT * FROM {kind}"
    return settle(spark.sql(sql, documents=table(spark, sf_dir, "documents"), **nation))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of files (F1)."""
    return _settled(spark, spark.sparkContext.applicationId, sf_dir, "files")


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of folders (F2)."""
    return _settled(spark, spark.sparkContext.applicationId, sf_dir, "dirs")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT '/c/leer/n' || cast(n_nationkey AS string) || '/' AS path, 'access_denied' AS kind FROM {nation} WHERE n_nationkey % 7 = 2", nation=table(spark, sf_dir, "nation"))
