"""Queries over file catalogs, checklist and framework tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..session import table
from ..sources import checklist, files, grid, stages
from . import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return keep


_CODES_OF = r"""list_filter(list_transform(regexp_extract_all(upper({0}), '[A-Z0-9]+'),
  lambda w: regexp_extract(w, '^([AGEDS][A-Z]{{0,3}}[0-9]{{1,3}})($|[^0-9])', 1)), lambda w: w <> '')"""

_KNOWN = f"""known AS (SELECT DISTINCT own AS code FROM coded WHERE own IS NOT NULL)"""

_BEST = f"""segments AS (SELECT relative_path, unnest(string_split(relative_path, '/')) AS part,
    generate_subscripts(string_split(relative_path, '/'), 1) AS depth FROM files),
found AS (SELECT relative_path, part, depth, unnest(c) AS code, generate_subscripts(c, 1) AS pos
  FROM (SELECT *, {_CODES_OF.format('part')} AS c FROM segments)),
best AS (SELECT relative_path, code, part, depth FROM found LEFT JOIN (SELECT code, 1 AS listed FROM known) USING (code)
  QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY coalesce(listed, 0) DESC, depth DESC, pos DESC) = 1),
named AS (SELECT f.*, string_split(relative_path, '/')[-1] AS file_name FROM files f)"""

_WITH = f"WITH {t.FILES}, {t.CHECKLIST}, {_KNOWN}, {_BEST}"

_KEEP = r"NOT regexp_matches(file_name, '(?i)(^\.|^~|Thumbs\.db$|\.DS_Store$|\.db$)')"

_EXT = r"lower(regexp_extract(file_name, '^.+(\.[^./]*)$', 1))"

_READER = "CASE " + _EXT + " " + " ".join(f"WHEN '{e}' THEN '{r}'" for e, r in fixed.READERS) + " END"


def known_codes(spark, sf):
    return checklist.indicators(checklist.checklist_rows(t.checklist_grid(spark, sf))).select("code").distinct()


def catalog(spark, sf):
    return files.catalog(t.files(spark, sf), known_codes(spark, sf))


@query(f"""{_WITH} SELECT n.file_path, n.relative_path, file_name, b.code AS folder_code, {_EXT} AS extension, {_READER} AS reader
FROM named n LEFT JOIN (SELECT DISTINCT relative_path, code FROM best) b USING (relative_path) WHERE {_KEEP}""")
def file_catalog(spark, sf):
    """S1 S10 N1"""
    return catalog(spark, sf)


@query(f"""{_WITH} SELECT count(*) AS files, count({_READER}) AS readable, count(*) - count({_READER}) AS skipped
FROM named WHERE {_KEEP}""")
def reader_routing(spark, sf):
    """S10"""
    return files.reader_counts(catalog(spark, sf))


@query(f"""{_WITH}, ext AS (SELECT coalesce(nullif(upper(ltrim({_EXT}, '.')), ''), 'none') AS extension, count(*) AS files
  FROM named WHERE {_KEEP} GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY files DESC, extension) AS place FROM ext)
SELECT CASE WHEN place <= 6 THEN extension ELSE 'other' END AS extension, CAST(sum(files) AS BIGINT) AS files FROM placed GROUP BY 1""")
def extension_histogram(spark, sf):
    """A1"""
    return files.extension_histogram(catalog(spark, sf))


_IND_MAP = """ind_map AS (SELECT code, arg_min(topic, (sheet, "row")) FILTER (WHERE topic IS NOT NULL) AS topic,
  arg_min(indicator, (sheet, "row")) FILTER (WHERE indicator IS NOT NULL) AS indicator FROM coded WHERE code IS NOT NULL GROUP BY code)"""


@query(f"""WITH {t.CHECKLIST}, {_IND_MAP} SELECT * FROM ind_map""")
def checklist_indicator_map(spark, sf):
    """S3 N4 G1 G2 G3"""
    return checklist.indicator_map(checklist.checklist_rows(t.checklist_grid(spark, sf)))


@query(f"""WITH {t.CHECKLIST}, twice AS (SELECT code FROM coded WHERE code IS NOT NULL GROUP BY code HAVING count(*) > 1)
SELECT count(*) AS rows_scanned, count(code) AS rows_used, count(DISTINCT code) AS mapping_size,
  (SELECT count(*) FROM twice) AS duplicate_codes,
  (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT code FROM twice ORDER BY code LIMIT 20)) AS duplicates_sample FROM coded""")
def checklist_load_stats(spark, sf):
    """A11"""
    rows = checklist.load_stats(checklist.checklist_rows(t.checklist_grid(spark, sf)))
    return rows.withColumn("duplicates_sample", F.array_join("duplicates_sample", ","))


@query(f"""WITH {t.CHECKLIST} SELECT own AS code, substr(own, 1, 1) AS dim_prefix, regexp_extract(own, '^([A-Z]+)', 1) AS sub_prefix,
  coalesce(topic, '') AS topic, coalesce(indicator, '') AS indicator, requirement, coalesce(department, '') AS department,
  coalesce(remark, '') AS remark, sheet, "row", row_number() OVER (ORDER BY regexp_extract(own, '^([A-Z]+)', 1),
    CAST(regexp_extract(own, '([0-9]+)$', 1) AS INTEGER), own, sheet, "row") AS place FROM coded WHERE own IS NOT NULL""")
def indicator_rows_in_code_order(spark, sf):
    """S4 L6"""
    from ..functions.codes import natural_order
    from ..operators.ranking import global_rank

    rows = checklist.indicators(checklist.checklist_rows(t.checklist_grid(spark, sf)))
    return global_rank(rows, [], [*natural_order("code"), F.col("sheet"), F.col("row")], "place")


@query(f"""WITH {t.CHECKLIST}, full_rows AS (SELECT own AS code, coalesce(topic, '') AS topic, coalesce(indicator, '') AS indicator, requirement, sheet, "row"
  FROM coded WHERE own IS NOT NULL)
SELECT code, arg_max(topic, (sheet, "row")) AS topic, arg_max(indicator, (sheet, "row")) AS indicator,
  arg_max(requirement, (sheet, "row")) AS requirement FROM full_rows GROUP BY code""")
def indicator_details(spark, sf):
    """S5"""
    return checklist.indicator_details(checklist.indicators(checklist.checklist_rows(t.checklist_grid(spark, sf))))


@query(f"""WITH {t.FRAMEWORK} SELECT * FROM framework""")
def framework_rows(spark, sf):
    """S6 G1 G2 G3"""
    return checklist.framework(t.framework_grid(spark, sf)).drop("sheet")


@query(f"""WITH {t.FRAMEWORK} SELECT * FROM leaves""")
def chapter_leaves(spark, sf):
    """F35"""
    return t.leaf_rows(spark, sf)


@query(f"""WITH {t.FRAMEWORK} SELECT l1, count(*) AS leaves, min("row") AS first_row FROM leaves GROUP BY l1""")
def leaves_per_first_level(spark, sf):
    """A12"""
    return checklist.leaves_per_first_level(t.leaf_rows(spark, sf))


@query(f"""WITH {t.FRAMEWORK}, {t.CHECKLIST}, a AS (SELECT DISTINCT code FROM framework WHERE code IS NOT NULL),
b AS (SELECT DISTINCT code FROM coded WHERE code IS NOT NULL)
SELECT code, 'framework' AS only_in FROM a WHERE code NOT IN (SELECT code FROM b)
UNION ALL SELECT code, 'checklist' FROM b WHERE code NOT IN (SELECT code FROM a)""")
def code_reconciliation(spark, sf):
    """N5 X2"""
    rows = checklist.checklist_rows(t.checklist_grid(spark, sf))
    return checklist.reconcile_codes(checklist.framework(t.framework_grid(spark, sf)), rows)


@query(f"""WITH {t.CHECKLIST}, d AS (SELECT own AS code, arg_max(requirement, (sheet, "row")) AS requirement FROM coded WHERE own IS NOT NULL GROUP BY own)
SELECT count(*) AS indicators, count(*) FILTER (WHERE trim(coalesce(requirement, '')) <> '') AS with_requirement FROM d""")
def requirement_counts(spark, sf):
    """A1"""
    return checklist.non_empty_requirements(indicator_details(spark, sf))


@query(f"""{_WITH}, {_IND_MAP}, best2 AS (SELECT f.relative_path, b.code, b.part, b.depth FROM files f LEFT JOIN
  (SELECT relative_path, code, part, depth FROM found LEFT JOIN (SELECT code, 1 AS listed FROM ind_map) USING (code)
   QUALIFY row_number() OVER (PARTITION BY relative_path ORDER BY coalesce(listed, 0) DESC, depth DESC, pos DESC) = 1) b USING (relative_path)),
shown AS (SELECT b.*, file_name, parts, list_filter(parts, lambda p: upper(p) = regexp_extract(code, '^([A-Z]+)', 1)) AS same
  FROM (SELECT *, string_split(relative_path, '/') AS parts, string_split(relative_path, '/')[-1] AS file_name FROM (SELECT DISTINCT * FROM best2)) b),
foldered AS (SELECT *, CASE WHEN code IS NULL THEN CASE WHEN len(parts) > 1 THEN parts[1] ELSE '根目录文件' END
  WHEN len(same) > 0 THEN same[-1] WHEN depth = len(parts) THEN CASE WHEN depth > 1 THEN parts[depth - 1] ELSE '根目录文件' END
  ELSE part END AS folder FROM shown)
SELECT s.relative_path, file_name, s.code, folder, '[' || coalesce(s.code, folder) || '] ' || file_name AS tagged_name,
  topic, indicator FROM foldered s JOIN files f USING (relative_path) LEFT JOIN ind_map m ON s.code = m.code
WHERE NOT regexp_matches(file_name, '^[.~]')""")
def file_inventory(spark, sf):
    """S2 N2; equal paths share their numbers' range, so numbers are dropped here"""
    indicators = checklist.indicator_map(checklist.checklist_rows(t.checklist_grid(spark, sf)))
    return files.inventory(t.files(spark, sf).select("relative_path"), indicators).drop("number")


@query(f"""WITH numbered AS (SELECT p_partkey, p_name || '#' || p_partkey AS relative_path FROM part)
SELECT relative_path, row_number() OVER (ORDER BY relative_path) AS number FROM numbered""")
def running_numbers(spark, sf):
    """Running number of files in path order"""
    from ..operators.ranking import global_rank

    path = F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))
    return global_rank(table(spark, sf, "part").select(path.alias("relative_path")), [], [F.col("relative_path")], "number")


_PLAN = f"""{_WITH}, parts AS (SELECT *, string_split(relative_path, '/')[1:-2] AS folders FROM named WHERE {_KEEP}),
picked AS (SELECT *, list_transform(list_filter(folders, lambda p: regexp_full_match(upper(trim(p)), '[AGEDS][A-Z]{{0,3}}[0-9]{{1,3}}')), lambda p: upper(trim(p))) AS pure,
  flatten(list_transform(list_reverse(list_filter(folders, lambda p: NOT regexp_full_match(upper(trim(p)), '[AGEDS][A-Z]{{0,3}}[0-9]{{1,3}}'))), lambda p: {_CODES_OF.format('p')})) AS loose,
  regexp_extract(upper(file_name), '([AGEDS][A-Z]{{0,3}})1、2,3', 1) AS spelled, {_CODES_OF.format('file_name')} AS plain FROM parts),
coded_files AS (SELECT relative_path, file_name, pos, CASE WHEN len(pure) > 0 THEN pure[1:1] WHEN len(loose) > 0 THEN {{loose}}[1:3]
  ELSE {{name}}[1:3] END AS codes FROM picked)"""
_UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_NAMES = "(CASE WHEN spelled <> '' THEN [spelled || '1', spelled || '2', spelled || '3'] ELSE [] END || plain)"
_PLAN = _PLAN.replace("{loose}", _UNIQ.format("loose")).replace("{name}", _UNIQ.format(_NAMES))

_TARGET_DIM = "CASE substr(sub, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in fixed.DIMENSIONS) + " END"
_TARGET_TOPIC = "CASE sub " + " ".join(f"WHEN '{k}' THEN '{f}'" for k, f in fixed.TOPIC_FOLDERS) + " ELSE sub || '-议题' END"
_PLANNED = f"""{_PLAN}, opened AS (SELECT relative_path, file_name, unnest(codes) AS code FROM coded_files
  UNION ALL SELECT relative_path, file_name, NULL FROM coded_files WHERE len(codes) = 0),
planned AS (SELECT relative_path, file_name, code, CASE WHEN code IS NOT NULL THEN CASE WHEN substr(sub, 1, 1) = 'A' THEN {_TARGET_DIM} || '/' || code
    ELSE {_TARGET_DIM} || '/' || {_TARGET_TOPIC} || '/' || code END END AS target
  FROM (SELECT *, regexp_extract(code, '^([A-Z]+)', 1) AS sub FROM opened)),
plan AS (SELECT *, row_number() OVER (PARTITION BY target, file_name ORDER BY relative_path) > 1 AS duplicate FROM planned)"""


@query(f"{_PLANNED} SELECT relative_path, file_name, code, target, duplicate FROM plan")
def sorting_plan(spark, sf):
    """N3"""
    return files.sorting_plan(t.files(spark, sf))


@query(f"""{_PLANNED} SELECT code, count(*) AS files FROM plan WHERE code IS NOT NULL AND NOT duplicate GROUP BY code ORDER BY code LIMIT 20""")
def sorting_plan_counts(spark, sf):
    """A17"""
    return files.plan_counts(files.sorting_plan(t.files(spark, sf)))


@query(f"""{_PLANNED} SELECT relative_path FROM plan WHERE code IS NULL ORDER BY relative_path LIMIT 30""")
def sorting_plan_unidentified(spark, sf):
    """A17"""
    return files.plan_unidentified(files.sorting_plan(t.files(spark, sf)))


@query("""WITH top AS (SELECT o_custkey // 3 AS sheet, o_orderkey FROM orders)
SELECT c.n AS sheet, c.r AS "row", c.c AS col, CASE WHEN c.r BETWEEN 1 AND 2 AND c.c <= 1 THEN a.c_name
  WHEN c.c = 0 THEN c2.c_name END AS value
FROM (SELECT c_custkey AS n, unnest([0, 1, 2, 3]) AS r FROM customer) x, LATERAL (SELECT x.n, x.r, unnest([0, 1]) AS c) c
JOIN customer a ON a.c_custkey = c.n JOIN customer c2 ON c2.c_custkey = c.n""")
def merged_cells(spark, sf):
    """One sheet per customer; a merged 2x2 range from row 1"""
    c = table(spark, sf, "customer")
    cells = c.select(F.col("c_custkey").alias("sheet"), "c_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row"))
    cells = cells.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(1)))).select(
        "sheet", "row", "col", F.when(F.col("col") == 0, F.col("c_name")).alias("value"))
    merged = c.select(F.col("c_custkey").alias("sheet"), F.lit(1).alias("row1"), F.lit(0).alias("col1"),
                      F.lit(2).alias("row2"), F.lit(1).alias("col2"))
    return grid.flatten_merged(cells, merged)


@query("""WITH cells AS (SELECT l_orderkey, l_linenumber, l_returnflag || chr(9) || l_linestatus ||
  CASE WHEN l_linenumber % 2 = 0 THEN chr(9) || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE '' END AS line, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey AS doc_id, md5(string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey)) AS text FROM
 (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM cells) GROUP BY l_orderkey""")
def sheet_text(spark, sf):
    """An order as a sheet, its lines as rows, some cells blank"""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").withColumn("row", F.row_number().over(order))
    values = F.array("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") % 2 == 0,
                     F.col("l_quantity").cast("int").cast("string")).otherwise(" "))
    cells = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit("s").alias("sheet"), "row",
                        F.posexplode(values).alias("col", "value"))
    return grid.sheets_to_text(cells).select("doc_id", F.md5("text").alias("text"))


@query("""SELECT s_nationkey AS table_id, md5(string_agg(s_name || chr(9) || CAST(s_suppkey AS VARCHAR), chr(10) ORDER BY s_suppkey)) AS text FROM supplier GROUP BY 1""")
def table_text_with_merged_cells(spark, sf):
    """The second column repeats the first cell"""
    s = table(spark, sf, "supplier")
    cells = s.select(F.col("s_nationkey").alias("table_id"), F.col("s_suppkey").alias("row"), F.posexplode(F.array(
        F.struct(F.lit("a").alias("id"), F.col("s_name").alias("text")), F.struct(F.lit("a").alias("id"), F.col("s_name").alias("text")),
        F.struct(F.lit("b").alias("id"), F.col("s_suppkey").cast("string").alias("text")))).alias("col", "c"))
    rows = cells.select("table_id", "row", "col", F.col("c.id").alias("cell_id"), F.col("c.text").alias("text"))
    return grid.tables_to_text(rows).select("table_id", F.md5("text").alias("text"))


@query("""SELECT event_id, CAST(ts AS DATE) AS dt FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def newest_dated_table(spark, sf):
    """S9"""
    return stages.newest(table(spark, sf, "events").select("event_id", F.to_date("ts").alias("dt")))
