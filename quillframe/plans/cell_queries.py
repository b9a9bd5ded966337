"""Driver queries over form relations: each applies form operators to a whole relation, beside the same in DuckDB's SQL.

The relations are made from the driver's orders, so that both engines build them alike: eight orders are the rows of a document's table,
a row has one to five cells, and each cell's text is one of TEXTS by a fixed rule (every third row has blanks between its texts).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import errors
from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators import cells as C
from quillframe.operators import expand, extract, fields, fill, reports, state, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TEXTS = [
    "", " ", "课程名称", "课程名称：数学", "教师姓名", "教师姓名:李明\n职称：教授", "12", "3.5", "--", "%", "……", "xxx", "yyyy", "请填写", "请填写本课程的目标", "备注", "序号", "题号",
    "得分", "选修", "必修", "闭  卷", "开卷", "试题库", "优秀", "√", "☑", "有", "合格", "是", "否", "年 月 日", "年　月　日上午", "2024年5月6日", "日期：年 月 日", "（请在此处填写课程的主要问题）",
    "□是□否□其他", "□", "一、基本信息", "二．考试方式", "试卷分析", "第一个比较长的标题用来说明这里没有标签", "实现途径:\n评价方法:", "平均分", "90-100", "人数", "a  b", "带　宽的", "___", "签名：",
    "审批意见|第二行：后文", "教研室:意见：后文", "A", "同行阅卷", "　前后　", "abc def", "第3列", "其他",
]
SPANS = "CASE WHEN (o_custkey + c) % 7 = 0 THEN 5 WHEN (o_custkey + c) % 5 = 0 THEN 2 ELSE 1 END"
MERGES = "CASE (o_custkey + 3 * c) % 11 WHEN 0 THEN '' WHEN 1 THEN 'continue' WHEN 2 THEN 'restart' END"
PLACE = f"CASE WHEN c % 2 = 1 AND o_custkey % 3 = 0 THEN 1 ELSE (o_orderkey * 31 + o_custkey * 7 + c * 13) % {len(TEXTS)} + 1 END"
TABLE = ["doc_id", "t"]
ROW = ["doc_id", "t", "r"]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words(x: list[str]) -> str:
    return "(" + ", ".join(map(quoted, x)) + ")"


def listed(x: list[str]) -> str:
    return "[" + ", ".join(map(quoted, x)) + "]"


_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)"


def stripped(x: str) -> str:
    return f"trim({x}, {_SPACES})"


def squeezed(x: str) -> str:
    return f"replace(replace({x}, ' ', ''), '　', '')"


def option(x: str, known: list[str] = V.OPTION_WORDS) -> str:
    return f"({x} IN {words(known)} OR {squeezed(x)} IN {words(known)})"


STRICT = "regexp_matches(x, '^年[\\s　]*月[\\s　]*日?[\\s　]*$')"
LOOSE = f"({STRICT} OR regexp_matches(x, '^年[\\s　]*月[\\s　]*日'))"
LABEL = (
    f"(x <> '' AND length(x) <= 15 AND NOT contains(x, '  ') AND NOT contains(x, '　') AND NOT regexp_matches(x, '[：:]') AND NOT regexp_matches(x, '^[0-9.]+$') "
    f"AND NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}\\p{{M}}_]+$') AND x NOT IN {words(V.LABEL_BLACKLIST + V.HEADER_WORDS)} AND NOT {option('x')} AND NOT {LOOSE})"
)
PROMPT = " OR ".join(f"starts_with(x, {quoted(p)})" for p in V.PROMPT_STARTS)
PLACEHOLDER = f"(x IN {words(V.PLACEHOLDER_TEXTS)} OR {STRICT} OR ({LOOSE} AND length(x) <= 50) OR {PROMPT} OR (starts_with(x, '（') AND length(x) > 10) OR (starts_with(x, '□') AND length(x) > 5))"
CELLS_SQL = f"""raw AS (SELECT 'D' || (o_orderkey // 8) AS doc_id, 0 AS t, (o_orderkey % 8)::INT AS r, c::INT AS c_unique, {listed(TEXTS)}[{PLACE}] AS text,
  {SPANS} AS grid_span, {MERGES} AS vmerge_raw FROM orders, range(0, 5) g(c) WHERE c <= o_custkey % 5),
cell AS (SELECT *, {stripped('text')} AS x FROM raw),
c AS (SELECT *, {LABEL} AS is_label, (x <> '' AND {option('x')}) AS is_option, {PLACEHOLDER} AS is_placeholder, coalesce(vmerge_raw IN ('', 'continue'), false) AS continues,
  (x = '' OR {PLACEHOLDER}) AS is_fillable FROM cell)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c")).filter("c <= o_custkey % 5")
    text = F.element_at(F.lit(TEXTS), F.expr(PLACE).cast("int"))
    rows = o.select(F.expr("'D' || (o_orderkey div 8)").alias("doc_id"), F.lit(0).alias("t"), F.expr("o_orderkey % 8").cast("int").alias("r"), F.col("c").alias("c_unique"), text.alias("text"), F.expr(SPANS).alias("grid_span"), F.expr(MERGES).alias("vmerge_raw"))
    return rows


def classified(spark: SparkSession, d: str) -> DataFrame:
    return C.classified(cells(spark, d))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


OLD = f"(v <> '' AND v NOT IN {words(V.OLD_PLACEHOLDERS)} AND NOT (length(v) <= 20 AND regexp_matches(v, '[：:]$')) AND NOT list_bool_and(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda y: {stripped('y')}), lambda y: y <> ''), lambda y: regexp_matches(y, '[：:]$'))))"
MARKED = " OR ".join(f"contains(text, {quoted(m)})" for m in V.PLACEHOLDER_TEXTS)


@query(f"""WITH {CELLS_SQL}
SELECT doc_id, r, c_unique, x, is_label, is_option, is_placeholder, is_fillable, continues, coalesce(vmerge_raw = '', false) AS fill_continues, coalesce(vmerge_raw <> 'restart', false) AS preview_continues,
  (x = '' OR x IN {words(V.PLACEHOLDER_TEXTS)}) AS preview_fillable, (SELECT {OLD} FROM (SELECT x AS v)) AS is_value, (x = '') AS blank_run,
  (regexp_matches(text, '年[\\s　]*月[\\s　]*日') OR {MARKED}) AS placeholder_run, {squeezed('x')} AS squeezed FROM c""")
def cell_predicates(spark, d):
    """PRD4, PRD5, PRD6, PRD7, PRD11, PRD13, STR1, STR2, DT1: what each cell is."""
    c, x = classified(spark, d), F.col("x")
    return c.select("doc_id", "r", "c_unique", "x", "is_label", "is_option", "is_placeholder", "is_fillable", "continues", C.continues(F.col("vmerge_raw"), "fill").alias("fill_continues"), C.continues(F.col("vmerge_raw"), "preview").alias("preview_continues"),
                    C.is_fillable_preview(x).alias("preview_fillable"), C.is_meaningful_value(F.col("text")).alias("is_value"), C.is_blank_run(F.col("text")).alias("blank_run"), C.is_placeholder_run(F.col("text")).alias("placeholder_run"), T.squeeze("x").alias("squeezed"))


_FIRST = "CASE WHEN contains(line, '：') THEN string_split(line, '：')[1] ELSE string_split(line, ':')[1] END"
ROLES_SQL = f"""agg AS (SELECT doc_id, t, r, count(*) AS n_cells, count(*) FILTER (x = '') AS n_empty, count(*) FILTER (regexp_matches(x, '[：:]')) AS n_colon,
  count(*) FILTER (length(x) BETWEEN 2 AND 8 AND NOT regexp_matches(x, '[：:]') AND x NOT IN {words(V.LABEL_BLACKLIST + V.OPTION_WORDS)}) AS n_short,
  count(*) FILTER (regexp_matches(x, '^[0-9]+$')) AS n_digits, sum(grid_span) AS row_span, arg_min(x, c_unique) AS sole, bool_or(is_placeholder) AS any_placeholder,
  string_agg(replace(x, chr(10), '|'), '/' ORDER BY c_unique) AS labels FROM c GROUP BY ALL),
lined AS (SELECT *, {stripped("string_split(replace(sole, chr(10), '|'), '|')[1]")} AS line FROM agg),
titled AS (SELECT *, {stripped(_FIRST)} AS first_line FROM lined),
marks AS (SELECT *, max(is_label::INT) OVER w AS seen, sum((is_label OR is_option)::INT) OVER w AS run, lag(is_fillable) OVER (PARTITION BY doc_id, t, r ORDER BY c_unique) AS prev FROM c WHERE NOT continues
  WINDOW w AS (PARTITION BY doc_id, t, r ORDER BY c_unique ROWS UNBOUNDED PRECEDING)),
runs AS (SELECT doc_id, t, r, run, count(*) FILTER (is_fillable AND seen = 1) AS fills, bool_or((is_label OR is_option) AND coalesce(prev, false)) AS alternates, max(seen) AS seen FROM marks GROUP BY ALL),
multi AS (SELECT doc_id, t, r, max(seen) = 1 AND max(fills) >= 2 AND NOT bool_or(alternates) AS is_multi_col FROM runs GROUP BY ALL),
roles AS (SELECT doc_id, t, r, n_cells, row_span, (n_cells = 1 AND (regexp_matches(sole, '^[{V.NUMERALS}]+[、.．]') OR sole IN {words(V.SECTION_TITLES)})) AS is_section_title,
  (n_empty >= n_cells * 0.5 AND n_colon = 0 AND n_short = 0 AND n_digits = 0) AS is_empty_row, (n_cells - n_empty >= n_cells * 0.6 AND n_colon = 0) AS is_header_row,
  CASE WHEN n_cells = 1 AND length(first_line) BETWEEN 2 AND 25 AND NOT any_placeholder THEN first_line END AS section_title, CASE WHEN n_cells = 1 AND length(sole) >= 2 THEN sole END AS one_cell_text,
  labels, coalesce(is_multi_col, false) AS is_multi_col FROM titled LEFT JOIN multi USING (doc_id, t, r))"""


@query(f"WITH {CELLS_SQL}, {ROLES_SQL} SELECT * FROM roles")
def row_roles(spark, d):
    """PRD1, PRD2, PRD3, PRD8, AGG11: what each row is."""
    return C.row_roles(classified(spark, d)).withColumn("labels", F.array_join("column_labels", "/")).drop("column_labels")


@query(f"""WITH {CELLS_SQL}, g AS (SELECT *, coalesce(sum(grid_span) OVER (PARTITION BY doc_id, t, r ORDER BY c_unique ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grid_start FROM c),
s AS (SELECT *, CASE WHEN coalesce(r - lag(r) OVER w > 1, false) THEN 1 ELSE (NOT coalesce(vmerge_raw <> 'restart', false))::INT END AS starts FROM g WINDOW w AS (PARTITION BY doc_id, t, grid_start ORDER BY r)),
n AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, t, grid_start ORDER BY r ROWS UNBOUNDED PRECEDING) AS grp FROM s)
SELECT doc_id, r, c_unique, grid_start, CASE WHEN vmerge_raw = 'restart' THEN count(*) OVER (PARTITION BY doc_id, t, grid_start, grp) WHEN vmerge_raw IS NULL THEN 1 END AS rowspan FROM n""")
def row_spans(spark, d):
    """WIN3, WIN7: grid columns and vertical spans."""
    c = C.with_grid_start(classified(spark, d).withColumn("tc_ord", F.col("c_unique")))
    return C.rowspans(c).select("doc_id", "r", "c_unique", "grid_start", "rowspan")


@query(f"""WITH {CELLS_SQL}, {ROLES_SQL},
a AS (SELECT *, list_filter([{', '.join(f"struct_pack(c := lead(c_unique, {i}) OVER w, x := lead(x, {i}) OVER w, fill := lead(is_fillable, {i}) OVER w, ph := lead(is_placeholder, {i}) OVER w, cont := lead(continues, {i}) OVER w)" for i in (1, 2, 3))}],
  lambda q: q.c IS NOT NULL AND NOT q.cont AND (q.fill OR q.x NOT IN {words(V.OPTION_WORDS)})) AS stops FROM c WINDOW w AS (PARTITION BY doc_id, t, r ORDER BY c_unique))
SELECT doc_id, 'T' || t || '_R' || r || '_C' || stops[1].c AS field_id, CASE WHEN stops[1].ph THEN 'replace' ELSE 'set' END AS fill_mode, x AS label, stops[1].x AS existing_value, '请填写' || x AS description
FROM a JOIN roles USING (doc_id, t, r) WHERE is_label AND stops[1].fill AND NOT is_section_title AND NOT is_multi_col""")
def label_blank_fields(spark, d):
    """FLD3, WIN6 (the next cells of a row as a window): a label and the blank after it."""
    c = classified(spark, d)
    none = spark.createDataFrame([], "doc_id string, t int, r int, label string")
    return fields.label_blank_fields(c, C.row_roles(c), none).select("doc_id", "field_id", "fill_mode", "label", "existing_value", "description")


@query(f"""WITH {CELLS_SQL}, {ROLES_SQL}, f AS (SELECT c.*, CASE WHEN {LOOSE} THEN CASE WHEN regexp_matches(x, '上午|下午') THEN '考试时间' ELSE '日期' END END AS name FROM c WHERE NOT continues)
SELECT doc_id, 'T' || t || '_R' || r || '_C' || arg_min(c_unique, c_unique) AS field_id, arg_min(name, c_unique) AS label FROM f JOIN roles USING (doc_id, t, r) WHERE name IS NOT NULL AND NOT is_section_title GROUP BY doc_id, t, r""")
def placeholder_fields(spark, d):
    """FLD4, SRT1: the first lone empty date of a row."""
    c = classified(spark, d)
    none = spark.createDataFrame([], "doc_id string, field_id string")
    return fields.placeholder_fields(c, C.row_roles(c), none).select("doc_id", "field_id", "label")


def _groups(known: list[str], continues: str) -> str:
    hit = f"(x <> '' AND {option('x', known)})"
    return f"""o AS (SELECT *, {hit} AS opt, lead(x) OVER w AS nx, (x <> '' AND NOT {hit} AND NOT {continues})::INT AS starts FROM c WINDOW w AS (PARTITION BY doc_id, t, r ORDER BY c_unique)),
p AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, t, r ORDER BY c_unique ROWS UNBOUNDED PRECEDING) AS grp FROM o WHERE nx IS NOT NULL),
grouped AS (SELECT doc_id, t, r, grp, max(x) FILTER (starts = 1) AS label, string_agg(CASE WHEN {squeezed('x')} IN {words(known)} THEN {squeezed('x')} ELSE x END, '/' ORDER BY c_unique) FILTER (opt AND nx = '') AS options FROM p GROUP BY ALL)"""


@query(f"""WITH {CELLS_SQL}, {ROLES_SQL}, {_groups(V.OPTION_WORDS, 'continues')},
up AS (SELECT doc_id, t, r, is_section_title, coalesce(lag(one_cell_text, 1) OVER w, lag(one_cell_text, 2) OVER w) AS above FROM roles WINDOW w AS (PARTITION BY doc_id, t ORDER BY r)),
one AS (SELECT * FROM grouped WHERE options IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, t, r ORDER BY grp) = 1)
SELECT doc_id, 'T' || t || '_R' || r || '_CHK' AS field_id, coalesce(label, regexp_replace({stripped("replace(above, chr(10), '')")}, '^[{V.NUMERALS}]+[、.．][\\s　]*', ''), '选项') AS label, options
FROM one JOIN up USING (doc_id, t, r) WHERE NOT is_section_title""")
def checkbox_fields(spark, d):
    """FLD5: a field a row with tick boxes."""
    c = classified(spark, d)
    out = fields.checkbox_fields(c, C.row_roles(c))
    return out.select("doc_id", "field_id", "label", F.regexp_extract("description", "可选值: (.*)）$", 1).alias("options"))


@query(f"""WITH {CELLS_SQL}, {ROLES_SQL}, {_groups(V.FILL_OPTION_WORDS, "coalesce(vmerge_raw = '', false)")},
wide AS (SELECT doc_id, t, r, arg_min(x, c_unique) AS wide FROM c WHERE grid_span >= {V.TITLE_SPAN} AND x <> '' GROUP BY ALL),
up AS (SELECT doc_id, t, r, coalesce(lag(w, 1) OVER k, lag(w, 2) OVER k) AS title FROM (SELECT doc_id, t, r, coalesce(wide, one_cell_text) AS w FROM roles LEFT JOIN wide USING (doc_id, t, r)) WINDOW k AS (PARTITION BY doc_id, t ORDER BY r))
SELECT doc_id, r, grp, label, options, title FROM grouped LEFT JOIN up USING (doc_id, t, r) WHERE options IS NOT NULL""")
def fill_checkbox_groups(spark, d):
    """FLD5b, JN17: groups of tick boxes as filling finds them."""
    c = classified(spark, d)
    out = fill.fill_groups(c, C.row_roles(c))
    return out.select("doc_id", "r", "grp", "label", F.array_join(F.transform("options", lambda o: o["o"]), "/").alias("options"), "title")


def _after(x: str) -> str:
    return f"CASE WHEN starts_with({x}, label) AND substr({x}, length(label) + 1, 1) IN ('：', ':', ' ') THEN {stripped(f'substr({x}, length(label) + 2)')} END"


_REST = f"coalesce({_after('x')}, list_filter(list_transform(string_split(x, chr(10)), lambda y: {_after(stripped('y'))}), lambda z: z IS NOT NULL)[1])"


@query(f"""WITH {CELLS_SQL}, m AS (SELECT doc_id, r, c_unique, x, ['append', 'set', 'replace', 'check'][(r + c_unique) % 4 + 1] AS mode, ['课程名称', '教师姓名', '职称', '签名'][(r % 4) + 1] AS label FROM c), s AS (SELECT *, {_REST} AS rest FROM m)
SELECT doc_id, r, c_unique, rest, CASE WHEN mode = 'append' THEN rest WHEN mode IN ('set', 'replace') THEN CASE WHEN rest <> '' AND rest <> label AND rest NOT IN {words(V.OLD_PLACEHOLDERS)} THEN rest END
  WHEN mode = 'check' AND x IN {words(V.CHECK_VALUES)} THEN x END AS value FROM s""")
def old_value_modes(spark, d):
    """CL2, STR4, EXT8: what an old report's cell says, by fill mode."""
    c = classified(spark, d).withColumns({"mode": F.element_at(F.lit(["append", "set", "replace", "check"]), (F.col("r") + F.col("c_unique")) % 4 + 1), "label": F.element_at(F.lit(["课程名称", "教师姓名", "职称", "签名"]), F.col("r") % 4 + 1)})
    return c.select("doc_id", "r", "c_unique", T.strip_label(F.col("x"), F.col("label")).alias("rest"), reports.value_by_mode(F.col("x"), F.col("label"), F.col("mode")).alias("value"))


_CUT = f"""CASE {' '.join(f"WHEN suffix(x, {quoted(e)}) AND length(x) > {len(e) + 2} THEN left(x, length(x) - {len(e)})" for e in ('审批意见', '审批', '意见'))} ELSE x END"""


@query(f"""WITH src AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, {listed(TEXTS)}[o_orderkey % {len(TEXTS)} + 1] AS x FROM orders)
SELECT o_orderkey, regexp_matches(x, '[0-9]{{4}}\\s*年\\s*[0-9]{{1,2}}\\s*月\\s*[0-9]{{1,2}}\\s*日') AS real_date, regexp_replace(x, '年[\\s　]*月[\\s　]*日', '2024年5月6日') AS dated,
  'out/' || replace(x, ' ', '_') || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.docx' AS stamp, lower(regexp_extract('dir/' || x || '.' || CASE WHEN o_custkey % 2 = 0 THEN 'DocX' ELSE '' END, '[^./](\\.[^./]*)$', 1)) AS ext,
  CASE WHEN length(x) > 6 THEN left(x, 6) || '…' ELSE x END AS cut, coalesce(TRY_CAST({stripped('x')} AS DOUBLE), 0.0) AS number, CASE WHEN o_custkey % 3 > 0 THEN printf('%.1f%%', o_custkey % 7 * 100.0 / (o_custkey % 3)) END AS share,
  CASE WHEN length(x) <= 8 THEN x WHEN length({_CUT}) > 8 THEN regexp_replace({_CUT}, '(教学运行数据|管理部门)$', '') ELSE {_CUT} END AS section FROM src""")
def text_functions(spark, d):
    """DT2, DT3, SNK3, STR8, STR10, STR11, SRT7, MT4: functions of one text."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("x", F.element_at(F.lit(TEXTS), (F.col("o_orderkey") % len(TEXTS) + 1).cast("int")))
    x = F.col("x")
    path = F.concat(F.lit("dir/"), x, F.lit("."), F.when(F.col("o_custkey") % 2 == 0, "DocX").otherwise(""))
    return o.select("o_orderkey", T.is_real_date(x).alias("real_date"), T.replace_first_date_placeholder(x, F.lit("2024年5月6日")).alias("dated"), T.file_stamp(F.lit("out"), x, F.col("o_orderdate")).alias("stamp"), T.extension(path).alias("ext"),
                    T.truncated(x, 6, "…").alias("cut"), T.safe_number(x).alias("number"), T.percent(F.col("o_custkey") % 7, F.col("o_custkey") % 3).alias("share"), fields.short_section(x).alias("section"))


TAGS = ["body", "tbl", "tr", "tc", "p", "pPr", "r", "rPr", "t", "tblPr", "tblGrid", "trPr", "tcPr", "sectPr"]
_TAG = f"(o_orderkey * 5 + o_custkey * 3 + c) % {len(TAGS)} + 1"
_PARENT = f"(o_orderkey * 3 + o_custkey) % {len(TAGS)} + 1"
_PROPS = "o_custkey % 6 + c"
NODES_SQL = f"""nodes AS (SELECT 'D' || (o_orderkey // 8) AS doc_id, o_orderkey * 10 + c AS node_id, o_orderkey AS parent_id, {listed(TAGS)}[{_PARENT}] AS parent_tag, {listed(TAGS)}[{_TAG}] AS tag, c::INT AS ord FROM orders, range(0, 5) g(c)),
runs AS (SELECT 'D' || (o_orderkey // 8) AS doc_id, o_orderkey AS run, list_concat({listed(V.RUN_FORMATS)}[1 : o_custkey % 7], ['spacing', 'rFonts', 'color'][1 : o_custkey % 4]) AS rpr_tags FROM orders)"""
ORDERED = " UNION ALL ".join(
    f"SELECT doc_id, 'element_order' AS \"check\", 'error' AS severity, '{prop} after content in {parent} ' || parent_id AS detail FROM nodes WHERE parent_tag = '{parent}' GROUP BY doc_id, parent_id HAVING max(ord) FILTER (tag = '{prop}') > min(ord) FILTER (tag IN {words(later)})"
    for prop, parent, later in validate.ORDER_RULES
)


def document_issues(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("doc_id", F.expr("'D' || (o_orderkey div 8)"))
    each = o.select("doc_id", "o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("c"))
    tag = lambda at: F.element_at(F.lit(TAGS), F.expr(at).cast("int"))
    nodes = each.select("doc_id", F.expr("o_orderkey * 10 + c").alias("node_id"), F.col("o_orderkey").alias("parent_id"), tag(_PARENT).alias("parent_tag"), tag(_TAG).alias("tag"), F.col("c").alias("ord"))
    tags = F.concat(F.slice(F.lit(V.RUN_FORMATS), F.lit(1), (F.col("o_custkey") % 7).cast("int")), F.slice(F.lit(["spacing", "rFonts", "color"]), F.lit(1), (F.col("o_custkey") % 4).cast("int")))
    runs = o.select("doc_id", F.col("o_orderkey").alias("run"), tags.alias("rpr_tags"))
    # tables as wide and as long as some customers' keys
    grid = o.select("doc_id", F.lit(0).alias("t"), (F.col("o_custkey") % 250).cast("int").alias("r"), (F.col("o_custkey") % 40).cast("int").alias("grid_start"), F.lit(1).alias("grid_span"))
    return validate.issues(nodes, grid, runs, o.select("doc_id"))


ISSUES_SQL = f"""{NODES_SQL}, docs AS (SELECT DISTINCT doc_id FROM nodes), kinds AS (SELECT doc_id, count(*) FILTER (tag = 'body') AS bodies, count(*) FILTER (tag = 'tbl') AS tables FROM nodes GROUP BY 1),
dims AS (SELECT 'D' || (o_orderkey // 8) AS doc_id, max(o_custkey % 250) + 1 AS n_rows, max(o_custkey % 40) + 1 AS n_cols FROM orders GROUP BY 1),
last AS (SELECT doc_id, max(ord) FILTER (tag = 'sectPr') AS section_at, max(ord) AS ending FROM nodes WHERE parent_tag = 'body' GROUP BY 1),
issues AS (SELECT doc_id, 'structure' AS "check", 'error' AS severity, 'no body' AS detail FROM kinds WHERE bodies = 0
UNION ALL SELECT doc_id, 'structure', 'error', 'no table' FROM kinds WHERE bodies > 0 AND tables = 0
UNION ALL {ORDERED}
UNION ALL SELECT doc_id, 'cell_paragraph', 'error', 'cell ' || node_id || ' has no paragraph' FROM nodes n WHERE tag = 'tc' AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.tag = 'p' AND p.doc_id = n.doc_id AND p.parent_id = n.node_id)
UNION ALL SELECT doc_id, 'dimensions', 'warning', 'table 0: ' || n_rows || ' rows' FROM dims WHERE n_rows > {V.TABLE_ROWS}
UNION ALL SELECT doc_id, 'dimensions', 'warning', 'table 0: ' || n_cols || ' columns' FROM dims WHERE n_cols > {V.TABLE_COLUMNS}
UNION ALL SELECT doc_id, 'section_last', 'error', 'section properties are not last' FROM last WHERE section_at < ending
UNION ALL SELECT doc_id, 'direct_format', 'warning', 'run ' || run || ': ' || n || ' direct formats' FROM (SELECT *, len(list_filter(rpr_tags, lambda q: q IN {words(V.RUN_FORMATS)})) AS n FROM runs) WHERE n > {V.DIRECT_FORMATS})"""


@query(f"WITH {ISSUES_SQL} SELECT * FROM issues")
def structure_issues(spark, d):
    """VAL1-VAL4, VAL6-VAL8: violations of document trees."""
    return document_issues(spark, d)


@query(f"WITH {ISSUES_SQL} SELECT doc_id, count(i.doc_id) FILTER (severity = 'error') AS n_errors, count(i.doc_id) FILTER (severity = 'warning') AS n_warnings FROM docs LEFT JOIN issues i USING (doc_id) GROUP BY 1")
def document_verdicts(spark, d):
    """AGG12, VAL1: errors and warnings a document."""
    docs = spark.read.parquet(f"{d}/orders.parquet").select(F.expr("'D' || (o_orderkey div 8)").alias("doc_id")).distinct()
    return validate.verdicts(docs, document_issues(spark, d)).select("doc_id", "n_errors", "n_warnings")


ERRORS = ["ValueError", "JSONDecodeError", "UnicodeDecodeError", "FileNotFoundError", "ConnectionResetError", "KeyError", "IndexError", "TimeoutError", "ChildProcessError", "MemoryError", "RuntimeError", "NoSuchError"]
_CAUSES = {e: errors.category_of(t) for e, t in zip(ERRORS, [ValueError, errors.json.JSONDecodeError, UnicodeDecodeError, FileNotFoundError, ConnectionResetError, KeyError, IndexError, TimeoutError, ChildProcessError, MemoryError, RuntimeError, Exception])}
_CASE = lambda i: "CASE name " + " ".join(f"WHEN {quoted(e)} THEN {quoted(a[i])}" for e, a in _CAUSES.items()) + " END"


@query(f"SELECT event_id, name, {_CASE(0)} AS category, {_CASE(1)} || '（' || event_type || '）' AS message FROM (SELECT *, {listed(ERRORS)}[event_id % {len(ERRORS)} + 1] AS name FROM events)")
def error_categories(spark, d):
    """EX1, UDF2: category and message of recorded errors."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("name", F.element_at(F.lit(ERRORS), (F.col("event_id") % len(ERRORS) + 1).cast("int")))
    return e.select("event_id", "name", errors.error_name(F.col("name"), F.col("event_type")).alias("e")).select("event_id", "name", "e.*")


_FORM = "form AS (SELECT 'f' || p AS field_id, p_brand AS label, p::INT AS ord FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS p FROM (SELECT DISTINCT p_brand FROM part)))"
_STATES = f"""{_FORM}, n AS (SELECT count(*) AS n FROM form), folded AS (SELECT 'S' || user_id AS session_id, 'f' || (event_id % (SELECT n FROM n)) AS field_id, max(value) AS confidence,
  CASE WHEN max(value) > 400 THEN 'confirmed' ELSE 'filled' END AS status FROM events GROUP BY 1, 2),
grid AS (SELECT session_id, field_id, label, ord, confidence, coalesce(status, 'empty') AS status FROM (SELECT DISTINCT session_id FROM folded) CROSS JOIN form LEFT JOIN folded USING (session_id, field_id))"""


def _session_states(spark: SparkSession, d: str) -> DataFrame:
    brands = spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct()
    form = brands.select(F.col("p_brand").alias("label"), (F.row_number().over(C.W.orderBy("p_brand")) - 1).alias("ord")).withColumn("field_id", F.concat(F.lit("f"), "ord"))
    n = form.count()
    folded = spark.read.parquet(f"{d}/events.parquet").groupBy(F.concat(F.lit("S"), "user_id").alias("session_id"), F.concat(F.lit("f"), (F.col("event_id") % n).cast("string")).alias("field_id")).agg(F.max("value").alias("confidence"))
    folded = folded.withColumns({"status": F.when(F.col("confidence") > 400, "confirmed").otherwise("filled"), "value": F.lit("v")})
    return state.form_state(form, folded)


@query(f"WITH {_STATES} SELECT session_id, field_id, label, ord, confidence, status FROM grid")
def session_states(spark, d):
    """STM1, JS3: every field of every session with its state, through the state's JSON text and back."""
    return state.from_json(state.as_json(_session_states(spark, d))).select("session_id", "field_id", "label", "ord", "confidence", "status")


@query(f"WITH {_STATES} SELECT session_id, field_id, label, ord FROM grid WHERE status = 'empty'")
def missing_fields(spark, d):
    """STM4: what a session still lacks."""
    return state.missing(_session_states(spark, d)).select("session_id", "field_id", "label", "ord")


@query(f"""WITH {_STATES}, writes AS (SELECT DISTINCT 'S' || user_id AS session_id, 'f' || (event_id % (SELECT n + 3 FROM n)) AS field_id FROM events)
SELECT w.session_id, w.field_id, CASE WHEN g.status IS NULL THEN 'unmatched' WHEN g.status = 'confirmed' THEN 'skipped' ELSE 'matched' END AS outcome FROM writes w LEFT JOIN grid g USING (session_id, field_id)""")
def write_outcomes(spark, d):
    """SET4: which writes match a field, which are skipped, which match none."""
    n = spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct().count()
    writes = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("S"), "user_id").alias("session_id"), F.concat(F.lit("f"), (F.col("event_id") % (n + 3)).cast("string")).alias("field_id")).distinct()
    return state.split_keys(writes, _session_states(spark, d)).select("session_id", "field_id", "outcome")


_ALIASES = ", ".join(f"({quoted(k)}, {i + 1}, {quoted(a)})" for k, v in V.ALIASES.items() for i, a in enumerate(v))


@query(f"WITH {CELLS_SQL}, own AS (SELECT DISTINCT x AS label FROM c WHERE x <> ''), alias(label, term_ord, term) AS (VALUES {_ALIASES}) SELECT label, 0 AS term_ord, label AS term FROM own UNION ALL SELECT own.label, term_ord, term FROM own JOIN alias USING (label)")
def search_terms(spark, d):
    """MP1: a label's own name, then its aliases."""
    return extract.search_terms(spark, classified(spark, d).filter("x <> ''").select(F.col("x").alias("label")))


_NAME = f"coalesce(nullif({stripped('raw_label')}, ''), {stripped('label')})"


@query(f"""WITH {CELLS_SQL}, f AS (SELECT doc_id, 'f' || r || '_' || c_unique AS field_id, text AS raw_label, x || '签' AS label FROM c), n AS (SELECT doc_id, field_id, {_NAME} AS label FROM f)
SELECT doc_id, field_id, label, CASE WHEN regexp_matches(label, '签字|签名') THEN '签名' WHEN contains(label, '日期') THEN '日期' WHEN regexp_matches(label, '百分比|比例|率') THEN '百分比' END AS hint FROM n WHERE label <> ''""")
def user_views(spark, d):
    """PRJ1, PRJ2: what a user sees of each field."""
    f = classified(spark, d).select("doc_id", F.concat(F.lit("f"), "r", F.lit("_"), "c_unique").alias("field_id"), F.col("text").alias("raw_label"), F.concat("x", F.lit("签")).alias("label"), F.lit("set").alias("fill_mode"), F.lit(0).alias("ord"))
    return expand.user_view(f).select("doc_id", "field_id", "label", "hint")


_EDIT = """e AS (SELECT doc_id, 'F' || r || '_' || c_unique AS field_id, x AS label, r, c_unique, CASE WHEN is_placeholder THEN 'replace' ELSE 'set' END AS op FROM c WHERE x <> ''),
v AS (SELECT doc_id, CASE WHEN r % 2 = 0 THEN 'F' || r || '_' || c_unique ELSE x END AS key, CASE WHEN c_unique = 3 THEN ' ' ELSE 'v' || r END AS value FROM c WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN r % 2 = 0 THEN 'F' || r || '_' || c_unique ELSE x END ORDER BY r, c_unique) = 1),
hits AS (SELECT e.*, v.value, 0 AS tier FROM e JOIN v ON e.doc_id = v.doc_id AND e.field_id = v.key WHERE trim(value) <> '' UNION ALL SELECT e.*, v.value, 1 FROM e JOIN v ON e.doc_id = v.doc_id AND e.label = v.key WHERE trim(value) <> '')"""


@query(f"WITH {CELLS_SQL}, {_EDIT} SELECT doc_id, arg_min(r, tier) AS r, arg_min(c_unique, tier) AS c, arg_min(op, tier) AS op, arg_min(label, tier) AS label, arg_min(value, tier) AS value FROM hits GROUP BY doc_id, field_id")
def label_edits(spark, d):
    """FIL3, FIL10, JN16: a cell edit for each field that has a value, by id, else by label."""
    c = classified(spark, d).filter("x <> ''")
    f = c.select("doc_id", F.concat(F.lit("F"), "r", F.lit("_"), "c_unique").alias("field_id"), F.lit("label_blank").alias("pattern"), F.when(F.col("is_placeholder"), "replace").otherwise("set").alias("fill_mode"), "t", F.array("r").alias("row_indices"), F.col("c_unique").alias("c"), F.col("x").alias("label"), F.lit(None).cast("string").alias("raw_label"), F.lit("").alias("existing_value"))
    key = F.when(F.col("r") % 2 == 0, F.concat(F.lit("F"), "r", F.lit("_"), "c_unique")).otherwise(F.col("x"))
    value = F.when(F.col("c_unique") == 3, " ").otherwise(F.concat(F.lit("v"), "r"))
    v = c.select("doc_id", key.alias("label"), value.alias("value"), "r", "c_unique").withColumn("n", F.row_number().over(C.W.partitionBy("doc_id", "label").orderBy("r", "c_unique"))).filter("n = 1")
    return fill.label_edits(f, v).select("doc_id", "r", "c", "op", "label", "value")
