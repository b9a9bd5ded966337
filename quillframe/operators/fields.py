"""Field detection over the ``cell`` relation (FLD1-FLD9, JN5-JN14, AGG1, SRT1): tables in, fields and row groups out.

Rules run in phases, as fields of one phase keep later ones away: colon (1), then by row label and blank, lone placeholder,
tick boxes (2), multi-column rows (3), underlined blanks of paragraphs (4). The order of emission is a column.

Multi-column labels depend on which labels of the same table came before, so that phase is a fold over one table's
candidate rows (``applyInPandas`` by (doc_id, t): a table is a bounded group); all other phases are joins and windows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators import relational as R
from quillframe.operators.cells import ROW, TABLE, classified, row_roles
from quillframe.session import checkpointed

FIELD = (
    "doc_id string, field_id string, pattern string, fill_mode string, t int, r int, c int, line int, label string, raw_label string, "
    "existing_value string, description string, section_context string, emit_ord array<int>"
)
NAMES = [f.split()[0] for f in FIELD.split(", ")]


def _field(df: DataFrame, **columns) -> DataFrame:
    blank = {"line": F.lit(0), "raw_label": F.lit(None).cast("string"), "section_context": F.lit(None).cast("string"), "existing_value": F.lit("")}
    out = {**blank, **columns}
    kinds = dict(f.split() for f in FIELD.split(", "))
    return df.select("doc_id", *[(out[n] if n in out else F.col(n)).cast(kinds[n]).alias(n) for n in NAMES if n != "doc_id"])


def _ord(phase: int, *rest):
    return F.array(F.col("t").cast("int"), F.lit(phase), *[r.cast("int") for r in rest])


def colon_labels(c: DataFrame) -> DataFrame:
    """FLD1: labels of a cell, line by line: around colons, before an empty date, before a bracketed hint."""
    lines = c.select(*ROW, "c_unique", F.posexplode(F.split("x", "\n")).alias("n", "raw")).withColumn("s", T.strip("raw")).filter("s <> ''")
    s = F.col("s")
    parts = F.split("s", "[：:]")
    last = F.size(parts) - 1
    # every colon's left side, but for the stop after the last pair but one: the reader stops at the last colon
    pairs = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("i"), T.strip(F.get(parts, i)).alias("before"), T.strip(F.get(parts, i + 1)).alias("after")))
    words = lambda b: F.split(b, r"[\s　]+")
    tail = lambda b: F.element_at(words(b), -1)
    short = lambda b: F.when((F.length(b) > 15) & (F.size(words(b)) >= 2) & F.length(tail(b)).between(1, 15), tail(b)).otherwise(b)
    dated = lambda v: F.regexp_extract(v, r"(?s)^(.*年[\s　]*月[\s　]*日)", 1)
    value = lambda v: F.when((F.length(v) > 20) & (dated(v) != ""), dated(v)).otherwise(v)
    by_colon = F.filter(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), short(p["before"]).alias("label"), value(p["after"]).alias("value"))), lambda p: F.length(p["label"]).between(1, 20))
    date = r"^(.+?)[\s　]*年[\s　]*月[\s　]*日(?:[\s　]*(?:上午|下午|上|下))?[\s　]*$"
    hint = r"^(.+?)（[^）]{2,}）[\s　]*$"
    name = T.strip(F.regexp_extract(s, date, 1))
    one = lambda label, v: F.array(F.struct(F.lit(0).alias("i"), label.alias("label"), v.alias("value")))
    found = (
        F.when(s.rlike("[：:]"), by_colon)
        .when(s.rlike(date), one(name, T.strip(F.substring(s, F.length(name) + 1, F.length(s)))))
        .when(s.rlike(hint), one(T.strip(F.regexp_extract(s, hint, 1)), s))
    )
    rows = lines.select(*ROW, "c_unique", "n", F.explode(found).alias("p"))
    w = W.partitionBy(*ROW, "c_unique").orderBy("n", "p.i")
    return rows.select(*ROW, "c_unique", F.col("p.label").alias("label"), F.col("p.value").alias("existing_value"), (F.row_number().over(w) - 1).alias("line"))


def short_section(title):
    """STR8: a title of over 8 characters loses its approval ending, then, if still that long, a standing ending."""
    cut = title
    for end in reversed(("审批意见", "审批", "意见")):
        cut = F.when(F.endswith(title, F.lit(end)) & (F.length(title) > len(end) + 2), F.left(title, F.length(title) - len(end))).otherwise(cut)
    shorter = cut
    for end in reversed(("教学运行数据", "管理部门")):
        shorter = F.when(F.endswith(cut, F.lit(end)), F.left(cut, F.length(cut) - len(end))).otherwise(shorter)
    return F.when(F.length(title) <= 8, title).when(F.length(cut) > 8, shorter).otherwise(cut)


# fixed values: labels that mean nothing without their section
SECTION_LABELS = ["负责人签名", "申请人签名", "签名", "日期", "审批意见"]


def colon_fields(c: DataFrame, rows: DataFrame) -> DataFrame:
    """FLD2: a field a label with a colon, with the section above as context."""
    context = R.last_before(rows.select(*ROW, "section_title", "is_section_title"), TABLE, "r", F.col("section_title").isNotNull(), F.col("section_title"), "section_context")
    found = colon_labels(c).join(context.filter("NOT is_section_title").select(*ROW, "section_context"), ROW).filter(F.length("label") <= 25)
    short, value, raw = short_section(F.col("section_context")), F.col("existing_value"), F.col("label")
    prefixed = F.col("section_context").isNotNull() & raw.isin(SECTION_LABELS)
    label = F.when(prefixed, F.concat(short, F.lit("-"), raw)).otherwise(raw)
    asked = F.when(prefixed, F.concat(F.lit("请填写"), short, F.lit("的"), raw)).otherwise(F.concat(F.lit("请填写"), raw))
    whole = T.is_date_placeholder(T.strip(value)) | value.rlike(r"^.+?（[^）]{2,}）[\s　]*$")
    return _field(
        found,
        field_id=F.format_string("T%d_R%d_C%d_L%d", "t", "r", "c_unique", "line"),
        pattern=F.lit("colon"),
        fill_mode=F.when(whole, "replace").otherwise("append"),
        c=F.col("c_unique"),
        label=label,
        raw_label=raw,
        line=F.col("line"),
        existing_value=value,
        description=F.when(value == "", asked).otherwise(F.concat(label, F.lit("(已有:"), value, F.lit(")"))),
        section_context=F.col("section_context"),
        emit_ord=_ord(1, F.col("r"), F.lit(0), F.col("c_unique"), F.col("line")),
    )


def label_blank_fields(c: DataFrame, rows: DataFrame, colon: DataFrame) -> DataFrame:
    """FLD3: a label and the first fillable of the next three cells, options and merged cells passed over (JN11 against colon fields)."""
    w = W.partitionBy(*ROW).orderBy("c_unique")
    ahead = F.array(*[F.struct(F.lead("c_unique", i).over(w).alias("c"), F.lead("x", i).over(w).alias("x"), F.lead("is_fillable", i).over(w).alias("fill"), F.lead("is_placeholder", i).over(w).alias("ph"), F.lead("continues", i).over(w).alias("cont")) for i in (1, 2, 3)])
    stops = F.filter(F.filter(ahead, lambda a: a["c"].isNotNull() & ~a["cont"]), lambda a: a["fill"] | ~a["x"].isin(V.OPTION_WORDS))
    found = c.withColumn("next", F.get(stops, F.lit(0))).filter("is_label AND next.fill")
    found = found.join(rows.filter("NOT is_section_title AND NOT is_multi_col").select(*ROW), ROW, "left_semi")
    known = colon.select("doc_id", "t", "r", F.col("label").alias("x"))
    found = found.join(known, [*ROW, "x"], "left_anti")
    return _field(
        found,
        field_id=F.format_string("T%d_R%d_C%d", "t", "r", "next.c"),
        pattern=F.lit("label_blank"),
        fill_mode=F.when(F.col("next.ph"), "replace").otherwise("set"),
        c=F.col("next.c"),
        label=F.col("x"),
        existing_value=F.col("next.x"),
        description=F.concat(F.lit("请填写"), "x"),
        emit_ord=_ord(2, F.col("r"), F.lit(0), F.col("c_unique")),
    )


def placeholder_fields(c: DataFrame, rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """FLD4: the first lone empty date of a row that no field has yet."""
    x = F.col("x")
    name = F.when(T.is_date_placeholder(x), F.when(x.rlike("上午|下午"), "考试时间").otherwise("日期"))
    found = c.filter("NOT continues").withColumn("name", name).filter("name IS NOT NULL").withColumn("field_id", F.format_string("T%d_R%d_C%d", "t", "r", "c_unique"))
    found = found.join(rows.filter("NOT is_section_title").select(*ROW), ROW, "left_semi").join(earlier.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_anti")
    found = R.first_rows(found, ROW, [F.col("c_unique")], 1)
    return _field(
        found, pattern=F.lit("standalone_placeholder"), fill_mode=F.lit("set"), c=F.col("c_unique"), label=F.col("name"), description=F.concat(F.lit("请填写"), "name"), emit_ord=_ord(2, F.col("r"), F.lit(1), F.col("c_unique"))
    )


def checkbox_groups(c: DataFrame, words: list[str] = V.OPTION_WORDS) -> DataFrame:
    """FLD5: groups of options followed by a blank; a text that is no option starts the next group. c has ``is_option`` by ``words``."""
    w = W.partitionBy(*ROW).orderBy("c_unique")
    s = c.withColumns({"next": F.lead("x").over(w), "starts": ((F.col("x") != "") & ~F.col("is_option") & ~F.col("continues")).cast("int")})
    s = s.filter("next IS NOT NULL").withColumn("grp", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    option = F.col("is_option") & (F.col("next") == "")
    name = F.when(T.squeeze("x").isin(words), T.squeeze("x")).otherwise(F.col("x"))
    grouped = s.groupBy(*ROW, "grp").agg(F.max(F.when(F.col("starts") == 1, F.col("x"))).alias("label"), F.array_sort(F.collect_list(F.when(option, F.struct("c_unique", name.alias("o"))))).alias("options"))
    return grouped.filter(F.size("options") > 0)


def checkbox_fields(c: DataFrame, rows: DataFrame) -> DataFrame:
    """FLD5: one field a row with tick boxes, named by its label or the one-cell row up to two rows above."""
    w = W.partitionBy(*TABLE).orderBy("r")
    above = rows.withColumn("above", F.coalesce(F.lag("one_cell_text", 1).over(w), F.lag("one_cell_text", 2).over(w))).select(*ROW, "above", "is_section_title")
    found = R.first_rows(checkbox_groups(c), ROW, [F.col("grp")], 1).join(above.filter("NOT is_section_title"), ROW)
    title = F.regexp_replace(T.strip(F.replace(F.col("above"), F.lit("\n"), F.lit(""))), rf"^[{V.NUMERALS}]+[、.．][\s　]*", "")
    label = F.coalesce("label", title, F.lit("选项"))
    shown = F.array_join(F.transform("options", lambda o: o["o"]), "/")
    return _field(
        found,
        field_id=F.format_string("T%d_R%d_CHK", "t", "r"),
        pattern=F.lit("checkbox"),
        fill_mode=F.lit("check"),
        c=F.lit(0),
        label=label,
        description=F.concat(F.lit("请选择"), label, F.lit("（可选值: "), shown, F.lit("）")),
        emit_ord=_ord(2, F.col("r"), F.lit(2), F.lit(0)),
    )


def column_headers(c: DataFrame) -> DataFrame:
    """JN10: header text of each grid column a non-empty cell of a row covers."""
    named = c.filter("x <> ''").select(*ROW, F.replace("x", F.lit("\n"), F.lit("")).alias("header"), "grid_start", "grid_span")
    return R.span_join(named, F.col("grid_start"), F.col("grid_span"), "g").select(*ROW, "g", "header")


def multi_column_candidates(c: DataFrame, rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """FLD6, JN7-JN9 up to naming: rows with two fillable cells or more, each cell with the header of the best row above."""
    covered = earlier.filter("pattern IN ('label_blank', 'colon')").select("doc_id", "t", "r", F.col("c").alias("c_unique"), F.lit(True).alias("covered"))
    ticks = earlier.filter("pattern = 'checkbox'").select(*ROW)
    live = c.filter("NOT continues").join(ticks, ROW, "left_anti").join(rows.filter("NOT is_section_title").select(*ROW), ROW, "left_semi")
    digits = F.col("x").rlike(r"(?U)^\d+$")
    first = F.min(F.when(F.col("is_label") | digits, F.col("c_unique"))).over(W.partitionBy(*ROW))
    named = live.withColumn("label_c", first)
    label = F.max(F.when(F.col("c_unique") == F.col("label_c"), F.when(digits, F.concat(F.lit("第"), "x", F.lit("题"))).otherwise(F.col("x")))).over(W.partitionBy(*ROW))
    named = named.withColumn("row_label", F.regexp_replace(label, r"[\n\r]", ""))
    fills = named.join(covered, [*ROW, "c_unique"], "left").filter("covered IS NULL AND is_fillable AND NOT is_option")
    n = F.count("*").over(W.partitionBy(*ROW))
    idx = F.row_number().over(W.partitionBy(*ROW).orderBy("c_unique")) - 1
    fills = fills.withColumns({"n": n, "idx": idx}).filter("n >= 2").select(*ROW, "c_unique", "grid_start", "x", "row_label", "n", "idx")
    above = rows.select("doc_id", "t", F.col("r").alias("r2"), "row_span")
    pairs = fills.join(above, TABLE).filter("r2 BETWEEN r - 9 AND r - 1 AND row_span >= n")
    usable = lambda h: h.isNotNull() & (h != "") & ~h.isin(V.PLACEHOLDER_TEXTS) & (F.length(h) <= 30)
    by_grid = column_headers(c).select("doc_id", "t", F.col("r").alias("r2"), F.col("g").alias("grid_start"), F.col("header").alias("h1"))
    by_place = c.select("doc_id", "t", F.col("r").alias("r2"), "c_unique", F.replace("x", F.lit("\n"), F.lit("")).alias("h2"))
    pairs = pairs.join(by_grid, [*TABLE, "r2", "grid_start"], "left").join(by_place, [*TABLE, "r2", "c_unique"], "left")
    pairs = pairs.withColumn("h", F.when(usable(F.col("h1")), F.col("h1")).when(usable(F.col("h2")), F.col("h2")))
    scored = pairs.groupBy(*ROW, "r2", "n").agg(F.count("h").alias("meaningful"))
    good = F.col("meaningful") >= F.col("n") * 0.5
    best = scored.groupBy(*ROW).agg(F.max_by("r2", F.struct(good.alias("g"), F.when(good, F.lit(0)).otherwise(F.col("meaningful")).alias("m"), "r2")).alias("r2"))
    headed = fills.join(best, ROW, "left").join(pairs.select(*ROW, "c_unique", "r2", "h"), [*ROW, "c_unique", "r2"], "left")
    col_label = F.coalesce("h", F.concat(F.lit("第"), (F.col("idx") + 1).cast("string"), F.lit("列")))
    w = W.partitionBy(*TABLE).orderBy("r")
    first_cell = c.filter("c_unique = 0").select(*ROW, F.when(F.col("is_label"), F.col("x")).alias("first_label"))
    up = rows.select(*ROW).join(first_cell, ROW, "left").withColumn("above_label", F.coalesce(F.lag("first_label", 1).over(w), F.lag("first_label", 2).over(w))).select(*ROW, "above_label")
    near = pairs.filter("r2 >= r - 7").groupBy(*ROW, "c_unique").agg(F.max_by(F.coalesce("h1", "h2"), F.when(F.coalesce("h1", "h2", F.lit("")) != "", F.col("r2"))).alias("specific"))
    return headed.join(up, ROW, "left").join(near, [*ROW, "c_unique"], "left").select(
        *ROW, "c_unique", "x", "row_label", "above_label", col_label.alias("col_label"), T.truncated(F.col("specific"), 20, "...").alias("specific"), "idx"
    )


def _name_multi_columns(frame: pd.DataFrame) -> pd.DataFrame:
    """One table's candidates in order: full labels, the first claim of a label in the table wins."""
    rows = frame.sort_values(["r", "c_unique"])
    taken = {x for x in rows["taken"].iloc[0]} if len(rows) else set()
    used_rows: set[int] = set()
    out = []
    for r, group in rows.groupby("r", sort=True):
        before = len([u for u in used_rows if u < r])
        for x in group.to_dict("records"):
            col, row_label, above = x["col_label"], x["row_label"], x["above_label"]
            title = re.compile(f"^[{V.NUMERALS}]+[、，]")
            if row_label:
                full = col if title.match(row_label) else f"{row_label}_{col}"
                text = f"请填写{row_label}的{col}"
            else:
                full = (col if title.match(above) else f"{above}_{col}") if above else f"第{before + 1}行_{col}"
                text = f"请填写{above}的{col}" if above and full == col else f"请填写{full}"
            if col.startswith("第") and "列" in col:
                text = (f"请填写{row_label}的{col}" if row_label else f"请填写{full}") + (f"(表头:{x['specific']})" if x["specific"] else "")
            if full in taken:
                continue
            taken.add(full)
            used_rows.add(r)
            out.append((x["doc_id"], x["t"], r, x["c_unique"], full, text, x["x"], x["idx"]))
    return pd.DataFrame(out, columns=["doc_id", "t", "r", "c_unique", "label", "description", "x", "idx"])


def multi_column_fields(c: DataFrame, rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """FLD6: row label and column label; labels are unique in a table."""
    taken = earlier.groupBy(*TABLE).agg(F.collect_set("label").alias("taken"))
    cand = multi_column_candidates(c, rows, earlier).join(taken, TABLE, "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    named = cand.groupBy(*TABLE).applyInPandas(_name_multi_columns, "doc_id string, t int, r int, c_unique int, label string, description string, x string, idx int")
    return _field(
        named,
        field_id=F.format_string("T%d_R%d_C%d", "t", "r", "c_unique"),
        pattern=F.lit("multi_col"),
        fill_mode=F.when(F.col("x") != "", "replace").otherwise("set"),
        c=F.col("c_unique"),
        existing_value=F.col("x"),
        emit_ord=_ord(3, F.col("r"), F.lit(0), F.col("c_unique")),
    )


def underline_fields(paragraphs: DataFrame, runs: DataFrame) -> DataFrame:
    """FLD7: body paragraphs with a label of 2 to 20 characters and an underlined blank."""
    body = runs.filter("scope = 'body'")
    blank = F.col("is_underline") & (T.strip(F.coalesce("text", F.lit(""))) == "")
    parts = F.array_sort(F.collect_list(F.when(~F.col("is_underline"), F.struct("run", "text"))))
    agg = body.groupBy("doc_id", "p").agg(F.bool_or(blank).alias("open"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("label"))
    agg = agg.withColumn("label", T.strip("label")).filter("open").filter(F.length("label").between(2, 20) & ~F.col("label").isin(V.LABEL_BLACKLIST) & ~T.is_option(F.col("label")))
    agg = agg.join(paragraphs.filter(T.strip(F.col("text")) != "").select("doc_id", "p"), ["doc_id", "p"], "left_semi").withColumn("t", F.lit(-1))
    return _field(
        agg, field_id=F.format_string("P%d", "p"), pattern=F.lit("paragraph_underline"), fill_mode=F.lit("paragraph_underline"), r=F.col("p"), c=F.lit(-1), description=F.concat(F.lit("请填写"), "label"), emit_ord=F.array(F.lit(1 << 30), F.lit(4), F.col("p").cast("int"))
    )


def row_groups(rows: DataFrame) -> DataFrame:
    """FLD8: maximal runs of empty rows of one cell count below the nearest header row; ids count the document's groups."""
    w = W.partitionBy(*TABLE).orderBy("r")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    head = rows.withColumn("header", F.last(F.when(F.col("is_header_row"), F.struct("r", "column_labels")), ignorenulls=True).over(before))
    runs = R.islands(head, TABLE, "r", ["is_empty_row", "n_cells", F.col("header").isNotNull()]).filter("is_empty_row AND header IS NOT NULL")
    agg = runs.groupBy(*TABLE, "island").agg(F.min("r").alias("start_row"), F.count("*").alias("template_row_count"), F.min_by("header", "r").alias("header"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("t", "start_row")) - 1
    labels = F.col("header.column_labels")
    return agg.select(
        "doc_id",
        F.format_string("T%d_G%d", F.col("t"), number).alias("group_id"),
        "t",
        "start_row",
        "template_row_count",
        F.col("header.r").alias("header_row_idx"),
        labels.alias("column_labels"),
        F.array_join(labels, " | ").alias("header_text"),
        F.size(labels).alias("num_cols"),
        (F.size(labels) > V.SIMPLE_GROUP_COLUMNS).alias("is_complex"),
    )


def consolidated(emitted: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG1, PRD9, JN12-JN14, SRT1: first emission a key with all its rows; filled fields, fields inside row groups and the losers of conflicts go."""
    section = F.coalesce("section_context", F.lit(""))
    row = F.when((section == "") & (F.col("pattern") == "multi_col"), F.col("r"))
    keyed = emitted.withColumns({"k_section": section, "k_row": row})
    occ = F.array_sort(F.collect_list(F.struct("emit_ord", "r")))
    first = keyed.groupBy("doc_id", "t", "c", "k_section", "k_row", "label").agg(F.min_by(F.struct(*NAMES), "emit_ord").alias("f"), F.transform(occ, lambda o: o["r"]).alias("row_indices"), F.count("*").alias("repeat_count"))
    fields = first.select("f.*", "row_indices", F.col("repeat_count").cast("int").alias("repeat_count"))
    many = F.col("repeat_count") > 1
    fields = fields.withColumn("description", F.when(many, F.concat(F.lit("请填写"), "label", F.lit(" (共"), F.col("repeat_count").cast("string"), F.lit("处)"))).otherwise(F.col("description")))
    fields = fields.filter((F.col("existing_value") == "") | (F.col("fill_mode") == "replace"))
    # rows of groups
    span = groups.select("doc_id", "t", "group_id", F.explode(F.sequence("start_row", (F.col("start_row") + F.col("template_row_count") - 1).cast("int"))).alias("r"))
    each = fields.select("doc_id", "field_id", "pattern", "t", "c", "emit_ord", F.posexplode("row_indices").alias("i", "r")).join(span, ROW, "left")
    inside = each.groupBy("doc_id", "field_id", "emit_ord").agg(F.bool_and(F.col("group_id").isNotNull()).alias("inside"), F.min_by("group_id", F.when(F.col("group_id").isNotNull(), F.col("i"))).alias("in_row_group"))
    fields = fields.join(inside, ["doc_id", "field_id", "emit_ord"]).filter("NOT inside").drop("inside")
    # a lone placeholder gives way to a multi-column field in one of its rows
    spread = fields.select("doc_id", "t", "field_id", "pattern", "c", "emit_ord", F.explode("row_indices").alias("r"))
    multi = spread.filter("pattern = 'multi_col'").select(*ROW, "c")
    losers = spread.filter("pattern = 'standalone_placeholder'").join(multi, ROW, "left_semi").select("doc_id", "field_id", "emit_ord")
    # an empty colon field gives way to a multi-column field right below
    below = multi.select("doc_id", "t", (F.col("r") - 1).alias("r"), "c")
    empty = fields.filter("pattern = 'colon' AND existing_value = ''").join(below, [*ROW, "c"], "left_semi").select("doc_id", "field_id", "emit_ord")
    fields = fields.join(losers.unionByName(empty), ["doc_id", "field_id", "emit_ord"], "left_anti")
    ordinal = F.row_number().over(W.partitionBy("doc_id").orderBy("t", F.array_min("row_indices"), "c", "emit_ord")) - 1
    return fields.withColumn("ord", ordinal)


def analyze(cells: DataFrame, paragraphs: DataFrame | None = None, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """FLD9: (fields, row groups) of every document in the ``cell`` relation.

    Cells, roles and the fields of each phase are read by several later phases, so each is checkpointed: it is computed once,
    survives lost executors, and keeps the plan of the next phase small.
    """
    kept = lambda df: checkpointed(cells.sparkSession, df)
    c = kept(classified(cells))
    rows = kept(row_roles(c))
    colon = kept(colon_fields(c, rows))
    blank = kept(label_blank_fields(c, rows, colon))
    lone = placeholder_fields(c, rows, colon.unionByName(blank))
    earlier = kept(colon.unionByName(blank).unionByName(lone).unionByName(checkbox_fields(c, rows)))
    emitted = earlier.unionByName(multi_column_fields(c, rows, earlier))
    if paragraphs is not None and runs is not None:
        emitted = emitted.unionByName(underline_fields(paragraphs, runs))
    groups = kept(row_groups(rows))
    return kept(consolidated(kept(emitted), groups)), groups


def summary(fields: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts a document: fields, groups, simple and complex groups."""
    f = fields.groupBy("doc_id").agg(F.count("*").alias("total_unique_labels"))
    g = groups.groupBy("doc_id").agg(F.count("*").alias("total_row_groups"), F.count_if(~F.col("is_complex")).alias("simple_row_groups"), F.count_if("is_complex").alias("complex_row_groups"))
    return f.join(g, "doc_id", "full_outer").fillna(0)
