"""Cell and row classifiers over the ``cell`` relation (PRD1-PRD13, WIN3-WIN5).

cell(doc_id, t, r, c_unique, c_expanded, tc_ord, grid_start, grid_span, vmerge_raw, origin_r, text, ...). Predicates are column
expressions, row roles one aggregation or window by (doc_id, t, r): a table's row is a bounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators import relational as R

TABLE = ["doc_id", "t"]
ROW = ["doc_id", "t", "r"]


def has_colon(x: Column) -> Column:
    return x.rlike("[：:]")


def is_label(x: Column) -> Column:
    """PRD4: 1 to 15 characters, no double or full-width space, no colon, no number or mark alone, no list word, no empty date."""
    return (
        (x != "")
        & (F.length(x) <= 15)
        & ~F.contains(x, F.lit("  "))
        & ~F.contains(x, F.lit("　"))
        & ~has_colon(x)
        & ~x.rlike(r"(?U)^[\d.]+$")
        & ~x.rlike(r"(?U)^[^\w]+$")
        & ~x.isin(V.LABEL_BLACKLIST + V.HEADER_WORDS)
        & ~T.is_option(x)
        & ~T.is_date_placeholder(x)
    )


def is_placeholder(x: Column) -> Column:
    """PRD5: a list mark, an empty date (loosely up to 50 characters), a prompt, a bracketed hint, a tick-box list."""
    prompt = F.lit(False)
    for start in V.PROMPT_STARTS:
        prompt = prompt | F.startswith(x, F.lit(start))
    return (
        x.isin(V.PLACEHOLDER_TEXTS)
        | T.is_date_placeholder(x, loose=False)
        | (T.is_date_placeholder(x) & (F.length(x) <= 50))
        | prompt
        | (F.startswith(x, F.lit("（")) & (F.length(x) > 10))
        | (F.startswith(x, F.lit("□")) & (F.length(x) > 5))
    )


def is_fillable_preview(x: Column) -> Column:
    """PRD7: blank, or a list mark."""
    return (x == "") | x.isin(V.PLACEHOLDER_TEXTS)


def continues(raw: Column, rule: str = "analyze") -> Column:
    """PRD6: whether a cell continues a vertical merge. raw is null for unmerged cells, else the attribute ("" if it has none).

    analyze: none or ``continue``; fill: none or empty; preview: anything but ``restart``.
    """
    return F.coalesce({"analyze": raw.isin("", "continue"), "fill": raw == "", "preview": raw != "restart"}[rule], F.lit(False))


def classified(cells: DataFrame) -> DataFrame:
    """One row a unique cell with its stripped text ``x`` and roles."""
    unique = cells.filter("c_unique IS NOT NULL").withColumn("x", T.strip(F.coalesce("text", F.lit(""))))
    x = F.col("x")
    return unique.withColumns(
        {"is_label": is_label(x), "is_option": (x != "") & T.is_option(x), "is_placeholder": is_placeholder(x), "continues": continues(F.col("vmerge_raw"))}
    ).withColumn("is_fillable", (F.col("x") == "") | F.col("is_placeholder"))


def is_meaningful_value(x: Column) -> Column:
    """PRD11: not blank, no placeholder of old reports, no short text that ends in a colon, not labels alone."""
    lines = F.filter(F.transform(F.split(x, "\n"), T.strip), lambda y: y != "")
    labels = F.forall(lines, lambda y: y.rlike("[：:]$"))
    return (T.strip(x) != "") & ~T.strip(x).isin(V.OLD_PLACEHOLDERS) & ~((F.length(T.strip(x)) <= 20) & T.strip(x).rlike("[：:]$")) & ~labels


def is_blank_run(x: Column) -> Column:
    return T.strip(F.coalesce(x, F.lit(""))) == ""


def is_placeholder_run(x: Column) -> Column:
    """PRD13: holds one of the placeholder marks or an empty date."""
    hit = x.rlike(r"年[\s　]*月[\s　]*日")
    for mark in V.PLACEHOLDER_TEXTS:
        hit = hit | F.contains(x, F.lit(mark))
    return F.coalesce(hit, F.lit(False))


def row_roles(c: DataFrame) -> DataFrame:
    """One row a table row: section title (PRD1), empty data row (PRD2), header row (PRD3), short title of a one-cell row (for JN5),
    multi-column data row (PRD8), texts and cell count."""
    x = F.col("x")
    short = (F.length(x).between(2, 8)) & ~has_colon(x) & ~x.isin(V.LABEL_BLACKLIST + V.OPTION_WORDS)
    agg = c.groupBy(*ROW).agg(
        F.count("*").alias("n_cells"),
        F.count_if(x == "").alias("n_empty"),
        F.count_if(has_colon(x)).alias("n_colon"),
        F.count_if(short).alias("n_short"),
        F.count_if(x.rlike(r"(?U)^\d+$")).alias("n_digits"),
        F.sum("grid_span").alias("row_span"),
        F.array_sort(F.collect_list(F.struct("c_unique", "x"))).alias("texts"),
        F.bool_or("is_placeholder").alias("any_placeholder"),
    )
    one = F.col("n_cells") == 1
    only = F.get(F.col("texts"), F.lit(0))["x"]
    line = T.strip(F.substring_index(F.replace(only, F.lit("\n"), F.lit("|")), "|", 1))
    first_line = T.strip(F.when(F.contains(line, F.lit("：")), F.substring_index(line, "：", 1)).otherwise(F.substring_index(line, ":", 1)))
    n = F.col("n_cells")
    agg = agg.select(
        *ROW,
        "n_cells",
        "row_span",
        (one & (only.rlike(f"^[{V.NUMERALS}]+[、.．]") | only.isin(V.SECTION_TITLES))).alias("is_section_title"),
        ((F.col("n_empty") >= n * 0.5) & (F.col("n_colon") == 0) & (F.col("n_short") == 0) & (F.col("n_digits") == 0)).alias("is_empty_row"),
        ((n - F.col("n_empty") >= n * 0.6) & (F.col("n_colon") == 0)).alias("is_header_row"),
        F.when(one & F.length(first_line).between(2, 25) & ~F.col("any_placeholder"), first_line).alias("section_title"),
        F.when(one & (F.length(only) >= 2), only).alias("one_cell_text"),
        F.transform("texts", lambda t: F.replace(t["x"], F.lit("\n"), F.lit("|"))).alias("column_labels"),
    )
    return agg.join(multi_column_rows(c), ROW, "left").withColumn("is_multi_col", F.coalesce("is_multi_col", F.lit(False)))


def multi_column_rows(c: DataFrame) -> DataFrame:
    """PRD8: after the first label two fillable cells or more before the next label or option, and no label or option right after a fillable."""
    w = W.partitionBy(*ROW).orderBy("c_unique")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    live = c.filter("NOT continues")
    s = live.withColumns({"seen": F.max(F.col("is_label").cast("int")).over(upto), "brk": (F.col("is_label") | F.col("is_option")).cast("int"), "prev_fill": F.lag("is_fillable").over(w)})
    s = s.withColumn("run", F.sum("brk").over(upto))
    runs = s.groupBy(*ROW, "run").agg(
        F.count_if(F.col("is_fillable") & (F.col("seen") == 1)).alias("fills"), F.bool_or((F.col("is_label") | F.col("is_option")) & F.coalesce("prev_fill", F.lit(False))).alias("alternates"), F.max("seen").alias("seen")
    )
    return runs.groupBy(*ROW).agg(((F.max("seen") == 1) & (F.max("fills") >= 2) & ~F.bool_or("alternates")).alias("is_multi_col"))


def with_grid_start(cells: DataFrame) -> DataFrame:
    """WIN3: first grid column of each cell of a row."""
    return R.running_start(cells, ROW, "tc_ord", F.col("grid_span"), "grid_start")


def rowspans(cells: DataFrame) -> DataFrame:
    """WIN7: 1 and the cells below that continue the merge, up to a break, by grid column."""
    w = W.partitionBy(*TABLE, "grid_start").orderBy("r")
    marks = cells.withColumn("__start", (~continues(F.col("vmerge_raw"), "preview")).cast("int"))
    gap = F.col("r") - F.lag("r").over(w) > 1
    marks = marks.withColumn("__start", F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(F.col("__start"))).withColumn("__group", F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    size = F.count("*").over(W.partitionBy(*TABLE, "grid_start", "__group"))
    return marks.withColumn("rowspan", F.when(F.col("vmerge_raw") == "restart", size).when(F.col("vmerge_raw").isNull(), 1)).drop("__start", "__group")
