"""HTML preview (SNK4, STY1): tables with editable cells, joined from rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators.cells import continues, is_fillable_preview, rowspans


def cell_html(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """One <td> a cell that shows: spans, style, and an input for a cell that a field fills (JN19)."""
    ids = fields.select("doc_id", "t", F.explode("row_indices").alias("r"), F.col("c").alias("c_unique"), "field_id", F.coalesce("raw_label", "label").alias("label"))
    at = ids.groupBy("doc_id", "t", "r", "c_unique").agg(F.array_join(F.array_sort(F.collect_set("field_id")), ",").alias("ids"), F.min("label").alias("label"))
    shown = rowspans(cells).filter(~continues(F.col("vmerge_raw"), "preview")).withColumn("x", T.strip(F.coalesce("text", F.lit(""))))
    j = shown.join(at, ["doc_id", "t", "r", "c_unique"], "left")
    span = F.concat(F.when(F.col("grid_span") > 1, F.format_string(' colspan="%d"', "grid_span")).otherwise(""), F.when(F.col("rowspan") > 1, F.format_string(' rowspan="%d"', "rowspan")).otherwise(""))
    style = F.concat_ws(
        ";",
        F.when(F.col("shd_fill").isNotNull() & (F.col("shd_fill") != "auto"), F.concat(F.lit("background:#"), "shd_fill")),
        F.when(F.col("font_pt").isNotNull(), F.concat(F.lit("font-size:"), F.col("font_pt").cast("string"), F.lit("pt"))),
        F.when(F.col("align").isNotNull(), F.concat(F.lit("text-align:"), F.when(F.col("align") == "both", "justify").otherwise(F.col("align")))),
    )
    attr = F.concat(span, F.when(style != "", F.concat(F.lit(' style="'), style, F.lit('"'))).otherwise(""))
    text = F.replace(T.html_escape("x"), F.lit("\n"), F.lit("<br>"))
    box = F.concat(F.lit('<span class="field" contenteditable="true" data-field="'), T.html_escape("ids"), F.lit('" data-label="'), T.html_escape("label"), F.lit('">'), F.when(is_fillable_preview(F.col("x")), "").otherwise(text), F.lit("</span>"))
    body = F.when(F.col("ids").isNotNull(), box).otherwise(text)
    return j.select("doc_id", "t", "r", "tc_ord", F.concat(F.lit("<td"), attr, F.lit(">"), body, F.lit("</td>")).alias("html"))


def _joined(column: str, order: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), "")


def html(cells: DataFrame, paragraphs: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, html, and how labels and ids map: paragraphs, then tables."""
    rows = cell_html(cells, fields).groupBy("doc_id", "t", "r").agg(_joined("html", "tc_ord").alias("row"))
    rows = rows.withColumn("row", F.concat(F.lit("<tr>"), "row", F.lit("</tr>")))
    tables = rows.groupBy("doc_id", "t").agg(_joined("row", "r").alias("part")).withColumn("part", F.concat(F.lit("<table>"), "part", F.lit("</table>")))
    paras = paragraphs.filter(T.strip("text") != "").select("doc_id", F.col("p").alias("t"), F.concat(F.lit("<p>"), T.html_escape("text"), F.lit("</p>")).alias("part"))
    parts = paras.select("doc_id", F.struct(F.lit(0).alias("k"), "t").alias("o"), "part").unionByName(tables.select("doc_id", F.struct(F.lit(1).alias("k"), "t").alias("o"), "part"))
    return parts.groupBy("doc_id").agg(_joined("part", "o").alias("html"))


def label_map(fields: DataFrame) -> DataFrame:
    """JN19: the ids of each label."""
    return fields.groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("field_id")).alias("field_ids"))
