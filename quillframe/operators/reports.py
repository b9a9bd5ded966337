"""Old reports (EXT8, JN20, CL2, D2, D4): values of a filled document at its template's field positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators.cells import is_meaningful_value


def value_by_mode(text: Column, label: Column, mode: Column) -> Column:
    """CL2: append, set and replace: what follows the label; check: the text if it is a mark."""
    rest = T.strip_label(text, label)
    usable = F.when((rest != "") & (rest != label) & ~rest.isin(V.OLD_PLACEHOLDERS), rest)
    return F.when(mode == "append", rest).when(mode.isin("set", "replace"), usable).when((mode == "check") & text.isin(V.CHECK_VALUES), text)


def extracted(fields: DataFrame, cells: DataFrame, runs: DataFrame | None = None, key: str = "template_id") -> DataFrame:
    """(doc_id, label, value) of each filled document: the cell's own pair, else a pair of its row, else by fill mode; of equal labels the last field's.

    fields: doc_id is the template's id; cells: those of the filled documents with a column ``template_id``.
    """
    f = fields.withColumn("pos", T.field_id_parts("field_id")).filter("pos.t IS NOT NULL")
    f = f.select(F.col("doc_id").alias(key), F.col("pos.t").alias("t"), F.col("pos.r").alias("r"), F.col("pos.c").alias("c"), F.coalesce(F.nullif("raw_label", F.lit("")), F.col("label")).alias("label"), "fill_mode", "ord")
    c = cells.select(key, "doc_id", "t", "r", F.explode("c_expanded").alias("c"), "c_expanded", T.strip(F.coalesce("text", F.lit(""))).alias("x"))
    c = c.withColumn("pairs", T.label_value_pairs("x"))
    own = f.join(c, [key, "t", "r", "c"]).filter("x <> ''")
    pairs = c.filter(F.col("c") == F.array_min("c_expanded")).select(key, "doc_id", "t", "r", F.col("c").alias("pc"), F.explode("pairs").alias("label", "pv")).filter("pv <> ''")
    in_row = pairs.groupBy(key, "doc_id", "t", "r", "label").agg(F.min_by("pv", "pc").alias("row_value"))
    both = own.join(in_row, [key, "doc_id", "t", "r", "label"], "left")
    mode = value_by_mode(F.col("x"), F.col("label"), F.col("fill_mode"))
    found = F.coalesce(F.nullif(F.element_at("pairs", F.col("label")), F.lit("")), F.col("row_value"), F.when(is_meaningful_value(F.coalesce(mode, F.lit(""))), mode))
    out = both.withColumn("value", found).filter("value IS NOT NULL").select("doc_id", "label", "value", "ord")
    if runs is not None:
        p = fields.filter("pattern = 'paragraph_underline'").select(F.col("doc_id").alias(key), F.col("r").alias("p"), "label", "ord")
        blanks = runs.filter("scope = 'body' AND is_underline").groupBy(key, "doc_id", "p").agg(F.min_by("text", "run").alias("u"))
        para = p.join(blanks, [key, "p"]).select("doc_id", "label", T.strip("u").alias("value"), "ord").filter("value <> '' AND value <> label")
        out = out.unionByName(para)
    return out.groupBy("doc_id", "label").agg(F.max_by("value", "ord").alias("value"))


def prefilled(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Old-report values as writes at their confidence (STM2), by field_id (D2, D7)."""
    named = fields.select("field_id", F.coalesce(F.nullif("raw_label", F.lit("")), F.col("label")).alias("label"))
    return named.join(values, "label").select("doc_id", "field_id", "label", "value", F.lit(V.OLD_REPORT_CONFIDENCE).alias("confidence"))
