"""Validation, comparison and repair (VAL1-VAL9, JN15, SET3, SET6, FIX1-FIX3, WIN10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators import relational as R
from quillframe.sources import ooxml
from quillframe.sources.ooxml import q

#: property tag, its parent, what must not stand before it
ORDER_RULES = [("pPr", "p", ["r"]), ("rPr", "r", ["t"]), ("tblPr", "tbl", ["tr"]), ("tblGrid", "tbl", ["tr"]), ("trPr", "tr", ["tc"]), ("tcPr", "tc", ["p"])]


def _issue(df: DataFrame, check: str, severity: str, detail) -> DataFrame:
    return df.select("doc_id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def issues(nodes: DataFrame, cells: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    """VAL1: doc_id, check, severity, detail of every violation. documents (doc_id) are those that should be there."""
    found = []
    # VAL2: a body and a table
    kinds = nodes.groupBy("doc_id").agg(F.count_if(F.col("tag") == "body").alias("bodies"), F.count_if(F.col("tag") == "tbl").alias("tables"))
    base = documents.select("doc_id").distinct().join(kinds, "doc_id", "left")
    found.append(_issue(base.filter("coalesce(bodies, 0) = 0"), "structure", "error", F.lit("no body")))
    found.append(_issue(base.filter("bodies > 0 AND tables = 0"), "structure", "error", F.lit("no table")))
    # VAL3: properties before content
    for prop, parent, later in ORDER_RULES:
        agg = nodes.filter(F.col("parent_tag") == parent).groupBy("doc_id", "parent_id").agg(F.max(F.when(F.col("tag") == prop, F.col("ord"))).alias("at"), F.min(F.when(F.col("tag").isin(later), F.col("ord"))).alias("first"))
        found.append(_issue(agg.filter("at > first"), "element_order", "error", F.format_string(f"{prop} after content in {parent} %d", "parent_id")))
    # VAL4: a paragraph in every cell
    tcs = nodes.filter("tag = 'tc'").select("doc_id", "node_id")
    with_p = nodes.filter("tag = 'p'").select("doc_id", F.col("parent_id").alias("node_id"))
    found.append(_issue(tcs.join(with_p, ["doc_id", "node_id"], "left_anti"), "cell_paragraph", "error", F.format_string("cell %d has no paragraph", "node_id")))
    # VAL5 never reports; VAL6: dimensions
    dims = cells.groupBy("doc_id", "t").agg((F.max("r") + 1).alias("n_rows"), F.max(F.col("grid_start") + F.col("grid_span")).alias("n_cols"))
    found.append(_issue(dims.filter(F.col("n_rows") > V.TABLE_ROWS), "dimensions", "warning", F.format_string("table %d: %d rows", "t", "n_rows")))
    found.append(_issue(dims.filter(F.col("n_cols") > V.TABLE_COLUMNS), "dimensions", "warning", F.format_string("table %d: %d columns", "t", "n_cols")))
    # VAL7: section properties last
    last = nodes.filter("parent_tag = 'body'").groupBy("doc_id").agg(F.max(F.when(F.col("tag") == "sectPr", F.col("ord"))).alias("at"), F.max("ord").alias("end"))
    found.append(_issue(last.filter("at < end"), "section_last", "error", F.lit("section properties are not last")))
    # VAL8: direct formats a run
    many = runs.withColumn("n", F.size(F.filter("rpr_tags", lambda x: x.isin(V.RUN_FORMATS)))).filter(F.col("n") > V.DIRECT_FORMATS)
    found.append(_issue(many, "direct_format", "warning", F.format_string("run %d: %d direct formats", "run", "n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def verdicts(documents: DataFrame, found: DataFrame) -> DataFrame:
    """AGG12: errors, warnings and passed of each document."""
    agg = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = documents.select("doc_id").distinct().join(agg, "doc_id", "left").fillna(0)
    return out.withColumn("passed", F.col("n_errors") == 0)


def _first_cells(cells: DataFrame) -> DataFrame:
    own = cells.filter("c_unique IS NOT NULL").withColumn("c", F.array_min("c_expanded"))
    return own.filter("origin_r = r").select("doc_id", "t", "r", "c", T.strip(F.coalesce("text", F.lit(""))).alias("x"))


def context_labels(cells: DataFrame) -> DataFrame:
    """D1: the label of a cell: the cell to its left, else the one above, of at most 20 characters."""
    own = cells.select("doc_id", "t", "r", F.array_min("c_expanded").alias("c"), T.strip(F.coalesce("text", F.lit(""))).alias("x"))
    ok = lambda c: F.when((c != "") & (F.length(c) <= 20), c)
    row, column = W.partitionBy("doc_id", "t", "r").orderBy("c"), W.partitionBy("doc_id", "t", "c").orderBy("r")
    return own.select("doc_id", "t", "r", "c", F.coalesce(ok(F.lag("x").over(row)), ok(F.lag("x").over(column))).alias("label"))


def diff(template: DataFrame, filled: DataFrame, strict: bool = False) -> DataFrame:
    """JN15, SET3: doc_id, field_id, kind (filled, still_empty), label, value (80 characters). Both sides carry one doc_id.

    Tables that both have, cells of the filled one; a cleared cell is no row. strict labels cells by their id (D1).
    """
    a, b = _first_cells(template), _first_cells(filled)
    common = a.select("doc_id", "t").distinct()
    both = b.join(common, ["doc_id", "t"], "left_semi").join(a.withColumnRenamed("x", "was"), ["doc_id", "t", "r", "c"], "left").withColumn("was", F.coalesce("was", F.lit("")))
    kind = F.when((F.col("x") != "") & (F.col("x") != F.col("was")), "filled").when((F.col("x") == "") & (F.col("was") == ""), "still_empty")
    rows = both.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("field_id", F.format_string("T%d_R%d_C%d", "t", "r", "c"))
    if strict:
        rows = rows.withColumn("label", F.col("field_id"))
    else:
        rows = rows.join(context_labels(template), ["doc_id", "t", "r", "c"], "left").filter("kind = 'filled' OR label IS NOT NULL")
    return rows.select("doc_id", "field_id", "kind", "label", F.left("x", F.lit(80)).alias("value"))


def underline_diff(template: DataFrame, filled: DataFrame) -> DataFrame:
    """JN15 for paragraphs: underlined runs that were blank and are not."""
    w = W.partitionBy("doc_id", "p").orderBy("run")
    part = lambda d, name: d.filter("scope = 'body' AND is_underline").select("doc_id", "p", (F.row_number().over(w) - 1).alias("u"), T.strip(F.coalesce("text", F.lit(""))).alias(name))
    labels = template.filter("scope = 'body' AND NOT is_underline").groupBy("doc_id", "p").agg(F.array_sort(F.collect_list(F.struct("run", "text"))).alias("x"))
    labels = labels.select("doc_id", "p", T.strip(F.array_join(F.transform("x", lambda y: y["text"]), "")).alias("label"))
    both = part(template, "was").join(part(filled, "now"), ["doc_id", "p", "u"]).filter("was = '' AND now <> ''").join(labels, ["doc_id", "p"], "left")
    return both.select("doc_id", F.format_string("P%d_U%d", "p", "u").alias("field_id"), F.lit("filled").alias("kind"), "label", F.left("now", F.lit(80)).alias("value"))


def diff_summary(rows: DataFrame) -> DataFrame:
    n = F.count_if(F.col("kind") == "filled")
    return rows.groupBy("doc_id").agg(n.alias("n_filled"), F.count_if(F.col("kind") == "still_empty").alias("n_still_empty"), F.round(F.try_divide(n * 100.0, F.count("*")), 1).alias("fill_rate"))


def dimension_changes(template: DataFrame, filled: DataFrame) -> DataFrame:
    """SET6, VAL9: table by table: missing and added tables, fewer rows (errors), more rows (warnings), other columns."""
    size = lambda d, s: d.groupBy("doc_id", "t").agg((F.max("r") + 1).alias(f"rows_{s}"), F.max(F.col("grid_start") + F.col("grid_span")).alias(f"cols_{s}"))
    both = size(template, "a").join(size(filled, "b"), ["doc_id", "t"], "full_outer")
    kinds = F.filter(
        F.array(
            F.when(F.col("rows_b").isNull(), F.struct(F.lit("table_missing").alias("change"), F.lit("error").alias("severity"))),
            F.when(F.col("rows_a").isNull(), F.struct(F.lit("table_added").alias("change"), F.lit("error").alias("severity"))),
            F.when(F.col("rows_b") < F.col("rows_a"), F.struct(F.lit("rows_fewer").alias("change"), F.lit("error").alias("severity"))),
            F.when(F.col("rows_b") > F.col("rows_a"), F.struct(F.lit("rows_more").alias("change"), F.lit("warning").alias("severity"))),
            F.when(F.col("cols_b") != F.col("cols_a"), F.struct(F.lit("columns").alias("change"), F.lit("error").alias("severity"))),
        ),
        lambda x: x.isNotNull(),
    )
    return both.withColumn("k", F.explode(kinds)).select("doc_id", "t", "k.change", "k.severity", "rows_a", "rows_b", "cols_a", "cols_b")


def merged_runs(runs: DataFrame) -> DataFrame:
    """WIN10, FIX3: neighbouring runs of equal format as one; a run without text breaks the row of equals."""
    keys = ["doc_id", "scope", "p", "t", "r", "tc_ord"]
    filled = runs.fillna(-1, ["t", "r", "tc_ord"]).withColumn("fmt", F.coalesce("rpr", F.lit("")))
    islands = R.islands(filled.withColumn("has", F.col("text").isNotNull()), keys, "run", ["fmt", "has"])
    parts = F.array_sort(F.collect_list(F.struct("run", "text")))
    return islands.groupBy(*keys, "island").agg(F.min("run").alias("run"), F.first("fmt").alias("rpr"), F.count("*").alias("n_runs"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def repair(content: bytes) -> tuple[bytes, dict[str, int]]:
    """FIX1-FIX3: a paragraph for cells without one, properties first, equal neighbouring runs as one."""
    d = ooxml.Docx(content)
    n = {"paragraphs_added": 0, "reordered": 0, "runs_merged": 0}
    if d.body is None:
        return content, n
    for tc in d.body.iter(q("tc")):
        if tc.find(q("p")) is None:
            ooxml.ET.SubElement(tc, q("p"))
            n["paragraphs_added"] += 1
    for prop, parent, _ in ORDER_RULES:
        for x in list(d.body.iter(q(parent))):
            found = x.find(q(prop))
            if prop in ("pPr", "rPr", "tcPr") and found is not None and list(x).index(found):
                x.remove(found)
                x.insert(0, found)
                n["reordered"] += 1
    for p in d.body.iter(q("p")):
        last = None
        for child in list(p):
            if child.tag != q("r"):
                last = None
                continue
            t, form = child.find(q("t")), child.find(q("rPr"))
            form = b"" if form is None else ooxml.ET.tostring(form)
            if t is None or len([x for x in child if x.tag not in (q("rPr"), q("t"))]):
                last = None
            elif last is not None and last[1] == form:
                last[0].text = (last[0].text or "") + (t.text or "")
                last[0].set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                p.remove(child)
                n["runs_merged"] += 1
            else:
                last = (t, form)
    return d.save(), n


def repaired(files: DataFrame) -> DataFrame:
    """path, content, and how often each repair was made."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                fixed, n = repair(bytes(content))
                out.append((path, fixed, n["paragraphs_added"], n["reordered"], n["runs_merged"]))
            yield pd.DataFrame(out, columns=["path", "content", "paragraphs_added", "reordered", "runs_merged"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, paragraphs_added long, reordered long, runs_merged long")
