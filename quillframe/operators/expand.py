"""Grouped fields and their values (AGG7-AGG10, FIL1, FIL2, CL1): what users see, and back to what a template has.

fields(doc_id, field_id, label, fill_mode, ord, ...); user values come as kv(doc_id, label, value) with value a text, as lists and
maps are exploded at the edge by ``kv_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import values as V


def sub_label(label: Column, generic: bool = False) -> Column:
    """base and suffix of a sub-field's label (null if it is a field of its own).

    Built-in templates: a known suffix after the last underscore. Others: after the first one a number, a column or question
    number, or a known word.
    """
    if generic:
        parts = F.split(label, "_", 2)
        suffix = F.get(parts, F.lit(1))
        good = suffix.rlike(r"^\d+$") | suffix.rlike(r"^第\d+[列格]$") | suffix.isin(V.GENERIC_SUFFIXES) | suffix.rlike("[列题]")
        return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("base"), suffix.alias("suffix")))
    suffix = F.element_at(F.split(label, "_"), -1)
    return F.when(F.contains(label, F.lit("_")) & suffix.isin(V.SUB_SUFFIXES), F.struct(F.left(label, F.length(label) - F.length(suffix) - 1).alias("base"), suffix.alias("suffix")))


def sub_fields(fields: DataFrame, generic: bool = False) -> DataFrame:
    """doc_id, field_id, label, base, suffix, place: the sub-fields of each base in field order."""
    s = fields.withColumn("s", sub_label(F.col("label"), generic)).filter("s IS NOT NULL").select("doc_id", "field_id", "label", "ord", "s.*")
    return s.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "base").orderBy("ord")) - 1)


def simplified(fields: DataFrame, generic: bool = False) -> DataFrame:
    """AGG8, AGG9: user fields: single ones as they are, sub-fields as one group a base; attendance is a group of its own."""
    s = fields.withColumn("s", sub_label(F.col("label"), generic))
    base = F.coalesce("s.base", "label")
    w = W.partitionBy("doc_id", "base")
    s = s.withColumn("base", base).withColumn("grouped", F.bool_or(F.col("s").isNotNull()).over(w))
    attends = F.coalesce(F.col("s.suffix").isin(V.ATTENDANCE), F.lit(False)) & F.lit(not generic) & (F.col("base") != "考勤")
    group = F.when(attends, V.ATTENDANCE_KEY).otherwise(F.col("base"))
    rows = s.withColumn("group", group)
    member = F.struct("ord", F.coalesce("s.suffix", "label").alias("suffix"), "field_id")
    out = rows.groupBy("doc_id", "group").agg(F.min("ord").alias("ord"), F.bool_or("grouped").alias("grouped"), F.array_sort(F.collect_list(member)).alias("m"), F.min_by("fill_mode", "ord").alias("mode"))
    subs = F.transform("m", lambda x: x["suffix"])
    return out.select(
        "doc_id",
        F.col("group").alias("label"),
        "ord",
        F.when(F.col("grouped"), "group").otherwise(F.col("mode")).alias("fill_mode"),
        F.when(F.col("grouped"), compressed_labels(subs)).alias("sub_labels"),
        F.transform("m", lambda x: x["field_id"]).alias("field_ids"),
    )


def compressed_labels(subs: Column) -> Column:
    """AGG10: over five labels, numbers and column numbers as one range each, the others after them."""

    def part(pattern: str, whole: str, loose: str) -> Column:
        numbers = F.transform(F.filter(subs, lambda x: x.rlike(f"^{pattern}$")), lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int"))
        lo, hi, n = F.array_min(numbers), F.array_max(numbers), F.size(numbers)
        text = F.when(hi - lo + 1 == n, F.format_string(whole, lo, hi, n)).otherwise(F.format_string(loose, n))
        return F.when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))

    rest = F.filter(subs, lambda x: ~x.rlike(r"^(第)?\d+(列)?$"))
    packed = F.concat(part(r"\d+", "数据%d~%d（共%d项）", "数据%d项"), part(r"第\d+列", "第%1$d列~第%2$d列（共%3$d项）", "列数据%d项"), rest)
    return F.when(F.size(subs) > 5, packed).otherwise(subs)


def kv_rows(data: DataFrame) -> DataFrame:
    """User data (doc_id, json: one object) as kv(doc_id, label, kind, value, items, entries)."""
    v = F.try_parse_json(F.col("json"))
    pairs = data.select("doc_id", F.explode(F.from_json("json", "map<string,string>")).alias("label", "value"), v.alias("v"))
    text = F.col("value")
    items = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))
    entries = F.when(F.startswith(text, F.lit("{")), F.from_json(text, "map<string,string>"))
    kind = F.when(entries.isNotNull(), "map").when(items.isNotNull(), "list").otherwise("text")
    return pairs.select("doc_id", "label", kind.alias("kind"), "value", items.alias("items"), entries.alias("entries"))


def expanded(kv: DataFrame, fields: DataFrame, generic: bool = False) -> DataFrame:
    """FIL1, FIL2, MP2, AGG6: (doc_id, label, value) with each group's values on its sub-fields.

    Comma texts and lists (of as many items as sub-fields) go to sub-fields in field order; attendance comes as loose keys, a map, or
    a comma text in its fixed order; values of single fields stay; score-band shares are computed where only counts are given.
    """
    subs = sub_fields(fields, generic)
    sizes = subs.filter(~F.col("suffix").isin(V.ATTENDANCE)).groupBy("doc_id", "base").agg(F.count("*").alias("n_subs"))
    split_at = r"[,，]" if generic else ","
    parts = F.when(F.col("kind") == "list", F.col("items")).when((F.col("kind") == "text") & F.col("value").rlike(split_at), F.transform(F.split("value", split_at), T.strip))
    base = F.coalesce("known", F.lit(False))
    bases = subs.select("doc_id", F.col("base").alias("label"), F.lit(True).alias("known")).distinct()
    k = kv.withColumn("parts", parts).join(bases, ["doc_id", "label"], "left").join(sizes.withColumnRenamed("base", "label"), ["doc_id", "label"], "left")
    grouped = base & F.col("parts").isNotNull() & ((F.col("kind") == "text") | (F.size("parts") == F.col("n_subs")))
    plain = subs if generic else subs.filter(~F.col("suffix").isin(V.ATTENDANCE))
    plain = plain.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "base").orderBy("ord")) - 1)
    spread = k.filter(grouped).select("doc_id", F.col("label").alias("base"), F.posexplode("parts").alias("place", "value"))
    by_place = plain.select("doc_id", "base", "place", "label").join(spread, ["doc_id", "base", "place"]).filter("value <> ''").select("doc_id", "label", "value")
    # attendance
    order = F.array_position(F.lit(V.ATTENDANCE), F.col("suffix"))
    att = subs.filter(F.col("suffix").isin(V.ATTENDANCE)).select("doc_id", "label", "suffix").withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(order)) - 1)
    loose = kv.filter(F.col("label").isin(V.ATTENDANCE)).select("doc_id", F.col("label").alias("suffix"), "value")
    mapped = kv.filter((F.col("label") == V.ATTENDANCE_KEY) & (F.col("kind") == "map")).select("doc_id", F.explode("entries").alias("suffix", "value"))
    listed = k.filter((F.col("label") == V.ATTENDANCE_KEY) & F.col("parts").isNotNull()).select("doc_id", F.posexplode("parts").alias("place", "value"))
    by_suffix = att.drop("place").join(loose.unionByName(mapped), ["doc_id", "suffix"]).select("doc_id", "label", "value")
    by_order = att.join(listed, ["doc_id", "place"]).select("doc_id", "label", "value")
    other = k.filter(~grouped & ~F.col("label").isin([*V.ATTENDANCE, V.ATTENDANCE_KEY])).select("doc_id", "label", "value")
    out = by_place.unionByName(by_suffix).unionByName(by_order).unionByName(other)
    return out if generic else out.unionByName(band_shares(out, subs))


def band_shares(values: DataFrame, subs: DataFrame) -> DataFrame:
    """AGG6: shares of the score bands for the bases that have counts and no share yet."""
    bands = subs.filter(F.startswith("base", F.lit(V.BAND_BASE))).join(values, ["doc_id", "label"], "left")
    share = F.startswith("suffix", F.lit("第"))
    todo = bands.groupBy("doc_id", "base").agg(F.count_if(share & F.col("value").isNotNull()).alias("given")).filter("given = 0").select("doc_id", "base")
    live = bands.join(todo, ["doc_id", "base"])
    w = W.partitionBy("doc_id", "base")
    counts = live.filter(F.col("suffix").isin(V.BANDS)).select("doc_id", "base", "ord", T.safe_number("value").alias("n"))
    counts = counts.withColumns({"i": F.row_number().over(w.orderBy("ord")), "total": F.sum("n").over(w)})
    targets = live.filter(share).select("doc_id", "base", "label", "ord").withColumn("i", F.row_number().over(w.orderBy("ord")))
    return targets.join(counts.drop("ord"), ["doc_id", "base", "i"]).filter("total > 0").select("doc_id", "label", T.percent(F.col("n"), F.col("total")).alias("value"))


def category(label: Column, fill_mode: Column) -> Column:
    """CL1."""
    optional = F.lit(False)
    for word in V.OPTIONAL_WORDS:
        optional = optional | F.contains(label, F.lit(word))
    named = T.matched_category(F.lower(F.coalesce(label, F.lit(""))), V.CATEGORIES, "")
    return F.when(named != "", named).when(fill_mode == "check", "inheritable").when(optional, "optional").otherwise("inheritable")


def checklist(fields: DataFrame) -> DataFrame:
    """AGG7: the fields of each category, and how many."""
    named = fields.withColumn("name", F.coalesce(F.nullif(F.col("raw_label"), F.lit("")), F.col("label")))
    rows = named.withColumn("category", category(F.col("name"), F.col("fill_mode")))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "field_id", F.col("name").alias("label"), "fill_mode"))).alias("fields"))


def user_view(fields: DataFrame) -> DataFrame:
    """PRJ1, PRJ2: field_id, label and a hint by keyword; blank labels go."""
    name = F.coalesce(F.nullif(T.strip(F.coalesce("raw_label", F.lit(""))), F.lit("")), T.strip("label"))
    hint = F.when(name.rlike("签字|签名"), "签名").when(F.contains(name, F.lit("日期")), "日期").when(name.rlike("百分比|比例|率"), "百分比")
    return fields.select("doc_id", "field_id", name.alias("label"), hint.alias("hint"), "fill_mode", "ord").filter("label <> ''")
