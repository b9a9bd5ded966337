"""The relational operators behind the form pipeline, over any table: merges, look-backs, islands, tiers, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import values as V


def merge_candidates(df: DataFrame, key: str, order: str, value: str, confidence: str, source: str) -> DataFrame:
    """AGG2, SRT5, MT2, AGG13: of each key the value of highest confidence (first in order on ties), n values, sources.

    No value: null and confidence 0. Equal values: all sources joined by " + ". Different values: confidence at most 0.6 and the
    distinct values, cut to 20 characters and sorted, as source.
    """
    found = F.col(value).isNotNull()
    rank = F.struct(F.col(confidence), (-F.col(order)).alias("__o"))
    out = df.groupBy(key).agg(
        F.max_by(F.when(found, F.col(value)), F.when(found, rank)).alias("value"),
        F.max(F.when(found, F.col(confidence))).alias("__c"),
        F.count_distinct(F.when(found, F.col(value))).alias("n_values"),
        F.count_if(found).alias("n_found"),
        F.array_sort(F.collect_set(F.when(found, F.left(F.col(value).cast("string"), F.lit(20))))).alias("__values"),
        F.array_sort(F.collect_list(F.when(found & (F.col(source) != ""), F.struct(F.col(order).alias("o"), F.col(source).alias("s"))))).alias("__sources"),
    )
    capped = F.when(F.col("n_values") > 1, F.least("__c", F.lit(V.CONFLICT_CAP))).otherwise(F.coalesce("__c", F.lit(0.0)))
    joined = F.array_join(F.transform("__sources", lambda x: x["s"]), " + ")
    shown = F.when(F.col("n_values") > 1, F.concat(F.lit("多文件有不同值("), F.array_join("__values", "+"), F.lit(")"))).otherwise(joined)
    return out.select(key, "value", capped.alias("confidence"), shown.alias("source"), "n_values", "n_found")


def prefer_primary(primary: DataFrame, fallback: DataFrame, key: str, value: str, rest: Sequence[str]) -> DataFrame:
    """JN4: full outer join by key; the primary row, unless its value is null and the fallback's is not (the whole row swaps)."""
    p = primary.select(key, *[F.col(c).alias(f"__p_{c}") for c in (value, *rest)], F.lit(True).alias("__p"))
    f = fallback.select(key, *[F.col(c).alias(f"__f_{c}") for c in (value, *rest)])
    swap = F.col("__p").isNull() | (F.col(f"__p_{value}").isNull() & F.col(f"__f_{value}").isNotNull())
    return p.join(f, key, "full_outer").select(key, *[F.when(swap, F.col(f"__f_{c}")).otherwise(F.col(f"__p_{c}")).alias(c) for c in (value, *rest)])


def left_fill(fields: DataFrame, found: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """JN1: fields left join found; what is missing takes the defaults."""
    out = fields.join(found, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def tiered_resolve(keys: DataFrame, fields: DataFrame, key: str, field: str, order: str, equal: Sequence[str], contains: str) -> DataFrame:
    """JN3: key to field by id or label equality, else case-folded containment either way; the first field of the best tier.

    Equality tiers are hash joins. Only keys that none resolves meet the label list by containment, and those labels are the
    distinct ones; their number is that of a form's fields.
    """
    tiers = [keys.join(fields.select(F.col(c).alias(key), field, order), key).select(key, field, order, F.lit(i).alias("tier")) for i, c in enumerate(equal)]
    exact = tiers[0]
    for t in tiers[1:]:
        exact = exact.unionByName(t)
    rest = keys.join(exact.select(key).distinct(), key, "left_anti")
    low, label = F.lower(F.col(key)), F.lower(F.col(contains))
    labels = fields.groupBy(contains).agg(F.min_by(field, order).alias(field), F.min(order).alias(order))
    loose = rest.join(labels, F.contains(low, label) | F.contains(label, low)).select(key, field, order, F.lit(len(equal)).alias("tier"))
    best = exact.unionByName(loose).groupBy(key).agg(F.min_by(F.struct(field, "tier"), F.struct("tier", order)).alias("b"))
    return keys.join(best, key, "left").select(key, F.col(f"b.{field}").alias(field), F.col("b.tier").alias("tier"))


def first_contained(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """JN2 with a short word list: the first word, in list order, that the text contains, and its place."""
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: F.contains(F.col(text), x["w"]))
    return df.withColumns({"word": F.get(hits, F.lit(0))["w"], "word_ord": F.get(hits, F.lit(0))["i"]})


def last_before(df: DataFrame, partition: Sequence[str], order: str, wanted: Column, value: Column, name: str) -> DataFrame:
    """JN5, JN6, WIN1: the value of the nearest earlier row for which ``wanted`` holds."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(wanted, value), ignorenulls=True).over(w))


def best_look_back(df: DataFrame, partition: Sequence[str], order: str, rows: int, score: Column, enough: Column, value: Column, name: str) -> DataFrame:
    """JN7-JN9: of the ``rows`` rows before, the nearest that is good enough, else the one of highest score (nearest on ties)."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(-rows, -1)
    near = F.struct(enough.alias("good"), F.when(enough, F.lit(0).cast("double")).otherwise(score.cast("double")).alias("score"), F.col(order).alias("at"))
    return df.withColumn(name, F.max_by(value, near).over(w))


def span_join(df: DataFrame, start: Column, span: Column, name: str) -> DataFrame:
    """JN10: a row for each grid column a cell covers."""
    return df.filter(span > 0).withColumn(name, F.explode(F.sequence(start, start + span - 1)))


def without(df: DataFrame, unwanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN11-JN14, SET2: rows whose key is not among the unwanted ones."""
    return df.join(unwanted.select(*keys).distinct(), list(keys), "left_anti")


def last_rows(df: DataFrame, partition: Sequence[str], order: str, n: int) -> DataFrame:
    """WIN8: the last n rows of each partition."""
    w = W.partitionBy(*partition).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def first_rows(df: DataFrame, partition: Sequence[str], orders: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """SRT3, SRT4: the first n rows of each partition in the given order, with their rank."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*orders))).filter(F.col(name) <= n)


def islands(df: DataFrame, partition: Sequence[str], order: str, same: Sequence[Column | str]) -> DataFrame:
    """WIN4, WIN5, FLD8, WIN10: runs of neighbouring rows with equal ``same``; adds the run's number in its partition."""
    w = W.partitionBy(*partition).orderBy(order)
    changed = F.lit(False)
    for c in same:
        c = F.col(c) if isinstance(c, str) else c
        changed = changed | ~c.eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__change", F.when(first | changed, 1).otherwise(0)).withColumn("island", F.sum("__change").over(w)).drop("__change")


def merge_islands(df: DataFrame, partition: Sequence[str], order: str, same: str, text: str, glue: str) -> DataFrame:
    """WIN10: neighbouring rows of equal ``same`` as one, texts joined in order."""
    runs = islands(df, partition, order, [same])
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return runs.groupBy(*partition, "island").agg(F.min(order).alias(order), F.first(same).alias(same), F.count("*").alias("n_parts"), F.array_join(F.transform(parts, lambda x: x[text]), glue).alias(text))


def running_start(df: DataFrame, partition: Sequence[str], order: str, span: Column, name: str) -> DataFrame:
    """WIN3: sum of the spans before a row."""
    w = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(span).over(w), F.lit(0).cast("long")))


def batches(df: DataFrame, order: str, size: int = V.FIELDS_PER_BATCH, partition: Sequence[str] = ()) -> DataFrame:
    """WIN9: consecutive batches of ``size`` rows. With no partition the rows are numbered by ranges of ``order``: counts of the
    ranges before a row, which come from a small aggregate, and its rank in its range."""
    if partition:
        rank = F.row_number().over(W.partitionBy(*partition).orderBy(order))
        return df.withColumn("batch", F.floor((rank - 1) / size))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []))
    part = F.size(F.filter(F.lit(cuts), lambda b: b < F.col(order))) if cuts else F.lit(0)
    parts = df.withColumn("__part", part)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy(order))).join(before.select("__part", "__before"), "__part")
    return ranked.withColumn("batch", F.floor((F.col("__before") + F.col("__rank") - 1) / size)).drop("__part", "__rank", "__before")


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """AGG1: of each key the first id, all ids in order, how many."""
    return df.groupBy(*keys).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(order)).alias("members"), F.count("*").alias("repeat_count"))


def progress(df: DataFrame, keys: Sequence[str], status: Column) -> DataFrame:
    """AGG3-AGG5, AGG12: counts by status, fill rate with one decimal, completeness."""
    s = df.withColumn("__s", status)
    filled = F.col("__s") != "empty"
    return s.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("__s") == "confirmed").alias("confirmed"),
        F.count_if(F.col("__s") == "review").alias("review"),
        F.count_if(F.col("__s") == "empty").alias("empty"),
        F.round(F.count_if(filled) * 100.0 / F.count("*"), 1).alias("fill_rate"),
        F.bool_and(filled).alias("is_complete"),
    )


def shares(df: DataFrame, bucket: Column, partition: Sequence[str] = ()) -> DataFrame:
    """AGG6: rows a bucket and their share of the partition's rows."""
    counts = df.withColumn("bucket", bucket).groupBy(*partition, "bucket").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy(*partition)).cast("double")))


def compressed_ranges(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """AGG10: whether the numbers of a key are one range, and the range as text."""
    agg = df.select(*keys, number).distinct().groupBy(*keys).agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n"))
    one = F.col("hi") - F.col("lo") + 1 == F.col("n")
    return agg.withColumn("contiguous", one).withColumn("range", F.when(one, F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))))


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SET3, SET6, JN15: full outer alignment of one value by key with the kind of difference."""
    a = left.select(*keys, F.col(value).alias("before"), F.lit(True).alias("__a"))
    b = right.select(*keys, F.col(value).alias("after"), F.lit(True).alias("__b"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = (
        F.when(F.col("__b").isNull(), "missing")
        .when(F.col("__a").isNull(), "added")
        .when(blank("before") & blank("after"), "still_empty")
        .when(blank("before"), "filled")
        .when(blank("after"), "cleared")
        .when(F.col("before") != F.col("after"), "changed")
        .otherwise("same")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, "before", "after", kind.alias("kind"))
