"""Session state and message windows: the batch fold (STM1-STM4) and the message reducer (STM5). The streaming form of the
fold is in quillframe.streaming.sessions; both share ``write_status``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.session import broadcast_if_small
from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.operators import relational as R


def write_status(confidence: Column, confirm_from: float = 1.0) -> Column:
    """STM2: a write confirms its field from full confidence on, else it fills it."""
    return F.when(confidence >= confirm_from, "confirmed").otherwise("filled")


def usable(value: Column) -> Column:
    """D20: null and blank are no values; the text 0 is one."""
    return value.isNotNull() & (T.strip(value) != "")


def fold(writes: DataFrame, confirm_from: float = 1.0) -> DataFrame:
    """(session_id, seq, field_id, value, confidence) to one row a field: the last write up to the first that confirms it.

    Blank values and null sequence numbers are passed over. Of writes with one seq the greatest value counts. Two aggregations, no window, so
    a busy session is pre-aggregated before the shuffle.
    """
    w = writes.filter(usable(F.col("value")) & F.col("seq").isNotNull()).withColumn("confidence", F.coalesce("confidence", F.lit(V.USER_CONFIDENCE)))
    keys = ["session_id", "field_id"]
    stops = w.filter(F.col("confidence") >= confirm_from).groupBy(*keys).agg(F.min("seq").alias("__stop"))
    kept = w.join(stops, keys, "left").filter(F.col("__stop").isNull() | (F.col("seq") <= F.col("__stop")))
    last = kept.groupBy(*keys).agg(F.max(F.struct("seq", "value", "confidence")).alias("w"), F.max("__stop").alias("__stop"))
    return last.select(*keys, "w.seq", "w.value", "w.confidence", F.when(F.col("__stop").isNull(), "filled").otherwise("confirmed").alias("status"))


def form_state(fields: DataFrame, folded: DataFrame) -> DataFrame:
    """STM1: every field (field_id, label, ord) of every session with its state; untouched ones are empty."""
    sessions = folded.select("session_id").distinct()
    grid = sessions.join(broadcast_if_small(fields), F.lit(True))
    return grid.join(folded, ["session_id", "field_id"], "left").withColumn("status", F.coalesce("status", F.lit("empty")))


def confirm(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """STM3: filled fields among ``wanted`` (session_id, field_id) become confirmed."""
    mark = wanted.select("session_id", "field_id").distinct().withColumn("__c", F.lit(True))
    up = F.col("__c") & (F.col("status") == "filled")
    return states.join(mark, ["session_id", "field_id"], "left").withColumn("status", F.when(up, "confirmed").otherwise(F.col("status"))).drop("__c")


def missing(states: DataFrame) -> DataFrame:
    """STM4: what is still empty."""
    return states.filter("status = 'empty'")


def needs_review(states: DataFrame) -> DataFrame:
    """STM3: filled, not confirmed."""
    return states.filter("status = 'filled'")


def next_batch(states: DataFrame, priority: list[str], n: int = 5) -> DataFrame:
    """SRT3: the next n empty fields of a session, those with a priority keyword first, then in field order."""
    first = F.lit(False)
    for word in priority:
        first = first | F.contains(F.col("label"), F.lit(word))
    return R.first_rows(missing(states), ["session_id"], [first.desc(), F.col("ord")], n)


def split_keys(writes: DataFrame, states: DataFrame) -> DataFrame:
    """SET4: writes with ``outcome``: matched, unmatched, or skipped where the field is confirmed."""
    known = states.select("session_id", "field_id", F.col("status").alias("__s"))
    outcome = F.when(F.col("__s").isNull(), "unmatched").when(F.col("__s") == "confirmed", "skipped").otherwise("matched")
    return writes.join(known, ["session_id", "field_id"], "left").withColumn("outcome", outcome).drop("__s")


def as_json(states: DataFrame) -> DataFrame:
    """JS3: a session's state as one JSON text, its session_id kept (D6)."""
    row = F.struct("ord", "field_id", "label", "status", "value", "confidence")
    return states.groupBy("session_id").agg(F.to_json(F.struct(F.first("session_id").alias("session_id"), F.array_sort(F.collect_list(row)).alias("fields"))).alias("state"))


def from_json(texts: DataFrame) -> DataFrame:
    fields = "ord:int,field_id:string,label:string,status:string,value:string,confidence:double"
    parsed = F.from_json("state", f"session_id string, fields array<struct<{fields}>>")
    return texts.select(parsed.alias("s")).select("s.session_id", F.explode("s.fields").alias("f")).select("session_id", "f.*")


def windowed_messages(messages: DataFrame, n: int = V.MESSAGES_KEPT) -> DataFrame:
    """WIN8, JN18: the last n messages of a thread; results of calls that the window no longer holds go.

    (thread_id, seq, ..., tool_call_ids array, tool_call_id): a message without tool_call_id always stays.
    """
    kept = R.last_rows(messages, ["thread_id"], "seq", n)
    w = W.partitionBy("thread_id")
    calls = F.flatten(F.collect_list(F.coalesce("tool_call_ids", F.array().cast("array<string>"))).over(w))
    return kept.withColumn("__calls", calls).filter(F.col("tool_call_id").isNull() | F.array_contains("__calls", F.col("tool_call_id"))).drop("__calls")


def without_reasoning(messages: DataFrame) -> DataFrame:
    """Message projection: no reasoning column."""
    return messages.drop("reasoning", "reasoning_content")
