"""Driver queries: each applies one operator to a whole driver table, beside the same in DuckDB's SQL.

The driver's tables stand in for forms: an order is a field or a row, its lines are candidates, a user's events are
the rows of a table in order, a conversation is a chat thread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import extract, relational as R, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH c AS (SELECT user_id, event_id, event_type, value / 500 AS conf FROM events),
g AS (SELECT user_id, count(*) AS n_found, count(DISTINCT event_type) AS n_values, max(conf) AS mc,
             arg_max(event_type, struct_pack(a := conf, b := -event_id)) AS value,
             string_agg(DISTINCT left(event_type, 20), '+' ORDER BY left(event_type, 20)) AS vals,
             string_agg(event_type, ' + ' ORDER BY event_id) AS srcs FROM c GROUP BY 1)
SELECT user_id, value, CASE WHEN n_values > 1 THEN least(mc, 0.6) ELSE mc END AS confidence,
       CASE WHEN n_values > 1 THEN '多文件有不同值(' || vals || ')' ELSE srcs END AS source, n_values, n_found FROM g
""")
def candidate_merge(spark, d):
    """AGG2: one value a user from candidate event types."""
    c = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_type").alias("src"), (F.col("value") / 500).alias("conf"))
    return R.merge_candidates(c, "user_id", "event_id", "event_type", "conf", "src")


@query("""
WITH l AS (SELECT l_orderkey AS k, max(l_shipdate) AS d, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS d, 0 AS n FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(o.k, l.k) AS k,
  CASE WHEN o.k IS NULL OR (o.d IS NULL AND l.d IS NOT NULL) THEN l.d ELSE o.d END AS d,
  CASE WHEN o.k IS NULL OR (o.d IS NULL AND l.d IS NOT NULL) THEN l.n ELSE o.n END AS n
FROM o FULL OUTER JOIN l ON o.k = l.k
""")
def prefer_primary(spark, d):
    """JN4: order dates before line dates, with null swap."""
    o = table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"), F.lit(0).cast("long").alias("n"))
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("d"), F.count("*").alias("n"))
    return R.prefer_primary(o, line, "k", "d", ["n"])


@query("""
SELECT o_orderkey AS k, o_orderpriority AS label, v AS value, coalesce(c, 0.0) AS confidence
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS v, 0.75 AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def left_fill_missing(spark, d):
    """JN1, EXT6: every order, with its lines' value at the rule's confidence, else null at 0."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("label"))
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("value"), F.lit(0.75).cast("double").alias("confidence"))
    return R.left_fill(o, f, "k", {"confidence": 0.0})


@query("""
WITH keys AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type FROM part),
f AS (SELECT p_brand AS label, p_type AS raw, p_partkey AS id FROM part),
m AS (SELECT key, id, 0 AS tier FROM keys JOIN f ON label = key UNION ALL SELECT key, id, 1 FROM keys JOIN f ON raw = key),
rest AS (SELECT key FROM keys WHERE key NOT IN (SELECT key FROM m)),
lab AS (SELECT label, min(id) AS id FROM f GROUP BY 1),
m2 AS (SELECT * FROM m UNION ALL SELECT key, id, 2 FROM rest JOIN lab ON contains(lower(key), lower(label)) OR contains(lower(label), lower(key))),
b AS (SELECT key, arg_min(struct_pack(id := id, tier := tier), struct_pack(a := tier, b := id)) AS b FROM m2 GROUP BY 1)
SELECT keys.key AS key, b.b.id AS id, b.b.tier AS tier FROM keys LEFT JOIN b ON keys.key = b.key
""")
def tiered_resolve(spark, d):
    """JN3: part texts to parts by brand, type, then containment."""
    p = table(spark, d, "part")
    keys = p.select(F.col("p_name").alias("key")).union(p.select("p_brand")).union(p.select("p_type")).distinct()
    fields = p.select(F.col("p_brand").alias("label"), F.col("p_type").alias("raw"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"))
    return R.tiered_resolve(keys, fields, "key", "id", "ord", ["label", "raw"], "label")


_WORDS = ["green", "red", "blue", "steel", "large", "small", "a"]


@query(f"""
WITH w(i, w) AS (VALUES {', '.join(f"({i}, '{w}')" for i, w in enumerate(_WORDS))})
SELECT p_partkey, p_name, (SELECT arg_min(w, i) FROM w WHERE contains(p_name, w)) AS word, (SELECT min(i) FROM w WHERE contains(p_name, w)) AS word_ord FROM part
""")
def contains_match(spark, d):
    """JN2: the first of a few words that a part's name contains."""
    return R.first_contained(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", _WORDS)


@query("""
SELECT user_id, event_id, event_type,
  last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header_id
FROM events
""")
def asof_header(spark, d):
    """JN5, JN6, WIN1: the nearest signup before each event of a user."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return R.last_before(e, ["user_id"], "event_id", F.col("event_type") == "signup", F.col("event_id"), "header_id")


@query("""
WITH p AS (SELECT a.user_id, a.event_id, b.event_id AS pos, b.event_type AS label, b.value AS score, b.value >= 250 AS good
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) b
  ON a.user_id = b.user_id AND b.r BETWEEN a.r - 9 AND a.r - 1)
SELECT user_id, event_id, arg_max(label, struct_pack(a := good::INT, b := CASE WHEN good THEN 0.0 ELSE score END, c := pos)) AS header FROM p GROUP BY 1, 2
""")
def bounded_lookback(spark, d):
    """JN7-JN9, WIN2: the best header among a user's nine events before."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return R.best_look_back(e, ["user_id"], "event_id", 9, F.col("value"), F.col("value") >= 250, F.col("event_type"), "header").select("user_id", "event_id", "header")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, unnest(range(l_linenumber, 2 * l_linenumber))::BIGINT AS grid_col FROM l
""")
def span_join(spark, d):
    """JN10: a line as a cell that covers as many columns as its number."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return R.span_join(line, F.col("l_linenumber").cast("long"), F.col("l_linenumber").cast("long"), "grid_col")


@query("""
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey = orders.o_orderkey + 1 AND n.o_custkey % 10 = orders.o_custkey % 10)
""")
def anti_removal(spark, d):
    """JN11-JN14: orders without returned lines, and without a like order in the next row."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10).alias("c"))
    bad = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    above = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), "c")
    return R.without(R.without(o, bad, ["o_orderkey"]), above, ["o_orderkey", "c"]).select("o_orderkey", "o_custkey")


@query("""
WITH k AS (SELECT * FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4)
SELECT conv_id, turn, role FROM k WHERE role <> 'assistant'
   OR EXISTS (SELECT 1 FROM k u WHERE u.conv_id = k.conv_id AND u.role = 'user' AND u.turn = k.turn - 1)
""")
def orphan_semi(spark, d):
    """WIN8, JN18, STM5: the last four turns; an assistant turn stays only if the user turn that called for it is in the window."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    m = c.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", F.when(F.col("role") == "user", F.array((F.col("turn") + 1).cast("string"))).alias("tool_call_ids"), F.when(F.col("role") == "assistant", F.col("turn").cast("string")).alias("tool_call_id"))
    out = state.windowed_messages(m, 4)
    return out.select(F.col("thread_id").alias("conv_id"), F.col("seq").alias("turn"), "role")


@query("""
SELECT text_sha, first, members, repeat_count FROM (
  SELECT sha256(text) AS text_sha, min(doc_id) AS first, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members, count(*) AS repeat_count FROM documents GROUP BY 1)
""")
def dedup_first(spark, d):
    """AGG1: documents by whole text: first, members, count."""
    docs = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), "doc_id")
    out = R.dedup_first(docs, ["text_sha"], "doc_id")
    return out.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


@query("""
WITH s AS (SELECT l_orderkey, CASE WHEN l_discount * 10 >= 0.8 THEN 'confirmed' WHEN l_discount * 10 >= 0.4 THEN 'review' ELSE 'empty' END AS s FROM lineitem)
SELECT l_orderkey, count(*) AS total, count(*) FILTER (s = 'confirmed') AS confirmed, count(*) FILTER (s = 'review') AS review, count(*) FILTER (s = 'empty') AS empty,
  round(count(*) FILTER (s <> 'empty') * 100.0 / count(*), 1) AS fill_rate, bool_and(s <> 'empty') AS is_complete FROM s GROUP BY 1
""")
def status_progress(spark, d):
    """AGG3-AGG5, MT1, MT3: fill status of each order's lines."""
    return R.progress(table(spark, d, "lineitem").select("l_orderkey", "l_discount"), ["l_orderkey"], T.status_of(F.col("l_discount") * 10))


@query("""
SELECT l_returnflag, bucket, n, n::DOUBLE / sum(n) OVER (PARTITION BY l_returnflag) AS share
FROM (SELECT l_returnflag, least(floor((l_quantity - 1) / 10), 4)::INT AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2)
""")
def bucket_distribution(spark, d):
    """AGG6: lines by quantity bucket and their share."""
    bucket = F.least(F.floor((F.col("l_quantity") - 1) / 10), F.lit(4)).cast("int")
    return R.shares(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), bucket, ["l_returnflag"])


@query("""
SELECT k, lo, hi, n, hi - lo + 1 = n AS contiguous, CASE WHEN hi - lo + 1 = n THEN lo || '-' || hi END AS "range"
FROM (SELECT l_orderkey AS k, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1)
""")
def range_compress(spark, d):
    """AGG10: line numbers of an order as a range."""
    return R.compressed_ranges(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), ["k"], "l_linenumber")


@query("""
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
SELECT user_id, island, min(event_id) AS start_id, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2
""")
def islands(spark, d):
    """WIN4, WIN5, FLD8: runs of equal events of a user."""
    runs = R.islands(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])
    return runs.groupBy("user_id", "island").agg(F.min("event_id").alias("start_id"), F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS ch FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT conv_id, min(turn) AS turn, any_value(role) AS role, count(*) AS n_parts, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha FROM i GROUP BY conv_id, island
""")
def adjacent_merge(spark, d):
    """WIN10: neighbouring turns of one role as one."""
    out = R.merge_islands(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text", "\n")
    return out.select("conv_id", "turn", "role", "n_parts", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))


@query("""
SELECT user_id, event_id, coalesce(sum(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grid_start FROM events
""")
def prefix_sum(spark, d):
    """WIN3: where each event would start if its type's length were its span."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return R.running_start(e, ["user_id"], "event_id", F.length("event_type"), "grid_start").select("user_id", "event_id", "grid_start")


@query("SELECT p_partkey, floor((row_number() OVER (ORDER BY p_partkey) - 1) / 40)::BIGINT AS batch FROM part")
def batch_40(spark, d):
    """WIN9: parts in batches of 40."""
    return R.batches(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", "batch")


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority IN ('1-URGENT', '2-HIGH')) DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5
""")
def priority_topn(spark, d):
    """SRT3, SRT4: five orders a customer, urgent ones first."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return R.first_rows(o, ["o_custkey"], [F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").desc(), F.col("o_orderkey")], 5)


@query("""
SELECT doc_id, sha256(CASE WHEN length(text) > 10000 THEN left(text, 10000) || '...(截断)' ELSE text END) AS text_sha, length(text) > 10000 AS was_cut FROM documents
""")
def truncate_marker(spark, d):
    """SRT6: texts cut at 10,000 characters, with a marker."""
    docs = table(spark, d, "documents")
    cut = T.truncated("text", 10_000, "...(截断)")
    return docs.select("doc_id", F.sha2(cut.cast("binary"), 256).alias("text_sha"), (F.length("text") > 10_000).alias("was_cut"))


@query("""
WITH l AS (SELECT doc_id, i, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
p AS (SELECT doc_id, i, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM l WHERE contains(line, '|')),
c AS (SELECT doc_id, i, j, parts[j] AS term, rtrim(parts[j + 1], '，。,.;；') AS value FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM p))
SELECT doc_id, term, arg_min(value, struct_pack(i := i, j := j)) AS value FROM c WHERE value <> '' AND length(value) < 100 AND value <> term GROUP BY 1, 2
""")
def rule_extract_lines(spark, d):
    """EXT1 (second strategy), SRC13: in lines with pipes, the cell after a term."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return extract.pipe_pairs(docs, "doc_id", "text").groupBy("doc_id", "term").agg(F.min_by("value", F.struct("line", "cell")).alias("value"))


@query("""
WITH t AS (SELECT n_nationkey, 'T' || n_regionkey || '_R' || n_nationkey || '_C' || (n_nationkey % 4) || CASE WHEN n_nationkey % 3 = 0 THEN '_L' || (n_nationkey % 5) ELSE '' END AS id FROM nation
           UNION ALL SELECT n_nationkey + 100, 'T1_R' || n_nationkey || '_CHK' FROM nation)
SELECT n_nationkey, id, CASE WHEN h THEN regexp_extract(id, '^T([0-9]+)_R', 1)::INT END AS t, CASE WHEN h THEN regexp_extract(id, '_R([0-9]+)_C', 1)::INT END AS r,
 CASE WHEN h THEN regexp_extract(id, '_C([0-9]+)', 1)::INT END AS c, CASE WHEN h THEN coalesce(try_cast(regexp_extract(id, '_L([0-9]+)', 1) AS INT), -1) END AS line
FROM (SELECT *, regexp_matches(id, '^T[0-9]+_R[0-9]+_C[0-9]+') AS h FROM t)
""")
def field_id_parse(spark, d):
    """RX1: positional ids into their parts."""
    n = table(spark, d, "nation")
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("_L"), (F.col("n_nationkey") % 5).cast("string"))).otherwise("")
    a = n.select("n_nationkey", F.concat(F.lit("T"), F.col("n_regionkey").cast("string"), F.lit("_R"), F.col("n_nationkey").cast("string"), F.lit("_C"), (F.col("n_nationkey") % 4).cast("string"), line).alias("id"))
    b = n.select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat(F.lit("T1_R"), F.col("n_nationkey").cast("string"), F.lit("_CHK")).alias("id"))
    return a.union(b).select("n_nationkey", "id", T.field_id_parts("id").alias("p")).select("n_nationkey", "id", "p.*")


@query("""
SELECT n_nationkey, 'name' AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'second' ELSE n_name END AS value FROM nation
UNION ALL SELECT n_nationkey, 'region：', '' FROM nation WHERE false
UNION ALL SELECT n_nationkey, 'region', n_regionkey || ':x' FROM nation
""")
def kv_parse(spark, d):
    """STR5: label and value lines into pairs, the last of equal labels wins."""
    n = table(spark, d, "nation")
    extra = F.when(F.col("n_nationkey") % 2 == 0, F.lit("\nname: second")).otherwise("")
    text = F.concat(F.lit("name： "), "n_name", F.lit("\nno pair\nregion："), F.col("n_regionkey").cast("string"), F.lit(":x"), extra)
    return n.select("n_nationkey", F.explode(T.label_value_pairs(text)).alias("key", "value"))


@query("SELECT page_id, sha256(regexp_replace('a' || chr(7) || html || chr(127), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) AS clean_sha FROM pages")
def sanitize(spark, d):
    """STR6: control characters out."""
    p = table(spark, d, "pages")
    dirty = F.concat(F.lit("a\x07"), "html", F.lit("\x7f"))
    return p.select("page_id", F.sha2(T.sanitize(dirty).cast("binary"), 256).alias("clean_sha"))


@query("""
SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS html_sha FROM pages
""")
def html_escape(spark, d):
    """STR7: HTML escapes."""
    return table(spark, d, "pages").select("page_id", F.sha2(T.html_escape("html").cast("binary"), 256).alias("html_sha"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS n_items FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL, 0 FROM events WHERE event_id % 4 = 3")
def json_ladder(spark, d):
    """JS1: arrays bare, fenced, in prose, or not there."""
    e = table(spark, d, "events").select("event_id", "props")
    one = F.concat(F.lit("["), "props", F.lit("]"))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, one).when(k == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), one, F.lit(" done"))).otherwise("nothing")
    items = F.from_json(T.json_ladder(raw), "array<struct<k:bigint>>")
    return e.select("event_id", F.get(items, F.lit(0))["k"].alias("k"), F.size(items).cast("long").alias("n_items"))


@query("""
SELECT p_partkey, i::BIGINT AS ord, w AS part FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ','), ',')) AS w, generate_subscripts(string_split(replace(p_name, ' ', ','), ','), 1) - 1 AS i FROM part) WHERE trim(w) <> ''
""")
def split_expand(spark, d):
    """FIL1, STR9: a comma text onto ordinal columns."""
    p = table(spark, d, "part")
    parts = T.comma_parts(F.replace(F.col("p_name"), F.lit(" "), F.lit("，")))
    out = p.select("p_partkey", F.posexplode(parts).alias("ord", "part")).filter("part <> ''")
    return out.select("p_partkey", F.col("ord").cast("long").alias("ord"), "part")


_ALTERED = """
WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 13 <> 0)
"""


@query(_ALTERED + """
SELECT coalesce(a.k, b.k) AS k, a.v AS before, b.v AS after, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'added' WHEN a.v = '' AND b.v = '' THEN 'still_empty' WHEN a.v = '' THEN 'filled'
  WHEN b.v = '' THEN 'cleared' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS kind FROM a FULL OUTER JOIN b ON a.k = b.k
""")
def diff_partition(spark, d):
    """JN15, SET3: template against filled copy, cell by cell."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    a = o.filter("k % 11 <> 0").select("k", F.when(F.col("k") % 5 == 0, "").otherwise(F.col("s")).alias("v"))
    b = o.filter("k % 13 <> 0").select("k", F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 4 == 0, "X").otherwise(F.col("s")).alias("v"))
    return R.compared(a, b, ["k"], "v")


@query("""
WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS before, b.n AS after, CASE WHEN b.n IS NULL THEN 'error' WHEN b.n < a.n THEN 'error' WHEN b.n > a.n THEN 'warning' ELSE 'ok' END AS severity FROM a FULL OUTER JOIN b ON a.k = b.k
""")
def dim_compare(spark, d):
    """SET6, VAL9: row counts of template and output tables; fewer rows are an error."""
    line = table(spark, d, "lineitem")
    a = line.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    b = line.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_linenumber").alias("n"))
    out = a.withColumnRenamed("n", "before").join(b.withColumnRenamed("n", "after"), "k", "full_outer")
    severity = F.when(F.col("after").isNull() | (F.col("after") < F.col("before")), "error").when(F.col("after") > F.col("before"), "warning").otherwise("ok")
    return out.withColumn("severity", severity)


@query("""
SELECT l_orderkey, count(*) AS n_rows, count(*) FILTER (l_quantity > 45) AS n_errors, count(*) FILTER (l_discount > 0.09) AS n_warnings, count(*) FILTER (l_quantity > 45) = 0 AS passed FROM lineitem GROUP BY 1
""")
def validation_rollup(spark, d):
    """AGG12, VAL1, VAL6: passed if no rule of severity error hits."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    hits = lambda c: F.count_if(c)
    out = line.groupBy("l_orderkey").agg(F.count("*").alias("n_rows"), hits(F.col("l_quantity") > 45).alias("n_errors"), hits(F.col("l_discount") > 0.09).alias("n_warnings"))
    return out.withColumn("passed", F.col("n_errors") == 0)


@query("""
SELECT CASE WHEN contains(o_orderpriority, 'URGENT') OR contains(o_orderpriority, 'HIGH') THEN 'must_fill' WHEN contains(o_orderpriority, 'MEDIUM') THEN 'computable' WHEN contains(o_orderpriority, 'LOW') THEN 'inheritable' ELSE 'optional' END AS category,
 count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1
""")
def checklist_counts(spark, d):
    """CL1, AGG7: fields by category of the first keyword."""
    rules = [("must_fill", ["URGENT", "HIGH"]), ("computable", ["MEDIUM"]), ("inheritable", ["LOW"])]
    o = table(spark, d, "orders").select("o_orderkey", T.matched_category(F.col("o_orderpriority"), rules, "optional").alias("category"))
    return o.groupBy("category").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0")
def set_diff(spark, d):
    """SET2: asked-for keys that were not found."""
    found = table(spark, d, "supplier").filter("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return R.without(table(spark, d, "nation").select("n_nationkey"), found, ["n_nationkey"])


@query("""
WITH s AS (SELECT user_id, event_id, event_type, value / 500 AS c, event_type || (event_id % 7) AS v FROM events),
f AS (SELECT *, min(CASE WHEN c >= 0.99 THEN event_id END) OVER (PARTITION BY user_id, event_type) AS stop FROM s)
SELECT user_id, event_type, arg_max(v, event_id) AS value, arg_max(c, event_id) AS confidence, CASE WHEN max(stop) IS NULL THEN 'filled' ELSE 'confirmed' END AS status
FROM f WHERE stop IS NULL OR event_id <= stop GROUP BY 1, 2
""")
def state_fold(spark, d):
    """STM2, STM3: field writes folded in order; a confirmed field takes no later write."""
    e = table(spark, d, "events")
    w = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("field_id"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("value"), (F.col("value") / 500).alias("confidence"))
    out = state.fold(w, confirm_from=0.99)
    return out.select(F.col("session_id").cast("long").alias("user_id"), F.col("field_id").alias("event_type"), "value", "confidence", "status")


@query("""
WITH g AS (SELECT c_mktsegment || '_' || n AS label, v FROM (SELECT c_mktsegment, c_nationkey % 5 AS n, count(*) AS v FROM customer GROUP BY 1, 2))
SELECT split_part(label, '_', 1) AS base, string_agg(split_part(label, '_', 2), ',' ORDER BY split_part(label, '_', 2)) AS suffixes, count(*) AS n, sum(v)::BIGINT AS total FROM g GROUP BY 1
""")
def prefix_grouping(spark, d):
    """AGG8, AGG9: fields named base_suffix grouped by base."""
    c = table(spark, d, "customer").groupBy("c_mktsegment", (F.col("c_nationkey") % 5).alias("n")).agg(F.count("*").alias("v"))
    fields = c.select(F.concat_ws("_", "c_mktsegment", F.col("n").cast("string")).alias("label"), "v")
    two = F.split("label", "_", 2)
    out = fields.select(two[0].alias("base"), two[1].alias("suffix"), "v").groupBy("base").agg(F.array_sort(F.collect_list("suffix")).alias("s"), F.count("*").alias("n"), F.sum("v").alias("total"))
    return out.select("base", F.array_join("s", ",").alias("suffixes"), "n", "total")
