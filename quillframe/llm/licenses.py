"""License scans (operator 9), native: canonical digest lookup.

A text is normalised - lower case, copyright lines out, typographic marks and equivalent spellings unified,
punctuation and white space reduced to single spaces - and the SHA-256 digest of the whole result is looked up among
the digests of known licence texts, normalised the same way. One pass of built-in functions over the documents; the
known digests (one row a known text, their number checked) are broadcast, so no document is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.license_texts import DIGESTS, KNOWN

#: Known texts beyond this number are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 10_000

# typographic marks and their plain forms
MARKS_FROM = "‘’‚“”„–—−‐‑«»…·•"
MARKS_TO = "'''\"\"\"-----\"\"..."
#: Lines that name a holder: ``copyright`` with a (c), a year, a bracketed blank or ``by`` after it; ``(c)`` and ``copr`` with a year.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(portions )?(copyright([^a-z0-9\n]*(c\)|<|\[|by )|[^\n]*[0-9]{4})|(\(c\)|copr[. ])[^\n]*[0-9]{4})[^\n]*"
RESERVED = r"all rights reserved"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\xa0]+"
#: equivalent spellings: of a stem, in any word (licence, sublicence, relicencing), and of whole words
STEM = ("licenc", "licens")
SPELLINGS = (
    ("organisation", "organization"), ("organisations", "organizations"),
    ("authorised", "authorized"), ("favour", "favor"), ("behaviour", "behavior"), ("fulfil", "fulfill"), ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("analyse", "analyze"), ("judgement", "judgment"), ("https", "http"),
)


def normalized(text: Column) -> Column:
    out = F.replace(F.translate(F.lower(text), MARKS_FROM, MARKS_TO), F.lit("©"), F.lit("(c)"))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    out = F.concat(F.lit(" "), out, F.lit(" "))
    out = F.replace(out, F.lit(f" {RESERVED} "), F.lit(" "))
    out = F.replace(out, F.lit(STEM[0]), F.lit(STEM[1]))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(normalized(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_digest, license_id of the known texts; of texts with one digest the least id. ``known`` (id, text) replaces the library's own."""
    rows = spark.createDataFrame(list(KNOWN if known is None else known), "license_id string, text string").select(digest(F.col("text")).alias("license_digest"), "license_id")
    if known is None:
        rows = rows.unionByName(spark.createDataFrame([(d, i) for i, found in DIGESTS.items() for d in found], "license_digest string, license_id string"))
    return rows.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(spark: SparkSession, docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """Operator 9: doc_id, text_digest, license_id (null if the whole text is no known licence).

    Null text is empty; an empty text, and one of punctuation or copyright lines alone, has the empty text's digest, which is
    no licence. A very long text is normalised whole. Repeated rows are looked up each. An empty table gives no rows. Other columns are not read.
    """
    table = known_digests(spark, known)
    if (len(KNOWN) + sum(map(len, DIGESTS.values())) if known is None else len(known)) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    found = docs.select("doc_id", digest(F.col("text")).alias("text_digest"))
    return found.join(table, F.col("text_digest") == F.col("license_digest"), "left").select("doc_id", "text_digest", "license_id")


def oracle_sql(known: list[tuple[str, str]] = KNOWN, digests: dict[str, tuple[str, ...]] = DIGESTS) -> str:
    """The same in DuckDB's SQL."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"replace(translate(lower(coalesce({x}, '')), {quoted(MARKS_FROM)}, {quoted(MARKS_TO)}), '©', '(c)')"
        out = f"regexp_replace({out}, {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g') || ' '"
        out = f"replace(replace({out}, ' {RESERVED} ', ' '), {quoted(STEM[0])}, {quoted(STEM[1])})"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old} ', {quoted(f' {new} ')})"
        return f"sha256(trim({out}, ' '))"

    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in known)
    given = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, found in digests.items() for d in found)
    return (
        f"WITH listed AS (SELECT {form('text')} AS license_digest, license_id FROM (VALUES {rows}) AS k(license_id, text) UNION ALL SELECT license_digest, license_id FROM (VALUES {given}) AS g(license_id, license_digest)), "
        "known AS (SELECT license_digest, min(license_id) AS license_id FROM listed GROUP BY 1), "
        f"found AS (SELECT doc_id, {form('text')} AS text_digest FROM documents) "
        "SELECT doc_id, text_digest, license_id FROM found LEFT JOIN known ON text_digest = license_digest"
    )
