"""Licence scans: a hash join of canonical digests of whole texts, of blocks cut from texts, and of one-line notices, to
known licences.

Canonical form: copyright lines go, letters are lower-cased, everything but letters and digits becomes one space, and
spellings that licences treat as equal are unified. DataFrame expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import DIGESTS, EQUIVALENT, NOTICES, TEXTS
from .shared import column

#: A line that names a copyright and a holder or year, after lower-casing; both in Java's and RE2's syntax.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n(©]*(?:(?:copyright|copr)[ \t]*(?:\(c\)|©|:|by |[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$"
)
#: Every one-line notice holds one of these; lines without them are not digested.
NOTICE_WORDS = "licen|rights reserved"
#: What stands between paragraphs: lines without letters or digits, such as those of an empty comment.
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: Kinds of what is digested: the text, its blocks, its lines.
TEXT, BLOCK, LINE = 0, 1, 2


def canonical(text: Column) -> Column:
    text = F.lower(F.coalesce(text, F.lit("")))
    text = F.regexp_replace(text, COPYRIGHT_LINE, "")
    words = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")
    text = F.concat(F.lit(" "), words, F.lit(" "))
    for other, one in EQUIVALENT:
        text = F.replace(text, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(text)


def block_starts(texts=TEXTS) -> str:
    """An expression that the first paragraph of every known text matches, by its first three words."""
    found = set()
    for _, text in texts:
        words = re.findall(r"[a-z0-9]+", text.lower())[:3]
        found.add(r"[^\p{L}\p{N}]+".join(w.replace("license", "licen[cs]e") for w in words))
    return "|".join(sorted(found))


def block_lengths(texts=TEXTS) -> list[int]:
    """How many paragraphs the known texts have."""
    return sorted({len(t.split("\n\n")) for _, t in texts})


def known(spark, texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """(unit, short, license) of the known texts and notices: as many rows as the lists have."""
    rows = [(a, t, False) for a, t in texts] + [(a, t, True) for a, t in notices]
    some = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("license", "text", "short")))) for r in rows))
    table = spark.range(1).select(F.inline(some))
    table = table.select(F.sha2(canonical(F.col("text")), 256).alias("unit"), "short", "license")
    if digests:
        rows = ((d, False, a) for a, d in digests)
        more = (F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("unit", "short", "license")))) for r in rows)
        table = table.unionByName(spark.range(1).select(F.inline(F.array(*more))))
    return table.groupBy("unit", "short").agg(F.min("license").alias("license"))


def scan(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", texts=TEXTS, notices=NOTICES, digests=DIGESTS
) -> DataFrame:
    """One row per row of docs: doc_id, digest, license (of the whole text, else null), blocks and notices.

    blocks lists the licences whose whole text stands in the text as paragraphs of its own, notices those of the lines that
    are known notices, both in order, without repeats, joined by commas (empty if none). Null and empty texts have the digest
    of the empty text and no licence; repeated rows each keep a row; an empty table gives no rows; other columns of docs are
    not read. The known digests are broadcast: as many as the fixed lists have. Of documents only ids and digests are
    shuffled.
    """
    if any(not re.search(NOTICE_WORDS, t.lower()) for _, t in notices):
        raise ValueError(f"a notice without any of {NOTICE_WORDS}")
    starts, lengths = block_starts(texts), block_lengths(texts)
    rows = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    digest = lambda x: F.sha2(canonical(x), 256)
    paragraphs, body = F.split("text", BETWEEN), F.col("p")
    begins = F.filter(
        F.transform(body, lambda x, i: F.when(F.lower(x).rlike(starts), i)), lambda i: i.isNotNull()
    )  # where a known text may begin
    blocks = F.flatten(F.transform(begins, lambda i: F.transform(
        F.filter(F.array(*map(F.lit, lengths)), lambda n: i + n <= F.size(body)),
        lambda n: digest(F.array_join(F.slice(body, i + 1, n), "\n\n")),
    )))
    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(NOTICE_WORDS))

    def units(kind: int, each: Column) -> Column:
        return F.transform(each, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("n"), x.alias("unit")))

    whole, none = digest(F.col("text")), F.array().cast("array<string>")
    cut = F.when(F.lower("text").rlike(starts), paragraphs).otherwise(none).alias("p")
    parts = blocks.alias("b"), F.transform(lines, digest).alias("l")
    rows = rows.select("doc_id", "text", cut)
    rows = rows.select("doc_id", F.xxhash64("text").alias("raw"), whole.alias("digest"), *parts)
    every = F.concat(units(TEXT, F.array("digest")), units(BLOCK, F.col("b")), units(LINE, F.col("l")))
    each = rows.select("doc_id", "raw", "digest", F.inline(every)).withColumn("short", F.col("kind") == LINE)
    found = each.join(F.broadcast(known(docs.sparkSession, texts, notices, digests)), ["unit", "short"], "left")

    def named(kind: int) -> Column:
        hit = (F.col("kind") == kind) & F.col("license").isNotNull()
        hits = F.array_sort(F.collect_list(F.when(hit, F.struct("n", "license"))))
        return F.array_join(F.array_distinct(F.transform(hits, lambda x: x["license"])), ",")

    # Rows that are the same are one group, and come out as often as they went in.
    grouped = found.groupBy("doc_id", "raw", "digest").agg(
        F.max(F.when(F.col("kind") == TEXT, F.col("license"))).alias("license"),
        named(BLOCK).alias("blocks"), named(LINE).alias("notices"), F.count_if(F.col("kind") == TEXT).alias("copies"),
    )
    out = grouped.select("doc_id", "digest", "license", "blocks", "notices", F.explode(F.sequence(F.lit(1), "copies")))
    return out.drop("col")


def scan_sql(texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), {q(COPYRIGHT_LINE)}, '', 'g')"
        x = f"(' ' || regexp_replace(replace({x}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"
        for other, one in EQUIVALENT:
            x = f"replace({x}, {q(f' {other} ')}, {q(f' {one} ')})"
        return f"trim({x}, ' ')"

    values = lambda rows: ", ".join(f"({q(a)}, {q(b)})" for a, b in rows)
    more = f"UNION ALL SELECT d, l FROM (VALUES {values(digests)}) v(l, d)" if digests else ""
    lengths = ", ".join(f"({n})" for n in block_lengths(texts))
    named = lambda table: f"""SELECT r, string_agg(license, ',' ORDER BY n) AS names
  FROM (SELECT r, license, min(n) AS n FROM {table} GROUP BY 1, 2) GROUP BY 1"""  # noqa: E731
    return f"""WITH whole AS (SELECT digest, min(l) AS license FROM (
  SELECT sha256({canon("t")}) AS digest, l FROM (VALUES {values(texts)}) v(l, t) {more}) GROUP BY 1),
short AS (SELECT sha256({canon("t")}) AS digest, min(l) AS license FROM (VALUES {values(notices)}) v(l, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canon("text")}) AS digest FROM documents),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
hit AS (SELECT r, license, n FROM (
  SELECT r, n, sha256({canon("t")}) AS digest FROM line WHERE regexp_matches(lower(t), '{NOTICE_WORDS}')) JOIN short USING (digest)),
p AS (SELECT r, string_split_regex(text, {q(BETWEEN)}) AS p FROM d WHERE regexp_matches(lower(text), {q(block_starts(texts))})),
b AS (SELECT r, i * 100 + n AS n, array_to_string(p[i : i + n - 1], chr(10) || chr(10)) AS t
  FROM (SELECT r, p, unnest(generate_series(1, len(p))) AS i FROM p), (VALUES {lengths}) v(n)
  WHERE i + n - 1 <= len(p) AND regexp_matches(lower(p[i]), {q(block_starts(texts))})),
block AS (SELECT r, license, n FROM (SELECT r, n, sha256({canon("t")}) AS digest FROM b) JOIN whole USING (digest)),
notices AS ({named("hit")}), blocks AS ({named("block")})
SELECT doc_id, digest, license, coalesce(blocks.names, '') AS blocks, coalesce(notices.names, '') AS notices
FROM d LEFT JOIN whole USING (digest) LEFT JOIN blocks USING (r) LEFT JOIN notices USING (r)"""
