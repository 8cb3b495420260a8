"""Text operators of a content catalog: links, concept tokens, sections, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r"\]\(([^)]+)\)"
CONCEPT = r"\[\[([^|\]]+)\|([^\]]+)\]\]"
SECTION = r"<!-- section:([a-z0-9-]+) -->"
UNSAFE = r"(?i)<script|<iframe|javascript:|onerror\s*="


def links(markdown: Column) -> Column:
    """Targets of Markdown links, in order."""
    return F.regexp_extract_all(markdown, F.lit(LINK), F.lit(1))


def without_code(markdown: Column) -> Column:
    """The text without fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(markdown, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")


def plain_concepts(markdown: Column) -> Column:
    """Concept tokens [[id|label]] replaced by their labels."""
    return F.regexp_replace(markdown, CONCEPT, "$2")


def concept_ids(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(CONCEPT), F.lit(1))


def first_fence(markdown: Column) -> Column:
    """The body of the first fenced block; empty without one."""
    return F.regexp_extract(markdown, r"(?s)```[a-z]*\n(.*?)\n```", 1)


def sections(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, ord, section, body): text behind each marker; ord 0 with a null section is text before the first."""
    parts = F.split(F.col(markdown), r"<!-- section:[a-z0-9-]+ -->")
    names = F.regexp_extract_all(F.col(markdown), F.lit(SECTION), F.lit(1))
    each = docs.select(key, names.alias("names"), F.posexplode(parts).alias("ord", "body"))
    return each.select(key, "ord", F.when(F.col("ord") > 0, F.get("names", F.col("ord") - 1)).alias("section"), F.trim("body").alias("body"))


def classify_links(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with ``target`` labelled external, internal, broken (no such internal id) or unsafe."""
    rows = found.withColumn("name", F.when(F.col("target").rlike(r"^/[^/?#]+$"), F.substring("target", 2, 1 << 20)))
    seen = rows.join(known.select(F.col("id").alias("name"), F.lit(True).alias("found")).distinct(), "name", "left")
    label = F.when(F.col("target").startswith("https://"), "external").when(F.col("name").isNull(), "unsafe").when(F.col("found"), "internal").otherwise("broken")
    return seen.withColumn("label", label).drop("name", "found")


def search(index: DataFrame, q: str, limit: int = 80, order: list[str] | None = None) -> DataFrame:
    """The first ``limit`` entries in index order (column ``position`` if not said otherwise) whose text holds the query, case ignored."""
    return index.filter(F.lower("text").contains(q.lower())).orderBy(*(order or ["position"])).limit(limit)


def snippet(text: Column, q: str) -> Column:
    """200 characters from 55 before the hit, Markdown marks removed. The offset is that of the unstripped text."""
    at = F.greatest(F.lit(0), F.locate(q.lower(), F.lower(text)) - 1 - 55)
    return F.substring(F.regexp_replace(text, r"[#*`]", ""), at + 1, F.lit(200))


def checksum_status(content: Column, digest: Column) -> Column:
    """How bytes compare to a recorded SHA-256: equal, equal_after_newlines (CRLF read as LF), different."""
    plain = F.regexp_replace(content, "\r\n", "\n")
    return F.when(F.sha2(content, 256) == digest, "equal").when(F.sha2(plain, 256) == digest, "equal_after_newlines").otherwise("different")
