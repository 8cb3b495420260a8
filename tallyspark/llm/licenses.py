"""License scan by a positional rare-token index (operator 3). DataFrame functions only.

Templates are licence texts, notices and naming lines (``license_texts``), as word sequences with a label.
Document frequencies of all template words over the whole corpus give their IDF; each template is indexed
under its words of highest IDF: word -> (template, position). A file's words that are in the index are looked
up; a posting says where in the file the template would start. Postings are intersected by that start: a
template is tried only where two of them agree (one, if the template has only one). Starts are then verified:
the words of the template's key phrases must all stand at their relative positions, and enough IDF weight of
all its words must.

A base phrase is a template whose every word is key, indexed under one word it cannot do without, so
all its places are found.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.license_texts import TEXTS

#: Words before lower-casing: runs of ASCII letters and digits and of all other characters from U+0080 on.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words under which a template is indexed, and the share of IDF weight that must match.
RARE_WORDS, LEAST_SCORE = 3, 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[bool, ...]
    base: bool = False


def phrase(label: str, text: str) -> Template:
    words = tuple(text.split())
    return Template(label, words, (True,) * len(words), base=True)


def template(label: str, text: str) -> Template:
    """Key phrases stand in brackets."""
    words, key, inside = [], [], False
    for part in re.findall(r"[a-z0-9]+|[][]", text.lower()):
        if part in "[]":
            inside = part == "["
        else:
            words.append(part)
            key.append(inside)
    return Template(label, tuple(words), tuple(key))


#: Fixed values of the task.
BASE = (
    phrase("mit", "under the mit license"),
    phrase("apache-2", "apache license version 2"),
    phrase("cc-by-nc", "cc by nc"),
)

OWN = tuple(template(label, text) for label, text in TEXTS)


def file_words(text: str = "text") -> Column:
    return F.regexp_extract_all(common.whole_text(text), F.lit(TOKEN), F.lit(0))


def word_idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each template word over all documents; as many numbers as templates have words. An empty word
    that every document gets counts the documents in the same pass."""
    known = F.filter("words", lambda w: F.lower(w).isin(vocabulary) & (F.length(w) == F.octet_length(w)))
    found = docs.select(file_words().alias("words")).select(F.explode(F.array_append(F.array_distinct(F.transform(known, F.lower)), F.lit(""))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def rare_words(templates: list[Template], idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """The index: (template, position) of each of the words of highest IDF of a template, one of a base phrase."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for i, t in enumerate(templates):
        rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[: 1 if t.base else RARE_WORDS]
        for at, w in enumerate(t.words):
            if w in rare:
                postings.setdefault(w, []).append((i, at))
    return postings


def license_scan(docs: DataFrame, base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN) -> DataFrame:
    """Licence phrases and labels of each whole text.

    Gives (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): all places of base
    phrases (overlaps count), smallest and largest start (null without one), labels of base phrases and of
    all templates (distinct, sorted, comma-joined; empty string without any), and the largest share of IDF
    weight of a verified template (0 without one, 1 for a base phrase). A missing text has no words;
    repeated rows give repeated results; other columns are not read. An empty table gives no rows.
    """
    templates = [*base, *own]
    idf = word_idf(docs, sorted({w for t in templates for w in t.words}))
    postings = rare_words(templates, idf)
    tried = [0] * len(templates)
    for t, _ in (x for found in postings.values() for x in found):
        tried[t] = min(2, tried[t] + 1)
    index = F.create_map(*[x for w, found in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(i).alias("t"), F.lit(at).alias("at")) for i, at in found]))])
    shapes = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, t.key)).alias("key"), F.array(*[F.lit(idf[w]) for w in t.words]).alias("weight"), F.lit(sum(idf[w] for w in t.words)).alias("total")) for t in templates])
    needed = F.array(*map(F.lit, tried))
    fold = lambda w: F.translate(w, UPPER, LOWER)
    word = lambda at: F.get("words", at)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), file_words().alias("words"))
    places = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda at: F.lower(word(at)).isin(sorted(postings)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("places", places)
    # A start is one number, template * 2**32 + place + 2**31: plain numbers sort and get distinct fast.
    packed = F.flatten(F.transform("places", lambda p: F.transform(F.coalesce(F.try_element_at(index, fold(word(p))), F.array().cast("array<struct<t:int,at:int>>")), lambda x: F.shiftleft(x["t"].cast("long"), 32) + (p - x["at"]) + (1 << 31))))
    rows = rows.withColumn("proposed", F.array_sort(packed))
    agreed = F.filter("proposed", lambda x, i: (F.get(needed, F.shiftright(x, 32).cast("int")) == 1) | (F.get("proposed", i + 1) == x))
    rows = rows.withColumn("starts", F.transform(F.array_distinct(agreed), lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("t"), (x.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int").alias("start"))))

    def verified(x):
        shape = F.get(shapes, x["t"])
        same = F.transform(shape["words"], lambda w, k: fold(F.coalesce(word(x["start"] + k), F.lit(""))) == w)
        key = F.forall(F.zip_with(same, shape["key"], lambda a, must: a | ~must), lambda ok: ok)
        weight = F.aggregate(F.zip_with(same, shape["weight"], lambda a, w: F.when(a, w).otherwise(0.0)), F.lit(0.0), lambda acc, w: acc + w)
        return F.struct(x["start"].alias("start"), shape["label"].alias("label"), shape["base"].alias("base"), ((x["start"] >= 0) & key).alias("sure"), (weight / shape["total"]).alias("score"))

    rows = rows.withColumn("tried", F.transform("starts", verified))
    rows = rows.withColumn("found", F.filter("tried", lambda x: x["sure"] & (x["score"] >= LEAST_SCORE)))
    rows = rows.withColumn("based", F.filter("found", lambda x: x["base"]))
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    start = F.transform("based", lambda x: x["start"].cast("long"))
    best = F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size("based").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), label("based").alias("base_labels"), label("found").alias("labels"), best.alias("score"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.documents(spark, sf_dir))
