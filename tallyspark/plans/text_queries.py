"""Queries of text, links, search, sources, sinks and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.rules import units_text
from tallyspark.functions.iterate import cut
from tallyspark.functions.scratch import scratch, staged
from tallyspark.operators import catalog as C
from tallyspark.operators import resolve as R
from tallyspark.operators import search as S
from tallyspark.operators import text as T
from tallyspark.plans import publish as P
from tallyspark.plans import views as V
from tallyspark.plans.register import registry
from tallyspark.plans import resolver_queries as RESOLVER
from tallyspark.plans.learner_queries import SQL as LEARNER_SQL
from tallyspark.plans.views import table
from tallyspark.sources import readers
from tallyspark.streaming import jobs

QUERIES, SQL, query = registry()

_ANCHOR = '<a href="([^"]+)">([^<]*)</a>'
_MD = f"md AS (SELECT page_id, regexp_replace(html, '{_ANCHOR}', '[\\2](\\1)', 'g') AS md FROM pages)"


def _markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", _ANCHOR, "[$2]($1)").alias("md"))


@query("link_extract", f"WITH {_MD} SELECT page_id, unnest(regexp_extract_all(md, '\\]\\(([^)]+)\\)', 1)) AS target FROM md")
def link_extract(spark, sf_dir):
    return _markdown(spark, sf_dir).select("page_id", F.explode(T.links(F.col("md"))).alias("target"))


@query("link_classify_resolve", f"WITH {_MD}, l AS (SELECT page_id, unnest(regexp_extract_all(md, '\\]\\(([^)]+)\\)', 1)) AS target FROM md), k AS (SELECT DISTINCT unnest(string_split(url, '/')) AS id FROM pages UNION SELECT source FROM documents) SELECT page_id, target, CASE WHEN starts_with(target, 'https://') THEN 'external' WHEN NOT regexp_matches(target, '^/[^/?#]+$') THEN 'unsafe' WHEN substr(target, 2) IN (SELECT id FROM k WHERE id IS NOT NULL) THEN 'internal' ELSE 'broken' END AS label FROM l")
def link_classify_resolve(spark, sf_dir):
    """Internal names are the parts of all page addresses and the sources of documents."""
    parts = table(spark, sf_dir, "pages").select(F.explode(F.split("url", "/")).alias("id"))
    return T.classify_links(link_extract(spark, sf_dir), parts.union(table(spark, sf_dir, "documents").select("source")))


@query("unsafe_markup_rule", "SELECT page_id, regexp_matches(html, '(?i)<script|<iframe|javascript:|onerror\\s*=') AS unsafe FROM pages")
def unsafe_markup_rule(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike(T.UNSAFE).alias("unsafe"))


@query("https_url_rule", "SELECT page_id, regexp_matches(url, '^https://[^/@?#]+([/?#]|$)') AS allowed FROM pages")
def https_url_rule(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.https_url(F.col("url")).alias("allowed"))


@query("safe_path_rule", "WITH p AS (SELECT page_id, substr(url, 9) AS path FROM pages) SELECT page_id, path, NOT contains(path, '\\') AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda s: s = '' OR ends_with(s, '.') OR regexp_matches(s, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$'))) AS safe FROM p")
def safe_path_rule(spark, sf_dir):
    path = F.substring("url", 9, 1 << 20)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), C.safe_path(path).alias("safe"))


@query("strip_code_spans", "SELECT page_id, length(regexp_replace(replace(html, '<p>', '`'), '`[^`\\n]*`', '', 'g')) AS chars FROM pages")
def strip_code_spans(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(T.without_code(F.replace("html", F.lit("<p>"), F.lit("`")))).cast("long").alias("chars"))


_TOKENS = "tk AS (SELECT doc_id, 'a [[' || lang || '|' || source || ']] b [[x|' || lang || ']]' AS md FROM documents)"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a [["), "lang", F.lit("|"), "source", F.lit("]] b [[x|"), "lang", F.lit("]]")).alias("md"))


@query("inline_concepts", f"WITH {_TOKENS} SELECT doc_id, concept, concept IN (SELECT DISTINCT lang FROM documents WHERE lang <> 'de') AS known FROM (SELECT doc_id, unnest(regexp_extract_all(md, '\\[\\[([^|\\]]+)\\|([^\\]]+)\\]\\]', 1)) AS concept FROM tk)")
def inline_concepts(spark, sf_dir):
    known = table(spark, sf_dir, "documents").filter("lang <> 'de'").select(F.col("lang").alias("concept")).distinct().withColumn("known", F.lit(True))
    found = _tokens(spark, sf_dir).select("doc_id", F.explode(T.concept_ids(F.col("md"))).alias("concept"))
    return found.join(known, "concept", "left").select("doc_id", "concept", F.coalesce("known", F.lit(False)).alias("known"))


@query("plain_concepts", "SELECT doc_id, 'a ' || source || ' b ' || lang AS text FROM documents")
def plain_concepts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", T.plain_concepts(F.col("md")).alias("text"))


_FENCED = "'intro' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'more' || chr(10) || '```' || chr(10) || 'other' || chr(10) || '```'"


@query("fence_extract", f"SELECT doc_id, sha256(regexp_extract({_FENCED}, '(?s)```[a-z]*\\n(.*?)\\n```', 1)) AS digest, sha256(regexp_extract(text, '(?s)```[a-z]*\\n(.*?)\\n```', 1)) AS own FROM documents")
def fence_extract(spark, sf_dir):
    """The first block of each whole text put into a fence (it ends at a fence of its own), and of the text as it is."""
    md = F.concat(F.lit("intro\n```python\n"), "text", F.lit("\n```\nmore\n```\nother\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.first_fence(md), 256).alias("digest"), F.sha2(T.first_fence(F.col("text")), 256).alias("own"))


@query("content_match", "WITH m AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS recorded FROM documents) SELECT doc_id, sha256(text) = recorded AS matches FROM documents JOIN m USING (doc_id)")
def content_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    manifest = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("recorded"))
    return docs.join(manifest, "doc_id").select("doc_id", (F.sha2("text", 256) == F.col("recorded")).alias("matches"))


@query("checksum_audit", "WITH c AS (SELECT doc_id, sha256(text) AS recorded, CASE doc_id % 3 WHEN 0 THEN text || '.' WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS content FROM documents) SELECT doc_id, CASE WHEN sha256(content) = recorded THEN 'equal' WHEN sha256(replace(content, chr(13) || chr(10), chr(10))) = recorded THEN 'equal_after_newlines' ELSE 'different' END AS status FROM c")
def checksum_audit(spark, sf_dir):
    content = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.checksum_status(content, F.sha2("text", 256)).alias("status"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("manifest_of_inputs")
def manifest_of_inputs(spark, sf_dir):
    """Rows and content id of each table: from its rows, so that a table of any size and number of files has one."""
    rows = ((name, table(spark, sf_dir, name)) for name in TABLES)
    return reduce(DataFrame.unionByName, [P.content_id(t).crossJoin(t.agg(F.count("*").alias("rows"))).withColumn("table", F.lit(name)) for name, t in rows])


@query("manifest_row_counts", " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS rows FROM {name}" for name in TABLES))
def manifest_row_counts(spark, sf_dir):
    """The counts of the manifest, which SQL can say; digests it cannot."""
    return manifest_of_inputs(spark, sf_dir).select("table", "rows")


#: Entry kinds in index order: courses, lesson sections, their glossary, beats, extension cards, concepts of modules, roadmaps,
#: playbooks, and then own notes.
_KINDS = ("region", "document", "nation", "page", "turn", "part", "supplier", "benchmark", "note")
_INDEX = """ix AS (SELECT 0 AS kind, 'region' AS type, r_regionkey AS id, 0 AS part, r_name AS title, r_name || ' region' AS text, '#/course/' || r_regionkey AS href FROM region
UNION ALL SELECT 1, 'document', doc_id, 0, substr(text, 1, 30), text, '#/lesson/' || doc_id || '/' || source FROM documents
UNION ALL SELECT 2, 'nation', n_nationkey, 0, n_name, n_name || ' ' || r_name, '#/lesson/' || n_regionkey || '/' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 3, 'page', page_id, 0, url, url || ' ' || html, '#/module/' || page_id FROM pages
UNION ALL SELECT 4, 'turn', conv_id, turn, role, text, '#/module/' || conv_id || '?extension=' || turn FROM conversations WHERE role <> 'user'
UNION ALL SELECT 5, 'part', p_partkey, 0, p_name, concat_ws(' ', p_name, p_type, p_brand), '#/module/' || p_partkey FROM part
UNION ALL SELECT 6, 'supplier', s_suppkey, 0, s_name, s_name || ' ' || n_name, '#/path/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 7, 'benchmark', item_id, 0, substr(text, 1, 30), text, '#/learn/playbooks?playbook=' || item_id FROM benchmark
UNION ALL SELECT 8, 'note', conv_id, turn, 'Note', text, '#/notebook/' || conv_id || '/' || turn FROM conversations WHERE role = 'user')"""


def index(spark, sf_dir) -> DataFrame:
    """Entries of all kinds and own notes; (kind, id, part) names an entry and orders the index."""
    t = lambda name: table(spark, sf_dir, name)
    c, lit = F.col, F.lit

    def entry(df, type_, id_, title, text, *href, part=lit(0)):
        return df.select(lit(_KINDS.index(type_)).alias("kind"), lit(type_).alias("type"), id_.cast("long").alias("id"), part.cast("int").alias("part"), title.alias("title"), text.alias("text"), F.concat(*href).alias("href"))

    said = t("conversations")
    nations = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey"))
    parts = [
        entry(t("region"), "region", c("r_regionkey"), c("r_name"), F.concat("r_name", lit(" region")), lit("#/course/"), "r_regionkey"),
        entry(t("documents"), "document", c("doc_id"), F.substring("text", 1, 30), c("text"), lit("#/lesson/"), "doc_id", lit("/"), "source"),
        entry(nations, "nation", c("n_nationkey"), c("n_name"), F.concat("n_name", lit(" "), "r_name"), lit("#/lesson/"), "n_regionkey", lit("/"), "n_nationkey"),
        entry(t("pages"), "page", c("page_id"), c("url"), F.concat("url", lit(" "), "html"), lit("#/module/"), "page_id"),
        entry(said.filter("role <> 'user'"), "turn", c("conv_id"), c("role"), c("text"), lit("#/module/"), "conv_id", lit("?extension="), "turn", part=c("turn")),
        entry(t("part"), "part", c("p_partkey"), c("p_name"), F.concat_ws(" ", "p_name", "p_type", "p_brand"), lit("#/module/"), "p_partkey"),
        entry(t("supplier").join(t("nation"), c("s_nationkey") == c("n_nationkey")), "supplier", c("s_suppkey"), c("s_name"), F.concat("s_name", lit(" "), "n_name"), lit("#/path/"), "s_suppkey"),
        entry(t("benchmark"), "benchmark", c("item_id"), F.substring("text", 1, 30), c("text"), lit("#/learn/playbooks?playbook="), "item_id"),
        entry(said.filter("role = 'user'"), "note", c("conv_id"), lit("Note"), c("text"), lit("#/notebook/"), "conv_id", lit("/"), "turn", part=c("turn")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("search_index", f"WITH {_INDEX} SELECT type, id, part, title, length(text) AS chars, href FROM ix")
def search_index(spark, sf_dir):
    return index(spark, sf_dir).select("type", "id", "part", "title", F.length("text").cast("long").alias("chars"), "href")


@query("href_columns", "SELECT doc_id, '#/' || CASE WHEN doc_id % 2 = 0 THEN 'lesson/' || doc_id || '/' || source ELSE 'module/' || lang END || CASE WHEN doc_id % 3 = 0 THEN '?path=p%20' || lang ELSE '' END AS href FROM documents")
def href_columns(spark, sf_dir):
    place = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("lesson/"), "doc_id", F.lit("/"), "source")).otherwise(F.concat(F.lit("module/"), "lang"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("?path="), F.replace(F.url_encode(F.concat(F.lit("p "), "lang")), F.lit("+"), F.lit("%20")))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("#/"), place, path).alias("href"))


_ORDER = ["kind", "id", "part"]
_HITS = f"{_INDEX}, h AS (SELECT * FROM ix WHERE contains(lower(text), 'the mit') ORDER BY kind, id, part LIMIT 80)"


def _hits(spark, sf_dir):
    """Search by grams over the kept index of all kinds."""
    root = scratch(spark, "search")
    S.write(index(spark, sf_dir), _ORDER, root)
    return S.search(spark, root, _ORDER, "the mit")


@query("search_query", f"WITH {_HITS} SELECT type, id, part FROM h")
def search_query(spark, sf_dir):
    return _hits(spark, sf_dir).select("type", "id", "part")


@query("search_snippet", f"WITH {_HITS} SELECT type, id, part, substr(regexp_replace(text, '[#*`]', '', 'g'), greatest(0, strpos(lower(text), 'the mit') - 1 - 55) + 1, 200) AS snippet FROM h")
def search_snippet(spark, sf_dir):
    return _hits(spark, sf_dir).select("type", "id", "part", T.snippet(F.col("text"), "the mit").alias("snippet"))


@query("notebook_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the')")
def notebook_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & F.lower("text").contains("the"))
    return rows.orderBy(F.desc("conv_id"), F.desc("turn")).select("conv_id", "turn")


@query("topic_filter", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'ring')")
def topic_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).contains("ring")).select("p_partkey")


@query("scan_json_typed", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def scan_json_typed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query("scan_json_strict", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'BOOLEAN' WHEN 3 THEN 'VOID' WHEN 4 THEN 'DECIMAL(2,1)' WHEN 5 THEN 'malformed' END AS k_type FROM events")
def scan_json_strict(spark, sf_dir):
    """Token types of records written to JSON files and read back: a number, a text, a boolean, a null, a decimal, no JSON, nothing."""
    form, k = F.col("event_id") % 7, F.get_json_object("props", "$.k")
    token = F.when(form == 0, k).when(form == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(form == 2, "true").when(form == 3, "null").when(form == 4, "1.5")
    start = F.concat(F.lit('{"event_id": '), "event_id")
    line = F.when(form == 5, F.concat(start, F.lit(', "k": '))).when(form == 6, F.concat(start, F.lit("}"))).otherwise(F.concat(start, F.lit(', "k": '), token, F.lit("}")))
    folder = scratch(spark, "json-lines")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    rows = readers.json_variants(spark, folder, ["k"])
    broken = F.regexp_extract("_corrupt_record", "([0-9]+)", 1).try_cast("long")
    event_id = F.coalesce(F.try_variant_get("v", "$.event_id", "long"), broken)
    return rows.select(event_id.alias("event_id"), F.when(F.col("v").isNull(), "malformed").otherwise(F.col("k_type")).alias("k_type"))


@query("scan_json_batches", "SELECT event_type AS batch_id, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def scan_json_batches(spark, sf_dir):
    """Batches of ids as JSON objects, one or, for many ids, several for each user, read back and exploded."""
    events = V.in_parts(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")
    lists = events.groupBy("user_id", "part", "event_type").agg(F.collect_list("event_id").alias("ids"))
    docs = lists.groupBy("user_id", "part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "ids")))).alias("doc"))
    named = docs.select(F.explode(F.from_json("doc", "map<string, array<bigint>>")).alias("batch_id", "ids"))
    return named.select("batch_id", F.explode("ids").alias("id")).groupBy("batch_id").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("scan_csv_header", "SELECT s_suppkey::VARCHAR AS record_id, s_name AS name, s_nationkey::VARCHAR AS units FROM supplier")
def scan_csv_header(spark, sf_dir):
    path = scratch(spark, "suppliers-csv")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("units")).write.option("header", True).csv(path)
    return readers.csv_header(spark, path, ["record_id", "name", "units"])


_UNITS = "un AS (SELECT c_custkey AS record_id, CASE c_custkey % 6 WHEN 0 THEN c_nationkey::VARCHAR WHEN 1 THEN '' WHEN 2 THEN 'seven' WHEN 3 THEN '-' || (c_nationkey + 1) WHEN 4 THEN NULL ELSE ' ' || c_nationkey || ' ' END AS units FROM customer)"


def _units(spark, sf_dir):
    form, n = F.col("c_custkey") % 6, F.col("c_nationkey").cast("string")
    text = F.when(form == 0, n).when(form == 1, "").when(form == 2, "seven").when(form == 3, F.concat(F.lit("-"), (F.col("c_nationkey") + 1).cast("string"))).when(form == 5, F.concat(F.lit(" "), n, F.lit(" ")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), text.alias("units"))


_PARSE = "SELECT record_id, CASE WHEN record_id % 6 IN (0, 5) THEN trim(units)::INT END AS value, CASE record_id % 6 WHEN 1 THEN '{m}' WHEN 4 THEN '{m}' WHEN 2 THEN '{f}' WHEN 3 THEN '{n}' END AS reason FROM un"


@query("csv_units_parse", f"WITH {_UNITS} " + _PARSE.format(m="missing units", f="malformed integer", n="negative units"))
def csv_units_parse(spark, sf_dir):
    value, reason = units_text(F.col("units"), "missing units", "malformed integer", "negative units")
    return _units(spark, sf_dir).select("record_id", value.alias("value"), reason.alias("reason"))


@query("units_parse_json", f"WITH {_UNITS} " + _PARSE.format(m="inspected_units is missing", f="quantity must be an integer", n="quantity must be an integer"))
def units_parse_json(spark, sf_dir):
    """Units out of JSON records: an integer or a text of digits only."""
    doc = F.when(F.col("units").isNull(), F.lit("{}")).when(F.col("record_id") % 6 == 0, F.concat(F.lit('{"u": '), "units", F.lit("}"))).otherwise(F.to_json(F.struct(F.col("units").alias("u"))))
    text = F.trim(F.get_json_object(doc, "$.u"))
    reason = F.when(text.isNull() | (text == ""), "inspected_units is missing").when(~text.rlike("^[0-9]+$"), "quantity must be an integer")
    return _units(spark, sf_dir).select("record_id", F.when(reason.isNull(), text.try_cast("int")).alias("value"), reason.alias("reason"))


@query("units_parse_exercise", f"WITH {_UNITS}, r AS ({_PARSE.format(m='missing units', f='malformed integer', n='negative units')}) SELECT reason, count(*) AS records FROM r GROUP BY 1")
def units_parse_exercise(spark, sf_dir):
    return csv_units_parse(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("records"))


@query("temp_view", "SELECT count(*) AS rows FROM lineitem WHERE l_returnflag = 'R'")
def temp_view(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("tallyspark_lines")
    return spark.sql("SELECT count(*) AS rows FROM tallyspark_lines WHERE l_returnflag = 'R'")


@query("scan_inline", "SELECT n_name, CASE WHEN n_regionkey IN (0, 1) THEN 'west' ELSE 'east' END AS side FROM nation")
def scan_inline(spark, sf_dir):
    sides = spark.createDataFrame([(0, "west"), (1, "west"), (2, "east"), (3, "east"), (4, "east")], "n_regionkey int, side string")
    return table(spark, sf_dir, "nation").join(sides, "n_regionkey").select("n_name", "side")


@query("scan_markdown_sections", "WITH m AS (SELECT conv_id, turn, 'before <!-- section:s' || turn || ' -->' || text || '<!-- section:end -->' || role AS md FROM conversations), p AS (SELECT conv_id, turn, string_split_regex(md, '<!-- section:[a-z0-9-]+ -->') AS parts, regexp_extract_all(md, '<!-- section:([a-z0-9-]+) -->', 1) AS names FROM m) SELECT conv_id, turn, i::INT AS ord, CASE WHEN i > 0 THEN names[i] END AS section, trim(parts[i + 1], ' ') AS body FROM (SELECT *, unnest(range(len(parts))) AS i FROM p)")
def scan_markdown_sections(spark, sf_dir):
    """Turns with a marker before and behind the text; markers in the text itself begin sections too."""
    marked = F.concat(F.lit("before <!-- section:s"), "turn", F.lit(" -->"), "text", F.lit("<!-- section:end -->"), "role")
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), marked.alias("md"))
    return T.sections(turns, "key", "md").select("key.conv_id", "key.turn", "ord", "section", "body")


@query("scan_state_doc", "SELECT event_id::VARCHAR AS map_key, event_id AS id, event_type AS rating FROM events")
def scan_state_doc(spark, sf_dir):
    """Exported documents, one or, for many records, several for each user, with a family of records; read back as rows."""
    from pyspark.sql import types as TY

    entry = F.struct(F.col("event_id").cast("string"), F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("rating")))
    events = V.in_parts(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
    docs = events.groupBy("user_id", "part").agg(F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(entry)).alias("reviews")).alias("state"))).alias("doc"))
    return readers.family(docs, "doc", "reviews", TY.StructType.fromDDL("id bigint, rating string"))


@query("scan_files_binary", "SELECT count(*) AS rows, sum(strlen(line) + 1)::BIGINT AS bytes, true AS hashed FROM (SELECT translate(html, chr(10) || chr(13), '  ') AS line FROM pages WHERE html IS NOT NULL)")
def scan_files_binary(spark, sf_dir):
    """Pages written as lines of text files of bounded size; the files' bytes are read and hashed."""
    path = scratch(spark, "page-files")
    lines = table(spark, sf_dir, "pages").filter("html is not null").select(F.translate("html", "\n\r", "  ").alias("value"))
    lines.write.option("maxRecordsPerFile", 1000).text(path)
    files = readers.files_binary(spark, path).agg(F.sum("length").alias("bytes"), F.bool_and(F.length("sha256") == 64).alias("hashed"))
    return spark.read.text(path).agg(F.count("*").alias("rows")).crossJoin(files)  # one row each


@query("scan_catalog_tree", "SELECT r_regionkey AS course, count(n_nationkey) AS modules FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def scan_catalog_tree(spark, sf_dir):
    """Nested course documents written as JSON files and discovered again in the folder tree."""
    from pyspark.sql import types as TY

    modules = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("course")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"))).alias("modules"))
    path = scratch(spark, "courses")
    table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("course")).join(modules, "course", "left").write.partitionBy("course").json(path)
    tree = readers.json_tree(spark, path, TY.StructType.fromDDL("modules array<struct<id: int>>"))
    course = F.regexp_extract("path", "course=([0-9]+)", 1).cast("int")
    return tree.select(course.alias("course"), F.greatest(F.size("modules"), F.lit(0)).cast("long").alias("modules"))


@query("sink_search_index", f"WITH {_INDEX} SELECT type, count(*) AS entries FROM ix GROUP BY 1")
def sink_search_index(spark, sf_dir):
    path = scratch(spark, "search-index")
    index(spark, sf_dir).write.partitionBy("type").parquet(path)
    return spark.read.parquet(path).groupBy("type").agg(F.count("*").alias("entries"))


@query("sink_report_json", "SELECT l_returnflag AS flag, count(*) AS lines FROM lineitem GROUP BY 1")
def sink_report_json(spark, sf_dir):
    path = scratch(spark, "report")
    table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines")).write.json(path)
    return spark.read.schema("flag string, lines bigint").json(path)


_RELATIONS = {"accepted": "SELECT * FROM ac", "totals": "SELECT * FROM tt", "excluded": "SELECT * FROM ex", "coverage": "SELECT (SELECT count(*) FROM u) AS rows, (SELECT count(*) FROM k WHERE valid) AS valid, (SELECT count(*) FROM un) AS withheld"}


def _snapshot_sql() -> str:
    """Whether all relations of a history equal those of the deliveries as they are."""
    as_sql = RESOLVER._sql
    histories = {"once": (V.D1, "d1"), "replayed": (V.D1R, "d1r"), "clean": (V.D1C, "d1c"), "later": (V.D1 + ", d1l AS (SELECT * FROM d1 WHERE version > 1)", "d1l")}
    rows = []
    for name, view in histories.items():
        pairs = [(as_sql(tail), as_sql(tail, *view)) for tail in _RELATIONS.values()]
        same = " AND ".join(f"NOT EXISTS (({a}) EXCEPT ALL ({b})) AND NOT EXISTS (({b}) EXCEPT ALL ({a}))" for a, b in pairs)
        rows.append(f"SELECT '{name}' AS history, {same} AS same")
    return " UNION ALL ".join(rows)


@query("snapshot_identity", _snapshot_sql())
def snapshot_identity(spark, sf_dir):
    """Which histories have the snapshot id of the deliveries as they are: a replay has, others have not."""
    once, replayed, later, clean = 1, 2, 4, 8
    raw = V.deliveries(spark, sf_dir)
    first = F.when(F.col("version") > 1, once + replayed + later).otherwise(once + replayed)
    sent = F.when(F.col("inspection_id").cast("long") % 2 == 0, F.array(first, F.lit(replayed))).otherwise(F.array(first))  # as in V.replayed, repeats beside their rows
    rows = raw.withColumn("histories", F.explode(sent)).unionByName(staged(V.clean(spark, sf_dir), "clean").withColumn("histories", F.lit(clean)))
    found = R.resolve_each(rows, ["once", "replayed", "later", "clean"])
    ids = reduce(DataFrame.unionByName, [P.snapshot_id(P.snapshot_of(x)).withColumn("history", F.lit(name)) for name, x in found.items()])
    ids = cut(ids)  # one row a history
    once = ids.filter("history = 'once'").select(F.col("content_id").alias("basis"))
    return ids.crossJoin(once).select("history", (F.col("content_id") == F.col("basis")).alias("same"))


def _published(spark, sf_dir, fail=None):
    root = scratch(spark, "pipeline")
    pipeline = P.Pipeline(spark, root)
    rows = V.clean(spark, sf_dir)
    pipeline.ingest(rows.filter("version <= 3"), "0")
    try:
        pipeline.ingest(rows.filter("version > 3"), "1", fail)
    except RuntimeError:
        pipeline.recover()
    return pipeline


@query("publish_pipeline", RESOLVER._sql("SELECT inspection_id, version, inspected_units, defective_units FROM ac", V.D1C, "d1c"))
def publish_pipeline(spark, sf_dir):
    return _published(spark, sf_dir).published()


@query("recover_idempotent", RESOLVER._sql("SELECT inspection_id, version, inspected_units, defective_units FROM ac", V.D1C, "d1c"))
def recover_idempotent(spark, sf_dir):
    """Published state after a failure behind the snapshot and two recoveries."""
    pipeline = _published(spark, sf_dir, "resolved_state")
    pipeline.recover()
    return pipeline.published()


_COVER = "(SELECT count(*) FROM ac) AS accepted, (SELECT count(*) FROM ex) AS excluded, (SELECT inspected_units FROM tt) AS inspected_units, (SELECT defective_units FROM tt) AS defective_units"


@query("sink_snapshot", RESOLVER._sql(f"SELECT 0::BIGINT AS seq, 'current' AS status, {_COVER}", V.D1C + ", d1f AS (SELECT * FROM d1c WHERE version <= 3)", "d1f") + " UNION ALL SELECT * FROM (" + RESOLVER._sql(f"SELECT 1::BIGINT AS seq, 'current' AS status, {_COVER}", V.D1C, "d1c") + ")")
def sink_snapshot(spark, sf_dir):
    """Each publication with what its snapshot holds."""
    pipeline = _published(spark, sf_dir)
    held = []
    for p in pipeline.publications().orderBy("seq").collect():  # one for each batch
        accepted, excluded, totals = (pipeline.relation(n, p["snapshot_id"]) for n in ("accepted", "excluded", "totals"))
        one = accepted.agg(F.lit(p["seq"]).alias("seq"), F.lit(p["status"]).alias("status"), F.count("*").alias("accepted"))
        held.append(one.crossJoin(excluded.agg(F.count("*").alias("excluded"))).crossJoin(totals.select("inspected_units", "defective_units")))
    return reduce(DataFrame.unionByName, held)


@query("sink_outbox", "SELECT publication::BIGINT AS publication, count(*) AS effects FROM (SELECT unnest(range((SELECT count(DISTINCT version > 3) FROM (SELECT row_number() OVER (PARTITION BY l_orderkey) AS version FROM lineitem)))) AS publication) GROUP BY 1")
def sink_outbox(spark, sf_dir):
    """Effects of each publication, after a failure behind the second one's record: one each."""
    pipeline = _published(spark, sf_dir, "published_snapshot")
    pipeline.recover()
    rows = pipeline.publications().join(pipeline.outbox(), "snapshot_id", "left")
    return rows.groupBy(F.col("seq").alias("publication")).agg(F.count("effect").alias("effects"))


def _stream(spark, sf_dir, name):
    """The Parquet file of a table as a stream: read from its folder by name, with the schema given."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("stream_event_conflicts", RESOLVER.SQL["event_conflicts"].replace("SELECT event_id, deliveries FROM ec", "SELECT event_id FROM ec"))
def stream_event_conflicts(spark, sf_dir):
    root = scratch(spark, "stream-conflicts")
    lines = _stream(spark, sf_dir, "lineitem")
    rows = lines.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("event_id"), F.col("l_orderkey").cast("string").alias("inspection_id"), F.col("l_linenumber").alias("version"), F.col("l_quantity").cast("int").alias("inspected_units"), F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("defective_units"))
    jobs.event_conflicts(rows, f"{root}/flags", f"{root}/checkpoint").awaitTermination()
    return jobs.current_conflicts(spark, f"{root}/flags")


@query("stream_review_schedule", LEARNER_SQL["schedule_fold"])
def stream_review_schedule(spark, sf_dir):
    root = scratch(spark, "stream-schedules")
    card = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(5))
    rating = F.when(F.col("event_type") == "error", "Again").when(F.col("event_type") == "click", "Hard").when(F.col("event_type") == "view", "Good").when(F.col("event_type") == "purchase", "Easy")
    rows = _stream(spark, sf_dir, "events").filter("event_type <> 'signup'").select("event_id", F.col("user_id").alias("learner_id"), card.alias("card_id"), rating.alias("rating"), F.col("ts").alias("at"))
    jobs.review_schedule(rows, f"{root}/schedules", f"{root}/checkpoint").awaitTermination()
    done = jobs.current_schedules(spark, f"{root}/schedules")
    return done.select("learner_id", "card_id", "interval_days", F.col("due_at").cast("timestamp_ntz").alias("due_at"), "last_event_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("stream_ingest_resolve", RESOLVER._sql("SELECT inspection_id, version, inspected_units, defective_units FROM ac", V.D1C, "d1c"))
def stream_ingest_resolve(spark, sf_dir):
    """Deliveries streamed in by several micro-batches: what is published after the last one."""
    root = scratch(spark, "stream-pipeline")
    V.clean(spark, sf_dir).withColumn("part", F.col("version") % 3).write.partitionBy("part").parquet(f"{root}/arriving")
    schema = "event_id string, inspection_id string, version int, inspected_units int, defective_units int"
    files = spark.read.parquet(f"{root}/arriving").select(F.input_file_name()).distinct().count()
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{root}/arriving")
    jobs.ingest_resolve(rows, f"{root}/tables", f"{root}/checkpoint").awaitTermination()
    return P.Pipeline(spark, f"{root}/tables").published()


@query("scan_paths", "SELECT n_regionkey AS path, count(DISTINCT n_nationkey) AS groups, count(c_custkey) AS lessons FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def scan_paths(spark, sf_dir):
    """Learning paths (regions) with groups (nations) of lessons (customers) as JSON files, several for many lessons, read back in name order."""
    customers = V.in_parts(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")
    lessons = customers.groupBy(F.col("c_nationkey").alias("n_nationkey"), "part").agg(F.collect_list("c_custkey").alias("lessons"))
    groups = table(spark, sf_dir, "nation").join(lessons, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("path"), F.coalesce("part", F.lit(0)).alias("part")).agg(F.collect_list(F.struct("n_nationkey", "lessons")).alias("groups"))
    folder = scratch(spark, "paths")
    groups.write.partitionBy("path", "part").json(folder)
    tree = readers.json_tree(spark, folder, "groups array<struct<n_nationkey: int, lessons: array<bigint>>>")
    found = tree.select(F.regexp_extract("path", "path=([0-9]+)", 1).cast("int").alias("path"), F.explode("groups").alias("g"))
    size = F.greatest(F.coalesce(F.size("g.lessons"), F.lit(0)), F.lit(0))
    return found.groupBy("path").agg(F.count_distinct("g.n_nationkey").alias("groups"), F.sum(size).cast("long").alias("lessons")).orderBy("path")


@query("scan_teaching", "SELECT 'modules' AS family, count(*) AS rows FROM part UNION ALL SELECT 'media', count(*) FROM supplier")
def scan_teaching(spark, sf_dir):
    """Modules and media registers in one folder, told apart by file name and read under their own schemas."""
    folder = scratch(spark, "teaching")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")).write.json(f"{folder}/kind=modules")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("seconds")).write.json(f"{folder}/kind=media")
    modules = spark.read.schema("id bigint, title string").json(f"{folder}/kind=modules/*.json")
    media = spark.read.schema("id bigint, seconds double").json(f"{folder}/kind=media/*.json")
    return modules.agg(F.lit("modules").alias("family"), F.count("*").alias("rows")).unionByName(media.agg(F.lit("media").alias("family"), F.count("*").alias("rows")))
