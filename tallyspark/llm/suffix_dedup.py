"""Removal of byte strings that stand earlier in the corpus (operator 4).

Windows of 100 bytes are routed to shards (see ``windows``). Each shard builds the Burrows-Wheeler
transform of its representatives, two real places of each string that is proposed to repeat, and finds
common prefixes by threshold-bounded interval expansion: suffixes between which no shorter prefix was
found share 100 bytes, and all but the earliest go. Further copies are later than the first place, and go
where the expansion finds all windows of it to stand in two places.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bwt, common, tokens, windows

LENGTH = 100
SPEC = windows.Spec(length=LENGTH, gram=36, words=False)


def later_windows(bodies: list[np.ndarray], held: windows.Held, length: int) -> tuple[np.ndarray, ...]:
    """(row, offset, n, sure): runs of windows that also stand in an earlier text or earlier in the same one, and
    which representatives have only windows that stand in two places or more."""
    text, offsets = bwt.joined(bodies)
    order = bwt.suffix_order(text, length + 1)
    closed = bwt.short_prefix_bounds(bwt.transform(text, order), length)
    group = np.cumsum(closed[:-1])
    owner = np.repeat(np.arange(len(bodies)), np.diff(offsets))
    whole = order + length < offsets[owner[order] + 1]  # windows that lie within their string
    pos, group = order[whole], group[whole]
    first = np.full(int(group.max(initial=0)) + 1, text.size)
    np.minimum.at(first, group, pos)
    flags = np.zeros(text.size + 1, bool)
    flags[pos[pos > first[group]]] = True
    start, n = windows.runs_of(flags[:-1])  # a string's last windows are never flagged, so no run leaves its string
    row = owner[start] if start.size else start
    often = np.zeros(text.size, bool)
    often[pos] = np.bincount(group)[group] >= 2
    return row, start - offsets[row], n, windows.all_true(often, offsets[held.row] + held.at, held.n)


def suffix_dedup(docs: DataFrame, spec: windows.Spec = SPEC, texts: bool = True, part_tokens: int = windows.PART_TOKENS) -> DataFrame:
    """Bytes of each text that remain once every byte covered by an earlier-standing window is gone.

    Gives (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept); kept is null unless ``texts``. Earlier means a smaller doc_id, or
    the same document and a smaller start; windows are judged on the input. A missing text is empty, a
    missing doc_id comes before all others; rows that share a doc_id are ordered by a hash of the text, and
    of rows equal in both, in no set order, one comes first. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    length = spec.length
    rows = windows.Texts(docs)
    marks = windows.found_places(rows, spec, lambda bodies, held: later_windows(bodies, held, length), part_tokens)

    def run(batches):
        for batch in common.slices(batches, "body"):
            names = batch.schema.names
            bufs = tokens.rows_of(batch.column(names.index("body")))
            lists, again = tokens.lists_of(batch.column(names.index("marks"))), batch.column(names.index("again")).to_pylist()
            out = []
            for buf, want, copy in zip(bufs, lists, again, strict=True):
                gone = np.ones(buf.size, bool) if copy and buf.size >= length else windows.covered(buf.size, want, length)
                kept = buf[~gone].tobytes()
                out.append((buf.size, int(gone.sum()), windows.runs_of(gone)[0].size, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            if out:
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return windows.marked(rows, marks).select("doc_id", "body", "marks", "again").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir), texts=False).drop("kept")


#: Every window as bytes, told apart by MD5; windows that stand earlier too are united to spans, and the bytes between spans are kept.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ('0x' || left(md5(coalesce(text, '')), 15))::BIGINT AS h, encode(coalesce(text, '')) AS b FROM documents),
v AS (SELECT r, doc_id, h, s, md5(b[s:s + 99]) AS k FROM (SELECT r, doc_id, h, b, unnest(range(1, octet_length(b) - 98)) AS s FROM d)),
e AS (SELECT r, s FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h, r, s) > 1),
g AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 100, true) AS fresh FROM e),
h AS (SELECT r, s, sum(fresh::INT) OVER (PARTITION BY r ORDER BY s) AS run FROM g),
o AS (SELECT r, min(s) AS low, max(s) + 100 AS high FROM h GROUP BY r, run),
p AS (SELECT r, 0 AS low, 1 AS high FROM d UNION ALL SELECT * FROM o),
q AS (SELECT r, high AS start_, coalesce(lead(low) OVER (PARTITION BY r ORDER BY low), octet_length(b) + 1) - 1 AS stop_, low, high, b FROM p JOIN d USING (r)),
a AS (SELECT r, sum(high - low) FILTER (low > 0) AS n_removed, count(*) FILTER (low > 0) AS n_spans, string_agg(CASE WHEN stop_ >= start_ THEN hex(b[start_:stop_]) ELSE '' END, '' ORDER BY low) AS kept FROM q GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN a USING (r)
"""
