"""Removal of word passages that stand anywhere else in the corpus (operator 7).

Windows of 35 words are routed to shards (see ``windows``). Each shard holds a compressed FM-index of
its representatives, two real places of each passage that is proposed to repeat; their texts stream through
it by backward search over the wavelet tree, and every window whose matching statistic reaches the threshold
in two places is reported, with all its copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import bwt, common, fm, tokens, windows

LENGTH = 35
SPEC = windows.Spec(length=LENGTH, gram=10, words=True)

#: Windows in a query.
QUERY = 64


def shared_windows(bodies: list[np.ndarray], held: windows.Held, length: int) -> tuple[np.ndarray, ...]:
    """(row, offset, n, sure): runs of windows that the shard holds twice or more, and which representatives have
    only such windows. Last ones are asked for only if a first one is not confirmed."""
    sizes = np.array([b.size for b in bodies])
    ids = np.unique(np.concatenate(bodies), return_inverse=True)[1].astype(np.int64)
    text, offsets = bwt.joined(np.split(ids, np.cumsum(sizes)[:-1]))
    index = fm.FMIndex(bwt.transform(text, bwt.suffix_order(text, length + 1)))
    at = offsets[held.row] + held.at
    for asked in (held.c > 0, held.c >= 0):
        start, n = index.matching(text, *_queries(*_stretches(at[asked], held.n[asked])), length)
        change = np.zeros(text.size + 1, np.int64)
        np.add.at(change, start, 1)
        np.subtract.at(change, start + n, 1)
        sure = windows.all_true(np.cumsum(change) > 0, at, held.n)
        if sure[held.c > 1].all():
            break
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start - offsets[row], n, sure


def _stretches(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of the windows of representatives, neighbours as one."""
    head = np.flatnonzero(np.diff(at - np.cumsum(n) + n, prepend=-1))
    return at[head], np.add.reduceat(n, head) if head.size else n


def _queries(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows start .. start + count of each text as queries of QUERY windows, which stream through the index in step."""
    parts = -(-count // QUERY)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(start, parts) + place * QUERY, np.minimum(QUERY, np.repeat(count, parts) - place * QUERY)


def substring_dedup(docs: DataFrame, spec: windows.Spec = SPEC, texts: bool = True, part_tokens: int = windows.PART_TOKENS) -> DataFrame:
    """Words of each text that no window covers whose words also stand in order anywhere else.

    Gives (doc_id, n_words, n_removed, kept_sha256, kept); kept words are joined by one space, and kept
    is null unless ``texts``. Windows are judged on the input, the same document included. A missing
    text has no words; rows with a missing doc_id take part, and rows equal in doc_id and text repeat each
    other. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    length = spec.length
    rows = windows.Texts(docs)
    marks = windows.found_places(rows, spec, lambda bodies, held: shared_windows(bodies, held, length), part_tokens)

    def run(batches):
        for batch in common.slices(batches, "body"):
            names = batch.schema.names
            out = []
            bufs = tokens.rows_of(batch.column(names.index("body")))
            lists, twins = tokens.lists_of(batch.column(names.index("marks"))), batch.column(names.index("twin")).to_pylist()
            for buf, want, twin in zip(bufs, lists, twins, strict=True):
                words = buf.tobytes().split()  # bytes.split knows just these six kinds of white space
                gone = np.ones(len(words), bool) if twin and len(words) >= length else windows.covered(len(words), want, length)
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            if out:
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), *cols], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return windows.marked(rows, marks).select("doc_id", "body", "marks", "twin").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(common.documents(spark, sf_dir), texts=False).drop("kept")


#: Every window as one text, told apart by MD5; a word goes if one of the 35 windows that hold it is repeated.
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{common.WORD}') AS w FROM documents),
v AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
e AS (SELECT r, s FROM v QUALIFY count(*) OVER (PARTITION BY k) > 1),
i AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS s FROM d),
c AS (SELECT i.r, s, word, count(e.s) OVER (PARTITION BY i.r ORDER BY s ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
      FROM i LEFT JOIN e USING (r, s)),
a AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY s) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""
