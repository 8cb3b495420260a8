"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file (operator 9)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Texts longer than this many characters are encoded in pieces.
PIECE = 1 << 15

#: No match of the pre-splitting pattern goes from an ASCII letter or digit on to a space or line feed,
#: and none looks back: a text may be cut before such a space.
SAFE = re.compile(r"(?<=[0-9A-Za-z])[ \n]")

#: White space as the pattern's ``\s`` has it, in runs that are long enough to be taken out of the text first:
#: the pattern's look-ahead backtracks over a run, and its stack ends at about a million characters.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")


def safe_pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe boundaries, each the first one ``size`` or more characters after the last."""
    out, at = [], 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces that may be encoded on their own, and whether a piece is one match of the pattern.

    In a run of k > 1 white-space characters the pattern matches the first k-1 at once, or all k at the end of the
    text; the last one starts the next match. No match before the run goes into it, and none looks back.
    """
    at = 0
    for run in LONG_SPACE.finditer(text):
        if run.start() > at:
            yield from ((piece, False) for piece in safe_pieces(text[at : run.start()]))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    if at < len(text):
        yield from ((piece, False) for piece in safe_pieces(text[at:]))


def encode(bpe, text: str) -> np.ndarray:
    """Token ids of a whole text of any length."""
    ids = [bpe._encode_single_piece(piece) if whole else bpe.encode_ordinary(piece) for piece, whole in pieces(text)]
    return np.concatenate([np.zeros(0, "<u4"), *(np.array(x, "<u4") for x in ids)])


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """Token ids of each whole text, and what they decode to.

    Gives (doc_id, n_tokens, ids_sha256, decoded_sha256, ids); ids is null unless asked for. Digests are
    over the ids as little-endian unsigned 32-bit integers and over the decoded raw bytes. A missing text
    is empty (no tokens); a missing doc_id stays missing; repeated rows give repeated results; other
    columns are not read. An empty table gives no rows. The rank file (about 1 MB) is read by the driver and sent with the tasks.
    """
    with open(ranks_path, "rb") as file:
        ranks = file.read()

    def run(batches):
        bpe = encoding(ranks, pattern)
        for batch in common.slices(batches, "text"):
            out, kept = [], []
            for text in batch.column(1).to_pylist():
                tokens = encode(bpe, text)
                decoded = hashlib.sha256()
                for at in range(0, tokens.size, PIECE):  # raw bytes: a token may hold part of a character
                    decoded.update(bpe.decode_bytes(tokens[at : at + PIECE].tolist()))
                out.append((tokens.size, hashlib.sha256(tokens.tobytes()).hexdigest(), decoded.hexdigest()))
                kept.append(tokens)
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            ends = np.cumsum([0, *(x.size for x in kept)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int64))) if ids else pa.nulls(len(out), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, lists], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>")


def public_ranks() -> tuple[str, str]:
    """Path of the rank file and the pre-splitting pattern of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir), *public_ranks(), ids=False).drop("ids")
