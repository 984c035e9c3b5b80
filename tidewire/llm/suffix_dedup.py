"""Suffix-array dedup: bytes covered by a 50-byte string that a document with a smaller id holds, too.

Segments around repeated anchors (see anchors) are gathered in shards.  A shard's
suffixes are sorted by external induced sorting (see induced), neighbours in
that order are held against each other over 50 bytes, and each class of equal
strings gets the least id that holds it.

The common-prefix values of neighbours are taken from the text after sorting,
50 bytes at most, rather than carried through the recursion: no longer prefix is
asked for.

Defined cases: null text counts as empty; matches do not cross documents; rows
with one id are one document and do not remove each other's bytes; a null id
comes after all others; texts shorter than 50 bytes stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Unit, keyed, merged, mixed, with_repeats
from .common import LAST_ID, map_rows, table
from .induced import suffix_array

WINDOW = 50
#: Bytes of an anchor: long enough that prose does not repeat them by chance.
GRAM = 20
SHARD_BYTES = 1_000_000


def _read(text: str) -> tuple[np.ndarray, bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(data, np.uint8), data


def _words8(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x


def _grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    packed, out = _words8(data), np.zeros(n, np.uint64)
    for j in (*range(0, GRAM - 7, 8), GRAM - 8):
        out = out * np.uint64(0x9E3779B97F4A7C15) + packed[j : j + n]
    return mixed(out)


def _count(content: bytes) -> int:
    return len(content)


_MIX = mixed(np.arange(1, 257, dtype=np.uint64))

BYTES = Unit(WINDOW, GRAM, _read, _grams, lambda data: _MIX[data], lambda data, a, b: data[a:b], _count, False)


def _symbols(contents: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint8) for c in contents]


def least_ranks(symbols: np.ndarray, valid: np.ndarray, ranks: np.ndarray, window: int) -> np.ndarray:
    """For each valid start, the least rank among the starts of equal windows; by suffix array and common prefixes."""
    order = suffix_array(np.append(symbols + 1, 0))
    order = order[order < len(symbols)]
    order = order[valid[order]]
    out = ranks.copy()
    if not len(order):
        return out
    a, b = order[:-1], order[1:]
    # symbols are bytes plus one within valid windows: eight of them make one number to compare
    packed = _words8(np.maximum(symbols - 1, 0))
    same = np.ones(len(order) - 1, bool)
    for j in (*range(0, window - 7, 8), window - 8):
        same &= packed[a + j] == packed[b + j]
    first = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(ranks[order], first)
    out[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def _results(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans")), strict=True):
        data = text.encode("utf-8", "surrogatepass")
        gone = merged(spans)
        kept, at = [], 0
        for a, b in gone.tolist():
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        rest = b"".join(kept)
        rows.append((None if doc == LAST_ID else doc, len(data), len(data) - len(rest), len(gone), rest))
    ids, n, removed, spans_, kept_ = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept_, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    found = with_repeats(keyed(docs, id_col, text_col), unit, _symbols, least_ranks, SHARD_BYTES)
    return map_rows(found, _results, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", 8 << 20)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
