"""Substring dedup over words by FM-indexes: windows of 20 words that start earlier, too.

Segments around repeated anchors (see anchors) are gathered in shards.  A shard
gets an FM-index: the Burrows-Wheeler transform of its words in a wavelet
matrix, whose bit rows answer ranks from counts by block.  Every segment is
streamed against it from each end of a window: backward search extends the
match word by word while another place still matches, which gives the matching
statistic, 20 at most.  Where it reaches 20, the interval of the index names all
places of the window, and a range minimum the earliest of them.

Defined cases: null text has no words; documents of fewer than 20 words stay;
windows are judged on the input; rows with one id are the same document, so of
equal windows at one place neither is the earlier; a null id comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Unit, keyed, merged, mixed, with_repeats
from .common import LAST_ID, map_rows, table
from .induced import suffix_array

WINDOW = 20
GRAM = 5
SHARD_WORDS = 200_000
#: Words whose hashes a worker keeps.
KNOWN_WORDS = 400_000
_known: dict[bytes, int] = {}


def words(text: str) -> list[bytes]:
    """Runs of other bytes than space and \\x09 to \\x0D."""
    return text.encode("utf-8", "surrogatepass").split()


def _read(text: str) -> tuple[np.ndarray, list[bytes]]:
    found = words(text)
    fresh = {w for w in found if w not in _known}
    if len(_known) + len(fresh) > KNOWN_WORDS:
        _known.clear()
        fresh = set(found)
    for w in fresh:
        _known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, found), np.uint64, len(found)), found


def _grams(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mixed(out)


def _pack(found: list[bytes], a: int, b: int) -> bytes:
    return b" ".join(found[a:b])


def _count(content: bytes) -> int:
    return content.count(b" ") + 1


WORDS = Unit(WINDOW, GRAM, _read, _grams, mixed, _pack, _count, True)


def _symbols(contents: list[bytes]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.array([numbers.setdefault(w, len(numbers)) for w in c.split(b" ")], np.int64) for c in contents]


def word_suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text of many symbols, ending in its only 0: each is written in digits of one width, so that a small alphabet is sorted."""
    base, width = 250, 1
    while base**width <= int(text.max()):
        width += 1
    digits = np.stack([(text // base ** (width - 1 - j)) % base + 1 for j in range(width)], 1).reshape(-1)
    order = suffix_array(np.append(digits, 0))
    return order[(order < len(digits)) & (order % width == 0)] // width


class BitRow:
    """Bits with ranks: packed words and the count of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Backward search over a text of symbols 0..m, whose last symbol is its only 0."""

    def __init__(self, text: np.ndarray) -> None:
        self.places = word_suffix_array(text)
        transform = text[self.places - 1]
        m = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=m))])
        self.rows: list[BitRow] = []
        current, self.shifts = transform, list(range(max(1, m.bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = ((current >> shift) & 1).astype(np.uint8)
            self.rows.append(BitRow(bits))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        self.origin = self._down(np.arange(m), np.zeros(m, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, row in zip(self.shifts, self.rows, strict=True):
            one = row.ones(at)
            at = np.where((symbols >> shift) & 1, row.zeros + one, at - one)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches extended to the left by a symbol each."""
        base = self.first[symbols] - self.origin[symbols]
        return base + self._down(symbols, low), base + self._down(symbols, high)


class RangeMinimum:
    def __init__(self, values: np.ndarray) -> None:
        self.rows, size = [values], 1
        while 2 * size <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-size], last[size:]))
            size *= 2

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.rows[0].dtype)
        for one in np.unique(level).tolist():
            some = level == one
            row = self.rows[one]
            out[some] = np.minimum(row[low[some]], row[high[some] - (1 << one)])
        return out


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each end (the last symbol's place): symbols up to it that another place of the text matches, ``limit`` at most, and the interval of the last step."""
    n = len(ends)
    length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    live = np.arange(n)
    for step in range(limit):
        symbols = text[ends[live] - step]
        a, b = index.step(symbols, low[live], high[live])
        more = b - a > 1
        live = live[more]
        if not len(live):
            break
        low[live], high[live], length[live] = a[more], b[more], step + 1
    return length, low, high


def least_ranks(symbols: np.ndarray, valid: np.ndarray, ranks: np.ndarray, window: int) -> np.ndarray:
    """For each valid start, the least rank among the starts of equal windows; by backward search."""
    text = np.append(symbols + 1, 0)
    out = ranks.copy()
    starts = np.flatnonzero(valid)
    if not len(starts):
        return out
    index = FMIndex(text)
    by_rank = RangeMinimum(np.append(ranks, ranks.max() + 1)[index.places])
    length, low, high = matching_statistics(index, text, starts + window - 1, window)
    repeated = length == window
    out[starts[repeated]] = by_rank.least(low[repeated], high[repeated])
    return out


def _results(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans")), strict=True):
        found = words(text)
        kept, at = [], 0
        for a, b in merged(spans).tolist():
            kept += found[at:a]
            at = b
        kept += found[at:]
        rows.append((None if doc == LAST_ID else doc, len(found), len(found) - len(kept), b" ".join(kept)))
    ids, n, removed, kept_ = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by a space) of every row."""
    found = with_repeats(keyed(docs, id_col, text_col), unit, _symbols, least_ranks, SHARD_WORDS)
    return map_rows(found, _results, "doc_id long, n_words long, n_removed long, kept binary", 8 << 20)


def op5_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
