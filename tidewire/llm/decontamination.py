"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

Words are runs of letters and digits, lower-cased.  Every SEED-word run of every
item is looked for in every document, and its document frequency is counted.
An item's seeds are its runs that are rare: found in RARE_DOCS documents at
most, or in no more than the median of the item's own runs (so that an item
that leaked everywhere keeps its seeds).  A document and an item that share
seeds become a candidate for each stretch of the document where the seeds'
diagonals lie; a local alignment of the item with that stretch gives the score:

    score = best Smith-Waterman score / score of the item with itself.

The item table is the query set: it goes to the tasks in blocks of BLOCK_WORDS
words, each of which is broadcast; documents are read once a block.

Defined cases: null texts and items count as empty, empty ones match nothing;
items shorter than a seed are looked for as a whole; repeated items and rows
give repeated results; a null item id is kept; ties between stretches go to the
first.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, id_key, map_arrow, row_key, table, texts, without_rows

SEED = 3
RARE_DOCS = 50
BLOCK_WORDS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Normalised score from which a document counts as contaminated by the item.
MIN_SCORE = 0.5
#: Aligned words that must be equal, at least.
MIN_MATCHES = 8

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Items:
    """A block of items: their words as numbers, and where each run of SEED words begins."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.ids, self.codes = [], []
        self.starts: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            code = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            n = min(SEED, len(code))
            if not n:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            self.codes.append(np.array(code, np.int32))
            for i in range(len(code) - n + 1):
                self.starts[tuple(code[i : i + n])].append((at, i))
        self.grams = list(self.starts)
        self.number = {g: i for i, g in enumerate(self.grams)}
        # packed forms of the runs of full length, for a fast look-up
        self.base = len(self.vocabulary) + 1
        full = [(self._pack(np.array(g)), i) for i, g in enumerate(self.grams) if len(g) == SEED]
        full.sort()
        self.packed = np.array([p for p, _ in full], np.uint64)
        self.packed_number = np.array([i for _, i in full], np.int64)
        self.short = [(g, i) for i, g in enumerate(self.grams) if len(g) < SEED]

    def _pack(self, g: np.ndarray) -> int:
        value = 0
        for c in g.tolist():
            value = (value * 0x9E3779B97F4A7C15 + c + 1) & 0xFFFFFFFFFFFFFFFF
        return value

    def read(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int32)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, gram numbers) of the items' runs in a document."""
        at_, number_ = [], []
        if len(codes) >= SEED and len(self.packed):
            known = codes >= 0
            for i in range(1, SEED):
                known = known[: len(codes) - i] & (codes[i:] >= 0)
            at = np.flatnonzero(known)
            if len(at):
                value = np.zeros(len(at), np.uint64)
                for i in range(SEED):
                    value = value * np.uint64(0x9E3779B97F4A7C15) + (codes[at + i] + 1).astype(np.uint64)
                place = np.minimum(np.searchsorted(self.packed, value), len(self.packed) - 1)
                same = self.packed[place] == value
                at_.append(at[same])
                number_.append(self.packed_number[place[same]])
        for g, i in self.short:
            found = codes == g[0] if len(g) == 1 else (codes[:-1] == g[0]) & (codes[1:] == g[1])
            at_.append(np.flatnonzero(found))
            number_.append(np.full(len(at_[-1]), i))
        return (np.concatenate(at_), np.concatenate(number_)) if at_ else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman with linear gaps: best score, equal words, and where in the passage it begins and ends."""
    m, n = len(item), len(passage)
    rows = np.zeros((m + 1, n + 1), np.int32)
    slope = GAP * np.arange(n + 1, dtype=np.int32)
    for i in range(1, m + 1):
        diagonal = rows[i - 1, :-1] + np.where(passage == item[i - 1], MATCH, MISMATCH)
        best = np.maximum(np.maximum(diagonal, rows[i - 1, 1:] + GAP), 0)
        # gaps in the passage: a running maximum along the row
        row = np.concatenate([[0], best])
        rows[i] = np.maximum.accumulate(row - slope) + slope
    i, j = np.unravel_index(int(rows.argmax()), rows.shape)
    score, end, same = int(rows[i, j]), int(j), 0
    while i and j and rows[i, j] > 0:
        equal = passage[j - 1] == item[i - 1]
        if rows[i, j] == rows[i - 1, j - 1] + (MATCH if equal else MISMATCH):
            same += int(equal)
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, same, int(j), end


def stretches(places: list[tuple[int, int]], length: int, n_words: int) -> list[tuple[int, int]]:
    """Parts of a document to align: where hits (document position, item position) put the item, with room for gaps."""
    room = max(8, length // 4)
    out: list[list[int]] = []
    for begin in sorted(p - q for p, q in places):
        a, b = max(0, begin - room), min(n_words, begin + length + room)
        if out and a <= out[-1][1] and b - out[-1][0] <= 4 * (length + room):
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of BLOCK_WORDS words at most (one item at least)."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        n = len(row[1].split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


_FOUND = "k long, doc_id long, item_id long, n_seeds long, score double, n_equal long, start_word long, end_word long"


def _one_block(docs: DataFrame, rows: list[tuple[int | None, str]]) -> DataFrame:
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast(Items(rows))

    def count(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, df = block.value, np.zeros(len(block.value.grams), np.int64)
        for batch in batches(iterator):
            for text in batch.column("text").to_pylist():
                df[np.unique(items.hits(items.read(text))[1])] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["gram", "df"])

    own = texts(docs).withColumn("k", id_key())
    frequency = Counter({r["gram"]: r["df"] for r in map_arrow(own.select("text"), count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()})  # a row for each run of the block at most
    items = block.value
    by_item: dict[int, list[int]] = defaultdict(list)
    for gram, places in items.starts.items():
        for at, _ in places:
            by_item[at].append(frequency[items.number[gram]])
    limit = {at: max(RARE_DOCS, float(np.median(dfs))) for at, dfs in by_item.items()}
    seeds = {items.number[g]: kept for g, places in items.starts.items() if (kept := [p for p in places if frequency[items.number[g]] <= limit[p[0]]])}
    rare = spark.sparkContext.broadcast((items, seeds))

    def score(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = rare.value
        is_seed = np.zeros(len(items.grams) + 1, bool)
        is_seed[list(seeds)] = True
        for batch in batches(iterator):
            out = []
            for k, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("k", "doc_id", "text")), strict=True):
                codes = items.read(text)
                at, gram = items.hits(codes)
                keep = is_seed[gram]
                places: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for p, g in zip(at[keep].tolist(), gram[keep].tolist(), strict=True):
                    for item, q in seeds[g]:
                        places[item].append((p, q))
                for item, hits in places.items():
                    code = items.codes[item]
                    best = max((align(code, codes[a:b]) + (a,) for a, b in stretches(hits, len(code), len(codes))), key=lambda x: (x[0], -x[4]))
                    out.append((k, doc_id, items.ids[item], len({q for _, q in hits}), best[0] / (MATCH * len(code)), best[1], best[4] + best[2], best[4] + best[3]))
            if out:
                kinds = [pa.float64() if f.endswith("double") else pa.int64() for f in _FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _FOUND.split(", ")])

    return map_arrow(own.select("k", "doc_id", "text"), score, _FOUND)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that share a rare seed: seeds, score, equal words, words from and to, contaminated.

    A short item (under MIN_MATCHES words) must be there whole.
    """
    out = None
    for block in _blocks(items, id_col, text_col):
        found = _one_block(docs, block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], _FOUND)
    whole = (F.col("score") >= 1.0) | (F.col("n_equal") >= MIN_MATCHES)
    return out.withColumn("contaminated", (F.col("score") >= MIN_SCORE) & whole)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and items whose alignment reaches MIN_SCORE."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("contaminated").select("doc_id", "item_id", "n_seeds", "score", "n_equal", "start_word", "end_word")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of documents that no item contaminates; rows that share an id are judged each by its text."""
    rows = docs.select(row_key().alias("doc_id"), "text")
    return without_rows(docs, matches(rows, items).where("contaminated").select("k"))
