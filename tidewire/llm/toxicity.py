"""Toxicity by compression distance (12).

Two zstandard dictionaries are trained apart, one on toxic and one on ordinary labelled texts.  A window is a word of
letters, in lower case, between spaces (without them zstandard stores so short a block raw).  Its gain is the number of bytes
that it takes less when the toxic dictionary stands behind the ordinary one than with the ordinary one alone.  A text's
windows are its distinct words; how many gain 1, 2, 3 and 4 bytes or more, in all and by the number of windows, goes
into a logistic calibration, whose 0.5 is the threshold.

Fitting takes at most TOXIC_ROWS and ORDINARY_ROWS labelled rows, those with the least hash of their id, and at most
ROW_WORDS words of each, those with the least hash.  Rows with crc32(doc_id) mod 5 = 0 are never among them; 1 to 3 train
the dictionaries, 4 fits the calibration, so that it does not see what the dictionaries hold by heart.  Ordinary words
that gain from the toxic dictionary by chance, in MOST_RATIO of the toxic share of texts or more, are put into the ordinary one
for a second round.

Odd input: a null text is an empty one; an empty text has no window and takes the score of such; a word of more than 64
letters is several windows; a null id counts as empty text for crc32; rows that repeat are scored each; several labels of
an id count as toxic if one is; without labels of both kinds every score is the share of toxic labels (0 without any).
Columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, map_arrow, map_rows, table

#: Bounds of the rows that a model is fitted on, and of each row's words.
TOXIC_ROWS, ORDINARY_ROWS, ROW_WORDS = 3_000, 9_000, 600
#: Bytes of the dictionaries, and the trainer's segment and piece lengths.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, PIECE = 16_384, 262_144, 24, 8
MOST_RATIO = 1 / 3
ROUNDS = 2
GAINS = (1, 2, 3, 4)
#: Words whose gain a task remembers.
REMEMBERED = 300_000
SPACE = b" " * 24
WORD = re.compile(r"[^\W\d_]{1,64}")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def words_of(text: str) -> list[str]:
    """The distinct windows of a text, in order of the alphabet."""
    return sorted(set(WORD.findall(text.lower())))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, source_size=64, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0,
        strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=20, hash_log=18, chain_log=18, search_log=10, target_length=64,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings)


class Gains:
    """What windows gain from the toxic dictionary, in bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(ordinary + toxic)
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for word in words:
            if word not in known:
                window = SPACE + b" " + word.encode() + b" " + SPACE
                known[word] = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return np.fromiter((known[w] for w in words), np.int64, len(words))


def features(gains: np.ndarray) -> np.ndarray:
    n = max(len(gains), 1)
    hits = np.array([(gains >= g).sum() for g in GAINS], float)
    size = np.sqrt(n + 10)
    return np.concatenate([hits / size, np.log1p(hits), hits / n * 10, [np.clip(gains, 0, 9).sum() / size, np.log(n)]])


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; without dictionaries every score is ``share``."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, gains: np.ndarray) -> float:
        if self.weights is None:
            return self.share
        z = self.weights[0] + ((features(gains) - self.mean) / self.spread) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are hardly longer."""
    samples = [s for s in samples if len(s) > PIECE]
    if sum(map(len, samples)) >= 4 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=PIECE, level=3).as_bytes()
        except zstandard.ZstdError:  # too few samples
            pass
    return b"".join(samples)[-size:]


def _calibration(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = x.mean(0), x.std(0) + 1e-9
    x = np.c_[np.ones(len(x)), (x - mean) / spread]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def fit(rows: list[tuple[int, int, str]]) -> Model:
    """A model from (fold, toxic, words between spaces) of labelled rows."""
    share = sum(t for _, t, _ in rows) / len(rows) if rows else 0.0
    train, held = [r for r in rows if r[0] != 4], [r for r in rows if r[0] == 4]
    if any(len({t for _, t, _ in part}) < 2 for part in (train, held)):
        return Model(share)

    def samples(kind: int) -> list[bytes]:
        out = []
        for i, (_, t, words) in enumerate(train):
            if t == kind:
                random.Random(i).shuffle(mixed := words.split())
                out.append((" " + " ".join(mixed) + " ").encode())
        return out

    ordinary, toxic = _dictionary(samples(0), ORDINARY_BYTES), _dictionary(samples(1), TOXIC_BYTES)
    n = Counter(t for _, t, _ in train)
    in_toxic = Counter(w for _, t, words in train if t for w in words.split())
    tried = sorted(w for w, c in in_toxic.items() if c > 1)
    in_ordinary = dict.fromkeys(tried, 0)
    for _, t, words in train:
        if not t:
            for w in words.split():
                if w in in_ordinary:
                    in_ordinary[w] += 1
    for _ in range(ROUNDS):
        gains = Gains(ordinary, toxic)(tried)
        chance = [w for w, g in zip(tried, gains, strict=True) if g >= 2 and in_ordinary[w] / n[0] >= MOST_RATIO * in_toxic[w] / n[1]]
        ordinary = (" " + " ".join(chance) + " ").encode() + ordinary
    gain = Gains(ordinary, toxic)
    calibration = _calibration(np.array([features(gain(words.split())) for _, _, words in held]), np.array([t for _, t, _ in held], float))
    return Model(share, ordinary, toxic, *calibration)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def _labelled_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = []
    for text in batch["text"].to_pylist():
        words = words_of(text or "")
        if len(words) > ROW_WORDS:
            words = sorted(sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:ROW_WORDS])
        found.append(" ".join(words))
    return pa.RecordBatch.from_arrays([batch["fold"], batch["toxic"], pa.array(found)], ["fold", "toxic", "words"])


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows; only a bounded sample of them reaches the driver."""
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold(F.col("doc_id")) != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = own.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(own.where("toxic = 0").orderBy(*order).limit(ORDINARY_ROWS))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    words = map_rows(texts.select(fold(F.col("doc_id")).cast("int").alias("fold"), "toxic", "text"), _labelled_words, "fold int, toxic int, words string")
    return fit(sorted((r["fold"], r["toxic"], r["words"]) for r in words.collect()))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Gains(model.ordinary, model.toxic) if model.weights is not None else lambda words: np.zeros(0)
        for batch in batches(iterator, 4 << 20):
            scores = [model.score(gain(words_of(text or ""))) for text in batch["text"].to_pylist()]
            predicted = [int(s >= 0.5) for s in scores]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(rows, run, SCHEMA)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scored(documents, trained(documents, table(spark, sf_dir, "labels")))
