"""Quality by importance resampling: n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are counted by Spark under hashes of as many bits as the corpus asks
for (KEY_ROOM keys a byte of text), so that the models grow with it and n-grams rarely share a count.  The raw model
counts them over all documents, the target model over the documents labelled good and not toxic.
A document's importance weight is the ratio of its likelihoods under the two
models; log weight plus Gumbel noise is its key, and the k largest keys are a
sample without replacement in proportion to the weights (at temperature T, to
weight ** (1 / T)).

Target counts are shrunk to what the raw model expects (PRIOR), and an n-gram's
ratio counts only where its counts differ from chance by MIN_Z deviations: words
too rare to judge are neutral.  Ratios that tell are broadcast up to
MOST_BROADCAST of them and joined by n-gram beyond that.

Toxicity has a score of its own, the greatest log ratio of any of a text's
n-grams between the documents labelled toxic and the good ones (documents that
hold it are counted, both shrunk by TOXIC_PRIOR): neither length nor good prose
around it cancels a toxic word.  The limit is the quantile 1 - FIT_LOSS of the
good documents' scores, each judged without its own counts, and LEAST_TOXIC at
least.  Documents over it are rejected whatever their weight.

k is the number of other documents whose log weight reaches a cutoff.  The models
and the cutoffs are fitted on at most FIT_ROWS of the documents labelled
good and as many labelled toxic, chosen by a hash of their ids; the cutoff is the
quantile FIT_LOSS of the good ones' log weights.  These lists of ids are broadcast, so that no text is shuffled.
Raw counts, weights and the selection cover all documents.

Defined cases: null text counts as empty, weight 1; without labels everything
has weight 1 and all are kept; ties of keys go by id; repeated rows have one
key and are kept or not together; a null id counts as an id of its own; null
labels are no labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, id_key, map_arrow, map_rows, row_key, table, texts, without_rows

PRIOR = 4.0
MIN_Z = 5.0
#: Counts under both of these differ from chance by less than MIN_Z deviations, whatever the totals.
LEAST_RAW, LEAST_TARGET = 26, 5
#: N-grams a task counts at once before it hands the counts on.
COUNTED = 1_500_000
#: Keys a byte of text, as a power of two: under one n-gram in a hundred shares its key.
KEY_ROOM = 5
#: Counts are added up in 2 ** this many ranges of keys, at least and at most.
PARTS_BITS = (12, 18)
#: Counts of a range that a task holds before it adds them up.
ADDED = 1_000_000
#: Ratios sent to the tasks as a whole; 16 bytes each.
MOST_BROADCAST = 4_000_000
#: Stand for all documents, words and pairs; the last bit of a key tells pairs from words.
ALL_DOCS, ALL_WORDS, ALL_PAIRS = -3, -2, -1
COUNTS = ("raw", "target", "toxic", "good")
TEMPERATURE = 1.0
FIT_ROWS = 200_000
FIT_LOSS = 0.005
#: A cutoff above this would reject documents that no n-gram speaks against.
HIGHEST_CUTOFF = -1.0
#: Shrinks the counts of documents by n-gram among toxic and good ones.
TOXIC_PRIOR = 4.0
#: Log ratios under this do not reject.  Less than LEAST_TOXIC_DOCS toxic documents that hold an n-gram never come to it.
LEAST_TOXIC, LEAST_TOXIC_DOCS = 1.0, 3
SEED = 20240229
#: Words whose hashes a task keeps.
KNOWN_WORDS = 200_000

#: What is known of an n-gram, in millionths.
VALUES = ("ratio", "toxic_ratio", "held_out_ratio")

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Codes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED) >> 1
        return code


class _Hasher:
    """Keys of so many bits of a text's words (even) and pairs (odd)."""

    def __init__(self, bits: int = 63) -> None:
        self.known = _Codes()
        self.drop = 63 - bits

    def keys(self, text: str) -> np.ndarray:
        words = _TOKEN.findall(text.lower())
        if not words:
            return np.zeros(0, np.int64)
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        x = codes[:-1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[1:].view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        pairs = ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).view(np.int64)
        return np.concatenate([(codes >> self.drop) & ~1, (pairs >> self.drop) | 1])


def key_bits(docs: DataFrame, text_col: str = "text") -> int:
    """Bits of an n-gram's key for these documents."""
    held = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return min(63, max(32, int(held).bit_length() + KEY_ROOM))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on by the places of their bytes, as many as the largest has."""
    width = (int(numbers.max(initial=0)).bit_length() + 7) // 8
    return np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if packed:
        planes = np.frombuffer(packed, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view(np.int64).reshape(-1)


def models(docs: DataFrame, fit: DataFrame, bits: int = 63) -> DataFrame:
    """ngram and COUNTS: occurrences in the raw and the target text, toxic and good documents that hold it.

    fit: (doc_id, is_toxic), 2 * FIT_ROWS rows at most; those not toxic make the target text.  N-grams that cannot tell
    are left out; rows ALL_WORDS, ALL_PAIRS and ALL_DOCS have the totals.  Tasks hand on counts packed by range of keys.
    """
    marked = texts(docs).withColumn("k", id_key()).join(F.broadcast(fit.select(F.col("doc_id").alias("k"), "is_toxic")), "k", "left")
    names = ["part", "n", "ngrams", *COUNTS]
    part_bits = min(max(bits - 31, PARTS_BITS[0]), PARTS_BITS[1])

    def count(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(bits)
        held: list[list[np.ndarray]] = [[] for _ in COUNTS]
        documents = [0, 0]

        def counted() -> pa.RecordBatch:
            ngrams, raw = np.unique(np.concatenate(held[0]), return_counts=True)
            counts = [raw]
            for h in held[1:]:
                some, n = np.unique(np.concatenate([*h, np.zeros(0, np.int64)]), return_counts=True)
                counts.append(np.zeros(len(ngrams), np.int64))
                counts[-1][np.searchsorted(ngrams, some)] = n
            odd = (ngrams & 1).astype(bool)
            totals = [[*d, int(c[~odd].sum()), int(c[odd].sum())] for d, c in zip([(0,), (0,), documents[:1], documents[1:]], counts, strict=True)]
            for h in held:
                h.clear()
            documents[:] = [0, 0]
            at = np.searchsorted(ngrams >> (bits - part_bits), np.arange((1 << part_bits) + 1))
            rows = [(-1, 3, b"", *map(_packed, map(np.array, totals)))]
            for part in np.flatnonzero(at[1:] > at[:-1]).tolist():
                own = slice(at[part], at[part + 1])
                # the first key counts from where the range begins
                rows.append((part, own.stop - own.start, _packed(np.diff(ngrams[own], prepend=part << (bits - part_bits))), *(_packed(c[own]) for c in counts)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)], strict=True)], names)

        waiting = 0
        for batch in batches(iterator, 4 << 20):
            for text, is_toxic in zip(batch.column("text").to_pylist(), batch.column("is_toxic").to_pylist(), strict=True):
                keys = hasher.keys(text)
                held[0].append(keys)
                if is_toxic is not None:
                    documents[0 if is_toxic else 1] += 1
                    held[2 if is_toxic else 3].append(np.unique(keys))
                    if not is_toxic:
                        held[1].append(keys)
                waiting += len(keys) + 1
                if waiting >= COUNTED:
                    yield counted()
                    waiting = 0
        if waiting:
            yield counted()

    def add(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, waiting = None, [], 0

        def added() -> list[np.ndarray]:
            ngrams, *counts = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(ngrams, kind="stable")
            ngrams = ngrams[order]
            starts = np.flatnonzero(np.diff(ngrams, prepend=ngrams[0] - 1))
            return [ngrams[starts], *(np.add.reduceat(c[order], starts) for c in counts)]

        def told() -> pa.RecordBatch:
            ngrams, *counts = added()
            tells = (ngrams < 0) | (counts[0] >= LEAST_RAW) | (counts[1] >= LEAST_TARGET) | (counts[2] >= LEAST_TOXIC_DOCS)
            return pa.RecordBatch.from_arrays([pa.array(c[tells]) for c in (ngrams, *counts)], ["ngram", *COUNTS])

        for batch in batches(iterator, 4 << 20):
            for part, n, ngrams, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and held:
                    yield told()
                    held, waiting = [], 0
                elif waiting > ADDED and waiting > 2 * len(held[0][0]):
                    held = [added()]
                    waiting = len(held[0][0])
                last = part
                keys = np.array([ALL_DOCS, ALL_WORDS, ALL_PAIRS]) if part < 0 else np.cumsum(_unpacked(ngrams, n)) + (part << (bits - part_bits))
                held.append([keys, *(_unpacked(c, n) for c in counts)])
                waiting += n
        if held:
            yield told()

    packed = map_arrow(marked.select("text", "is_toxic"), count, f"part int, n int, ngrams binary, {', '.join(f'{c} binary' for c in COUNTS)}")
    return cut(map_arrow(packed.repartition("part").sortWithinPartitions("part"), add, f"ngram long, {', '.join(f'{c} long' for c in COUNTS)}"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """ngram, ratio: log of target over raw probability in millionths, of those n-grams whose counts tell."""
    odd = F.col("ngram").bitwiseAND(F.lit(1))
    totals = counts.where(F.col("ngram").isin(ALL_WORDS, ALL_PAIRS)).select(odd.alias("odd"), F.col("raw").alias("all_raw"), F.col("target").alias("all_target")).where("all_target > 0")
    held = counts.where("ngram >= 0").withColumn("odd", odd).join(F.broadcast(totals), "odd")  # two rows
    held = held.withColumn("expected", F.col("raw") * F.col("all_target") / F.col("all_raw"))
    tells = F.abs(F.col("target") - F.col("expected")) >= MIN_Z * F.sqrt(F.col("expected") + 1)
    return cut(held.where(tells).select("ngram", F.round(F.ln((F.col("target") + PRIOR) / (F.col("expected") + PRIOR)) * 1_000_000).cast("long").alias("ratio")))


def toxic_ratios(counts: DataFrame) -> DataFrame:
    """ngram, toxic_ratio and held_out_ratio (without one of the good documents that hold it), in millionths; of those that reach LEAST_TOXIC."""
    totals = counts.where((F.col("ngram") == ALL_DOCS) & (F.col("toxic") > 0) & (F.col("good") > 0)).select((F.col("toxic") / (F.col("toxic") + F.col("good"))).alias("share"))
    toxic, good, share = F.col("toxic"), F.col("good"), F.col("share")

    def ratio(good):
        shrunk = lambda n, part: F.ln((n + TOXIC_PRIOR) / ((toxic + good) * part + TOXIC_PRIOR))
        return F.round((shrunk(toxic, share) - shrunk(good, 1 - share)) * 1_000_000).cast("long")

    held = counts.where((F.col("ngram") >= 0) & (F.col("toxic") >= LEAST_TOXIC_DOCS)).crossJoin(F.broadcast(totals))  # one row
    rated = held.select("ngram", ratio(good).alias("toxic_ratio"), ratio(F.greatest(good - 1, F.lit(0))).alias("held_out_ratio"))
    return cut(rated.where(F.greatest("toxic_ratio", "held_out_ratio") >= LEAST_TOXIC * 1_000_000))


def _gumbel(ids: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise set by the id."""
    x = ids.astype(np.uint64) + np.uint64(SEED)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return -np.log(-np.log(np.clip(u, 1e-16, 1 - 1e-16)))


class _Table:
    """The values VALUES of n-grams, looked up for arrays of keys."""

    def __init__(self, rows: DataFrame) -> None:
        found = rows.select("ngram", *VALUES).orderBy("ngram").toArrow()
        self.ngrams = np.asarray(found.column(0).combine_chunks(), np.int64)
        self.values = np.stack([np.asarray(c.combine_chunks(), np.int64).astype(np.int32) for c in found.columns[1:]], 1)  # millionths of logs of counts

        # most keys of a text are not in the table, which one look at a bit of theirs tells
        self.mask = (1 << (len(self.ngrams).bit_length() + 3)) - 1
        self.maybe = np.zeros(self.mask + 1, bool)
        self.maybe[self.ngrams & self.mask] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of those keys that have any."""
        keys = keys[self.maybe[keys & self.mask]]
        if not len(self.ngrams):
            return np.zeros((0, len(VALUES)), np.int32)
        at = np.minimum(np.searchsorted(self.ngrams, keys), len(self.ngrams) - 1)
        return self.values[at[self.ngrams[at] == keys]]


def _joined_weights(docs: DataFrame, values: DataFrame, bits: int) -> DataFrame:
    """k, doc_id, h, n_words, w and the toxicities of every row, by a join of its n-grams with the values."""

    def explode(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(bits)
        for batch in batches(iterator, 1 << 20):
            found = [np.unique(hasher.keys(t), return_counts=True) for t in batch.column("text").to_pylist()]
            # a row's own line, of no n-gram, keeps rows that nothing joins; it bears the number of its words
            each = np.repeat(np.arange(len(found)), [len(n) + 1 for _, n in found])
            ngrams = np.concatenate([np.append(g, -1) for g, _ in found])
            times = np.concatenate([np.append(n, (n.sum() + 1) // 2) for _, n in found])
            rows = pa.array(each)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("row", "k", "doc_id", "h")] + [pa.array(ngrams), pa.array(times.astype(np.int64))], ["row", "k", "doc_id", "h", "ngram", "times"])

    numbered = cut(docs.select(F.monotonically_increasing_id().alias("row"), "k", "doc_id", "h", "text"))  # a row's number stays the same
    exploded = map_arrow(numbered, explode, "row long, k long, doc_id long, h long, ngram long, times long")
    own = F.col("ngram") < 0
    joined = exploded.join(values.hint("merge"), "ngram", "left").where(own | F.col("ratio").isNotNull())
    greatest = [F.greatest(F.max(c), F.lit(0)).alias(c) for c in VALUES[1:]]
    return joined.groupBy("row", "k", "doc_id", "h").agg(F.sum(F.when(own, F.col("times"))).alias("n_words"), F.sum(F.when(own, F.lit(0)).otherwise(F.col("times") * F.col("ratio"))).alias("w"), *greatest).drop("row")


def weights(docs: DataFrame, ratios: DataFrame, toxic: DataFrame | None = None, bits: int = 63, temperature: float = TEMPERATURE) -> DataFrame:
    """k (the id, or LAST_ID), doc_id, h (row_key), n_words, log_weight, key, toxicity and held_out (toxicity as of a good document not counted) of every row."""
    rows = texts(docs).withColumns({"k": id_key(), "h": row_key()}).select("k", "doc_id", "h", "text")
    none = F.lit(0).cast("long")
    values = ratios.join(toxic, "ngram", "full") if toxic is not None else ratios.select("*", *(none.alias(c) for c in VALUES[1:]))
    values = cut(values.select("ngram", *(F.coalesce(c, none).alias(c) for c in VALUES)))
    listed = values.count() <= MOST_BROADCAST
    if listed:
        shared = docs.sparkSession.sparkContext.broadcast(_Table(values))

        def add(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, table_ = _Hasher(bits), shared.value
            for batch in batches(iterator, 4 << 20):
                numbers: list[list[int]] = [[], [], [], []]
                for text in batch.column("text").to_pylist():
                    keys = hasher.keys(text)
                    values = table_(keys)
                    for held, n in zip(numbers, ((len(keys) + 1) // 2, values[:, 0].sum(dtype=np.int64), values[:, 1].max(initial=0), values[:, 2].max(initial=0)), strict=True):
                        held.append(int(n))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), batch.column("h"), *(pa.array(n, pa.int64()) for n in numbers)], ["k", "doc_id", "h", "n_words", "w", *VALUES[1:]])

    def key(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = np.asarray(batch.column("k"), np.int64)
        w, toxic, held_out = (np.asarray(batch.column(c), np.int64) / 1_000_000 for c in ("w", *VALUES[1:]))
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), batch.column("h"), batch.column("n_words"), *map(pa.array, (w, w / temperature + _gumbel(k), toxic, held_out))], ["k", "doc_id", "h", "n_words", "log_weight", "key", "toxicity", "held_out"])

    schema = "k long, doc_id long, h long, n_words long, log_weight double, key double, toxicity double, held_out double"
    if not listed:
        return map_rows(_joined_weights(rows, values, bits), key, schema)
    return map_arrow(rows, lambda iterator: map(key, add(iterator)), schema)  # one pass, so one worker a task


def nth_smallest(rows: DataFrame, column: str, n: int) -> tuple[int, int] | None:
    """The value of the n-th row (from 1) by a long column, and how many rows are smaller; None if there are fewer.

    Each pass narrows the range to one of 65,536 parts and returns as many counts at most.
    """
    v = F.col(column).cast("decimal(20,0)")
    low, high = rows.agg(F.min(v), F.max(v)).first()
    if low is None or n <= 0:
        return None
    low, high, before = int(low), int(high), 0
    while low < high:
        width = (high - low) // 65_536 + 1
        part = F.floor((v - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        counts = dict(rows.where(v.between(F.lit(low), F.lit(high))).groupBy(part.alias("c")).count().collect())
        for c in sorted(counts):
            if before + counts[c] >= n:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            before += counts[c]
        else:
            return None
    return low, before


def micro(column: str = "key"):
    """The key in millionths, an integer."""
    return F.round(F.col(column) * 1_000_000).cast("long")


def kth_largest(scored: DataFrame, k: int) -> tuple[int, int] | None:
    """(key in millionths, id) of the k-th of the distinct (key, id) rows by descending key, then ascending id; None if there is none."""
    rows = scored.select((-micro()).alias("v"), "k").distinct()
    found = nth_smallest(rows, "v", k)
    if found is None:
        return None
    value, before = found
    tied = nth_smallest(rows.where(F.col("v") == value), "k", k - before)
    return -value, tied[0]


def _cutoffs(scored: DataFrame, good: DataFrame) -> tuple[float, float]:
    """The log weight that all but FIT_LOSS of the good documents reach, and the toxicity that all but FIT_LOSS keep to."""
    held = scored.join(F.broadcast(good.select(F.col("doc_id").alias("k"))), "k")
    least, most = held.agg(F.percentile("log_weight", F.lit(FIT_LOSS)), F.percentile("held_out", F.lit(1 - FIT_LOSS))).first()
    return -math.inf if least is None else min(float(least), HIGHEST_CUTOFF), LEAST_TOXIC if most is None else max(float(most), LEAST_TOXIC)


def sampled(scored: DataFrame, k: int) -> DataFrame:
    """The rows (k, key, decent, ...) with selected: whether a row is of the k largest keys of the decent ones."""
    last = kth_largest(scored.where("decent"), k)
    if last is None:
        return scored.withColumn("selected", F.lit(False) if k <= 0 else F.col("decent"))
    value, tied = last
    return scored.withColumn("selected", F.col("decent") & ((micro() > value) | ((micro() == value) & (F.col("k") <= tied))))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, n_words, log_weight, key, selected for every row of docs: k of them are selected, by default as many as the cutoffs let pass."""
    return _resampled(docs, labels, k, temperature).select("doc_id", "n_words", "log_weight", "key", "selected")


def _resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    judged = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") >= 1).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) >= 1).alias("is_toxic"))
    judged = judged.where("is_toxic OR fine").select("doc_id", "is_toxic")
    chosen = lambda toxic: judged.where(F.col("is_toxic") == F.lit(toxic)).orderBy(F.xxhash64("doc_id")).limit(FIT_ROWS)
    good, bad = cut(chosen(False)), cut(chosen(True))
    bits = key_bits(docs)
    counts = models(docs, good.unionByName(bad), bits)
    scored = cut(weights(docs, log_ratios(counts), toxic_ratios(counts), bits, temperature))
    cutoff, limit = _cutoffs(scored, good)
    scored = scored.withColumn("decent", F.col("toxicity") <= F.lit(limit))
    if k is None:
        k = scored.where(F.col("decent") & (F.col("log_weight") >= F.lit(cutoff))).select("k").distinct().count()
    return sampled(scored, k)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def selected_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the sample takes; rows that share an id are judged each by its text."""
    return without_rows(docs, _resampled(docs, labels).where("NOT selected").select("h"))
