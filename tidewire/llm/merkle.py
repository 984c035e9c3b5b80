"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into paragraphs at line feeds and each paragraph into leaves at
content-defined spaces, so an edit changes the leaves it touches and no others.
A section ends after a paragraph whose hash says so.  Leaf hashes make section
hashes, section hashes the root.

The fingerprint is ``root/section:leaf.leaf.../section:...``, 16 hexadecimal
digits for the root, 8 for a section and 8 for a leaf.  Equal roots mean equal
texts; equal sections are skipped whole; the leaves that differ locate edits.

Defined cases: null text counts as empty, whose tree has a root and no section;
two empty texts are alike (1.0), an empty and another text are not (0.0).  Rows
with one doc_id follow each other in the order of their texts; a null doc_id
comes first in descending order.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, id_key, map_arrow, table, texts

#: A space ends a leaf if the three bytes before it hash to 0 modulo this; one word in so many.
LEAF_EVERY = 8
#: A paragraph ends a section if its hash is 0 modulo this.
SECTION_EVERY = 4
#: Rows a range of ids should hold; ranges, not rows, are listed on the driver.
RANGE_ROWS = 4_000
MOST_RANGES = 20_000


def _hash(data: bytes, size: int = 4) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def tree(text: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """The root and the sections, each with its leaves."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return _hash(b"empty", 8).hex(), []
    codes = np.frombuffer(data, np.uint8)
    mix = np.zeros(len(codes), np.uint32)
    for back, factor in ((1, 2654435761), (2, 2246822519), (3, 3266489917)):
        mix[back:] += codes[:-back] * np.uint32(factor)
    line = codes == 10
    ends = np.flatnonzero(line | ((codes == 32) & ((mix >> np.uint32(16)) % LEAF_EVERY == 0))) + 1
    ends = ends.tolist()
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    sections, leaves, paragraph, start = [], [], b"", 0
    for end in ends:
        leaf = _hash(data[start:end])
        leaves.append(leaf.hex())
        paragraph += leaf
        if data[end - 1] == 10:
            if _hash(paragraph, 1)[0] % SECTION_EVERY == 0:
                sections.append(leaves)
                leaves = []
            paragraph = b""
        start = end
    if leaves:
        sections.append(leaves)
    hashed = [(_hash("".join(s).encode()).hex(), s) for s in sections]
    # the root covers the bytes too, so that equal roots mean equal texts and not only equal leaves
    return _hash("".join(s for s, _ in hashed).encode() + _hash(data, 16), 8).hex(), hashed


def fingerprint(text: str) -> str:
    root, sections = tree(text)
    return "/".join([root, *(f"{s}:{'.'.join(leaves)}" for s, leaves in sections)])


def likeness(one: str, other: str) -> float:
    """Share of leaves that two fingerprints have in common, equal sections first: 2 * common / (leaves of both)."""
    if one.partition("/")[0] == other.partition("/")[0]:
        return 1.0
    a, b = ([tuple(s.split(":")) for s in x.split("/")[1:]] for x in (one, other))
    same = Counter(s for s, _ in a) & Counter(s for s, _ in b)
    common, rest = 0, []
    for side, sections in enumerate((a, b)):
        left, leaves = dict(same), []
        for s, joined in sections:
            if left.get(s):
                left[s] -= 1
                common += (joined.count(".") + 1) * (side == 0)
            else:
                leaves += joined.split(".")
        rest.append(leaves)
    common2 = sum((Counter(rest[0]) & Counter(rest[1])).values())
    total = 2 * common + len(rest[0]) + len(rest[1])
    return 2 * (common + common2) / total if total else 0.0


def differing(one: str, other: str) -> list[int]:
    """Places (leaf numbers of the first) where the first has leaves that the second has not."""
    left = Counter(leaf for s in other.split("/")[1:] for leaf in s.split(":")[1].split("."))
    out, n = [], 0
    for s in one.split("/")[1:]:
        for leaf in s.split(":")[1].split("."):
            if left[leaf]:
                left[leaf] -= 1
            else:
                out.append(n)
            n += 1
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(fingerprint, batch.column(1).to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last third of the text is replaced by as much of the beginning of the next."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair(doc_id, text: str, fp: str, following: str, next_fp: str) -> tuple:
    changed = edited(text, following)
    changed_fp = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fp, changed_fp, likeness(fp, changed_fp), likeness(fp, next_fp)


def _ranges(keys: DataFrame) -> list[int]:
    """Lower bounds of ranges of about RANGE_ROWS ids: one number a range."""
    rows = keys.count()
    n = min(MOST_RANGES, max(1, rows // RANGE_ROWS))
    if n == 1:
        return []
    cuts = keys.stat.approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)
    return sorted({int(c) for c in cuts})


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below a key: first among every width-th bound, then within one stretch, so that the plan has two array literals whatever their number."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= key))
    heads = below(F.lit([c[0] for c in chunks]))
    # of chunk heads[n - 1] the first bounds are below
    listed = F.split(F.lit("|".join(",".join(map(str, c)) for c in chunks)), r"\|")
    stretch = F.split(F.get(listed, F.greatest(heads - 1, F.lit(0))), ",").cast("array<long>")
    return F.when(heads == 0, 0).otherwise((heads - 1) * width + below(stretch)).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare each document with its edited text and with the next one in descending order of doc_id.

    One shuffle: ids fall into ranges, each of which is sorted in a task.  The
    highest row of a range is also sent to the range above it, whose lowest row
    it follows; the highest of all follows the lowest of all.
    """
    own = texts(docs, id_col, text_col).withColumn("k", id_key())
    bounds = _ranges(own.select("k"))
    own = own.withColumn("part", _range_of(F.col("k"), bounds))
    tops = {r["part"]: r["top"] for r in own.groupBy("part").agg(F.max("k").alias("top")).collect()}
    filled = sorted(tops)
    # ghosts: range -> the highest key of the filled range below it, or of all for the lowest
    below = {p: tops[filled[i - 1]] for i, p in enumerate(filled)}
    heads = {top: p for p, top in below.items()}
    extra = own.sparkSession.createDataFrame(list(heads.items()), "k long, to int") if heads else None
    rows = own.select("part", F.lit(False).alias("ghost"), "k", "doc_id", "text")
    if extra is not None:
        rows = rows.unionByName(own.join(F.broadcast(extra), "k").select(F.col("to").alias("part"), F.lit(True).alias("ghost"), "k", "doc_id", "text"))
    n = max(1, len(filled))
    # the ghosts of a range come last; of several rows with the ghost's key the first in order is the next one
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "ghost", F.col("k").desc(), "text")

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None
        for batch in batches(iterator, 8 << 20):
            out = []
            for p, ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True):
                if ghost and done == p:
                    continue
                row = (p, doc_id, text, fingerprint(text))
                if held is not None:
                    out.append(_pair(held[1], held[2], held[3], text, row[3]))
                held, done = (None, p) if ghost else (row, done)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in _PAIRS.split(", ")])

    return map_arrow(rows, run, _PAIRS)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
