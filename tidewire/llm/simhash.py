"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles with numpy: exclusive-or and bit counts of
whole blocks.  Distinct fingerprints are dealt into tiles by population count;
a pair of tiles whose counts differ beyond the radius is skipped, since those
fingerprints differ in as many bits at least.

For small radii the tiles are first divided by bit blocks: of 4 blocks of 16
bits, 2 at least stay equal when 2 bits change, so fingerprints within the
radius share one of 6 pairs of blocks.  The comparison within a tile is exact.

The pipeline's stage (deduplicated_documents) takes 256 bits a text and holds
what lies within its radii against the shingles.  Its tiles are those texts that
share the least of their shingles under one of several hashes: similar texts
share one almost surely, so that the work grows with the groups, not with all pairs.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and is linked like any other; repeated rows share their fingerprint and so
their class; rows with a null id are fingerprinted and get the class of their
fingerprint (null if no row of the class has an id).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import MOST_IDS, batches, cut, map_arrow, map_rows, of_ids, row_key, table, texts, without_ids, without_rows

SEED = 42
#: Fingerprints in a tile, at most about.
TILE = 4096
#: Rows of a tile compared with the other tile at once.
BLOCK = 512


def shingle_hashes(text: str, width: int, distinct: bool = False) -> np.ndarray:
    """XXH64 of each run of ``width`` words of the text with A-Z lower-cased; of all words, if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64)
    return np.unique(hashes) if distinct else hashes


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; unsigned."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[start : start + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), n_shingles (distinct ones if so asked)."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, width, distinct) for t in batch.column("text").to_pylist()]
        fps = np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), pa.array([len(h) for h in hashes], pa.int64())], ["doc_id", "fp", "n_shingles"])

    return map_rows(texts(docs, id_col, text_col), scan, "doc_id long, fp long, n_shingles long")


def _bands(radius: int) -> list[int]:
    """Masks of which fingerprints within the radius agree under one at least; a mask of all rows for large radii."""
    if radius > 2:
        return [0]
    blocks = [0xFFFF << (16 * i) for i in range(4)]
    return [sum(c) for c in itertools.combinations(blocks, 4 - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def tiles(fps: DataFrame, radius: int, near: int = 0) -> DataFrame:
    """Deal rows (fp, n, band) to pairs of tiles: (mask, key, one, two, own, fp, n).

    Tiles of one group hold fingerprints of one band and population count, TILE
    of them at most about.  A pair of tiles comes up if bands differ by ``near``
    at most and population counts by ``radius``.
    """
    masks = _bands(radius)
    keyed = fps.select("fp", "n", "band", F.bit_count("fp").cast("int").alias("pop"), F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k"))
    keyed = keyed.select("fp", "n", "band", "pop", F.col("k.mask").alias("mask"), F.col("k.key").alias("key"))
    sizes = keyed.groupBy("mask", "key", "band", "pop").agg(F.count("*").alias("held"))
    groups = sizes.groupBy("mask", "key").agg(
        F.sum("held").alias("total"), F.collect_list(F.struct("band", "pop", F.ceil(F.col("held") / TILE).cast("int").alias("parts"))).alias("cells")
    ).where("total > 1")  # at most 65 counts times the bands of a key
    rows = keyed.join(groups, ["mask", "key"])
    # a small group is one tile
    small = rows.where(F.col("total") <= TILE).select("mask", "key", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("own"), "fp", "n")
    large = rows.where(F.col("total") > TILE)
    number = lambda band, pop, part: (band * 65 + pop) * 100_000 + part
    parts = F.element_at(F.filter("cells", lambda c: (c["band"] == F.col("band")) & (c["pop"] == F.col("pop"))), 1)["parts"]
    own = number(F.col("band").cast("long"), F.col("pop"), F.pmod(F.xxhash64("fp"), parts))
    close = F.filter("cells", lambda c: (F.abs(c["band"] - F.col("band")) <= near) & (F.abs(c["pop"] - F.col("pop")) <= radius))
    others = F.flatten(F.transform(close, lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda i: number(c["band"].cast("long"), c["pop"], i))))
    large = large.withColumn("own", own).select("mask", "key", "own", "fp", "n", F.explode(others).alias("other"))
    large = large.select("mask", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "fp", "n")
    return small.unionByName(large)


class _Classes:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(own: np.ndarray, fps: np.ndarray, sizes: np.ndarray, one: int, two: int, close: int, radius: int, ratio: float) -> list[tuple[int, int]]:
    """Pairs of one tile pair: enough of those within ``close`` to connect them, and all within the radius between the classes these make."""
    a, b = (fps, fps) if one == two else (fps[own == one], fps[own == two])
    na, nb = (sizes, sizes) if one == two else (sizes[own == one], sizes[own == two])
    found: list[tuple[int, int]] = []
    far: list[tuple[int, int]] = []
    classes = _Classes(len(a) if one == two else len(a) + len(b))
    shift = 0 if one == two else len(a)
    for start in range(0, len(a), BLOCK):
        bits = np.bitwise_count(a[start : start + BLOCK, None] ^ b[None, :])
        rows, cols = np.nonzero(bits <= radius)
        rows_at = rows + start
        keep = rows_at < cols if one == two else np.ones(len(rows), bool)
        rows, cols, rows_at = rows[keep], cols[keep], rows_at[keep]
        is_close = bits[rows, cols] <= close
        for i, j in zip(rows_at[is_close].tolist(), cols[is_close].tolist(), strict=True):
            if classes.link(i, j + shift):
                found.append((int(a[i]), int(b[j])))
        if radius > close:
            rows_at, cols = rows_at[~is_close], cols[~is_close]
            x, y = na[rows_at], nb[cols]
            fits = np.minimum(x, y) >= ratio * np.maximum(x, y)
            far += zip(rows_at[fits].tolist(), cols[fits].tolist(), strict=True)
    return found + [(int(a[i]), int(b[j])) for i, j in far if classes.find(i) != classes.find(j + shift)]


def links(fps: DataFrame, radius: int = 2, close: int | None = None, ratio: float = 0.0) -> DataFrame:
    """Pairs (a, b, bits) of distinct fingerprints.

    Those within ``close`` bits (by default the radius) are connected by the pairs
    returned, though not each is; between what these connect in a tile, all
    pairs within the radius come, if the sizes ``n`` of the two agree to ``ratio``.
    Rows are (fp, n); fp is distinct.
    """
    close = radius if close is None else close
    width = np.log(1 / ratio) if ratio else None
    band = F.floor(F.ln(F.greatest(F.col("n"), F.lit(1))) / F.lit(float(width))).cast("int") if width else F.lit(0)
    sized = fps.select("fp", "n", band.alias("band"))
    dealt = tiles(sized, radius, 1 if width else 0)
    order = ["mask", "key", "one", "two"]
    dealt = dealt.select(*order, "own", "fp", "n").repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order, "own", "fp")

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in itertools.chain(batches(iterator), [None]):
            if batch is not None:
                columns = [np.asarray(batch.column(c), np.int64) for c in range(7)]
                data = np.stack(columns, 1)
                data = np.concatenate([*held, data]) if held else data
            elif held:
                data = held[0]
            else:
                break
            edges = np.flatnonzero((data[1:, :4] != data[:-1, :4]).any(1)) + 1
            ends = [*edges.tolist(), *([len(data)] if batch is None else [])]
            out, start = [], 0
            for end in ends:
                part = data[start:end]
                if len(part) > 1:
                    out += _compare(part[:, 4], np.ascontiguousarray(part[:, 5]).view(np.uint64), part[:, 6], int(part[0, 2]), int(part[0, 3]), close, radius, ratio)
                start = end
            held = [data[start:]] if start < len(data) else []
            if out:
                pairs = np.array(out, np.uint64)
                bits = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(bits)], ["a", "b", "bits"])

    return map_arrow(dealt, run, "a long, b long, bits int")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (least id of the class) for every row; classes join what links of at most ``radius`` bits connect."""
    own = cut(fingerprints(docs, width, id_col=id_col, text_col=text_col).select("doc_id", "fp"))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(classes.select("fp", F.lit(1).cast("long").alias("n")), radius)
    component = connected_components(edges.select("a", "b"), cut).select(F.col("node").alias("fp"), "component")
    named = classes.join(component, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


#: The pipeline's stage: five words, similarity 0.8 or more.
STAGE_WIDTH, STAGE_SIMILARITY = 5, 0.8
#: Bits in which the first word and all words of candidates' prints differ at most.  At Jaccard 0.8 a bit differs with
#: probability 0.15 (0.19 for 4 against 5 shingles): under one pair in a thousand lies beyond either bound.
STAGE_RADIUS, STAGE_WIDE_RADIUS = 22, 68
#: Hashes of which the least shingle is taken.  Texts of Jaccard 0.8 share none of them with probability 0.2 ** SLOTS, 6.4e-5.
SLOTS = 6
#: Prints in a tile of the stage, at most about, and rows of it compared at once.
STAGE_TILE, STAGE_BLOCK = 8192, 128
#: Keys with more prints than a tile that are broadcast with their counts; more are joined.
MOST_HOT = 1_000_000
#: The words of a print: the fingerprint, and those of the same hashes mixed anew.
WORDS = ("fp", "fp1", "fp2", "fp3")
#: The least shingles, 32 bits each, two to a long.
LEAST = ("least0", "least1", "least2")
PRINT = (*WORDS, *LEAST)


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """PRINT of a set of hashes: 256 bits, which tell similarity closer than 64 do, and the least hash of each slot (all ones without hashes)."""
    words, least = [], np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for i in range(SLOTS):
        x = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)) if i else ():
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31)) if i else x
        if i < len(WORDS):
            words.append(fingerprint(x))
        if len(x):
            least[i] = x.min() >> np.uint64(32)
    return np.concatenate([np.array(words, np.uint64).view(np.int64), least.view(np.int64)])


def wide_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, PRINT (signed longs) and n_shingles (distinct ones) for every row."""

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, width, True) for t in batch.column("text").to_pylist()]
        prints = np.stack([wide_print(h) for h in hashes])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(prints[:, i]) for i in range(len(PRINT))), pa.array([len(h) for h in hashes], pa.int64())], ["doc_id", *PRINT, "n_shingles"])

    return map_rows(texts(docs), scan, f"doc_id long, {', '.join(f'{w} long' for w in PRINT)}, n_shingles long")


def _close(prints: np.ndarray, least: np.ndarray, sizes: np.ndarray, begin: int, first: int, classes: np.ndarray | None, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of the block from begin, one from first on: within the radii, of similar size, of different classes, without a common least shingle in an earlier slot."""
    block = prints[begin : begin + STAGE_BLOCK, None, 0]
    x, y = np.nonzero(np.bitwise_count(block ^ prints[None, first:, 0]) <= STAGE_RADIUS)
    x, y = x + begin, y + first
    keep = x < y
    if classes is not None:
        keep &= classes[x] != classes[y]
    x, y = x[keep], y[keep]
    keep = np.minimum(sizes[x], sizes[y]) >= STAGE_SIMILARITY * np.maximum(sizes[x], sizes[y])
    keep &= ~(least[x, :slot] == least[y, :slot]).any(1)
    x, y = x[keep], y[keep]
    bits = np.zeros(len(x), np.int64)
    for word in range(len(WORDS)):
        bits += np.bitwise_count(prints[x, word] ^ prints[y, word])
    return x[bits <= STAGE_WIDE_RADIUS], y[bits <= STAGE_WIDE_RADIUS]


def _tile(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(order that puts one tile before the other, prints, least, size of the first tile, where partners begin) of a tile pair's rows (slot, key, one, two, own, id, n, *PRINT)."""
    order = np.argsort(rows[:, 4] != rows[0, 2], kind="stable")
    rows = rows[order]
    n_first = int((rows[:, 4] == rows[0, 2]).sum())
    at = 7 + len(WORDS)
    return order, np.ascontiguousarray(rows[:, 7:at]).view(np.uint64), np.ascontiguousarray(rows[:, at:]).view(np.uint32), n_first, 0 if rows[0, 2] == rows[0, 3] else n_first


def _marks(rows: np.ndarray, _: list | None) -> np.ndarray:
    """(id, slot) of the rows of a tile pair that have a partner in it."""
    order, prints, least, n_first, first = _tile(rows)
    rows = rows[order]
    slot, found = int(rows[0, 0]), np.zeros(len(rows), bool)
    for begin in range(0, n_first, STAGE_BLOCK):
        x, y = _close(prints, least, rows[:, 6], begin, first, None, slot)
        x, y = x[x < n_first], y[x < n_first]
        found[x] = found[y] = True
    return np.stack([rows[found, 5], np.full(int(found.sum()), slot)], 1)


def _similar(rows: np.ndarray, grams: list[bytes]) -> np.ndarray:
    """Pairs of ids of a tile pair whose sets of shingles are similar (Jaccard): enough to connect all that such pairs connect."""
    order, prints, least, n_first, first = _tile(rows)
    rows = rows[order]
    sets = [np.frombuffer(grams[i], np.uint32) for i in order.tolist()]
    classes, out = np.arange(len(rows)), []
    for begin in range(0, n_first, STAGE_BLOCK):
        x, y = _close(prints, least, rows[:, 6], begin, first, classes, int(rows[0, 0]))
        inside = x < n_first
        for i, j in zip(x[inside].tolist(), y[inside].tolist(), strict=True):
            if classes[i] != classes[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= STAGE_SIMILARITY * (len(sets[i]) + len(sets[j]) - common):
                    classes[classes == classes[j]] = classes[i]
                    out.append((rows[i, 5], rows[j, 5]))
    return np.array(out, np.int64).reshape(-1, 2)


def _by_tile(rows: DataFrame, function: Callable[[np.ndarray, list | None], np.ndarray], names: tuple[str, str]) -> DataFrame:
    """function of each tile pair's rows (id, n, *PRINT, slots, and grams if there are any): rows with one least shingle in a slot make a tile, or several that are compared pair by pair."""
    columns = ["id", "n", *PRINT, *(["grams"] if "grams" in rows.columns else [])]
    half = lambda i: F.shiftrightunsigned(F.col(LEAST[i // 2]), 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    keys = F.array(*[half(i) for i in range(SLOTS)])
    keyed = rows.select(*columns, F.explode(F.transform("slots", lambda s: F.struct(s.alias("slot"), F.get(keys, s).alias("key")))).alias("k"))
    keyed = keyed.select(F.col("k.slot").alias("slot"), F.col("k.key").alias("key"), *columns)
    hot = cut(keyed.groupBy("slot", "key").agg(F.ceil(F.count("*") / STAGE_TILE).cast("int").alias("parts")).where("parts > 1"))
    n_hot = hot.count()
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, ["slot", "key"], "left")
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("id"), parts).cast("int")
        keyed = keyed.select("slot", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"), *columns)
    else:
        keyed = keyed.select("slot", "key", F.lit(0).alias("own"), F.lit(0).alias("other"), *columns)
    tile = ["slot", "key", "one", "two"]
    dealt = keyed.select("slot", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", *columns).repartition(*tile).sortWithinPartitions(*tile, "own", "id")
    numbers = 7 + len(PRINT)

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        grams: list[bytes] = []
        for batch in itertools.chain(batches(iterator), [None]):
            if batch is not None:
                held.append(np.stack([np.asarray(c, np.int64) for c in batch.columns[:numbers]], 1))
                grams += batch.column(numbers).to_pylist() if batch.num_columns > numbers else []
                if (held[0][0, :4] == held[-1][-1, :4]).all():
                    continue
            if not held:
                break
            data = np.concatenate(held)
            edges = np.flatnonzero((data[1:, :4] != data[:-1, :4]).any(1)) + 1
            ends = np.append(edges, len(data)) if batch is None else edges
            starts = np.append(0, edges)[: len(ends)]
            several = ends - starts > 1
            found = [function(data[x:y], grams[x:y]) for x, y in zip(starts[several].tolist(), ends[several].tolist(), strict=True)]
            if found:
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], list(names))
            rest = int(ends[-1]) if len(ends) else 0
            held, grams = [data[rest:]] if rest < len(data) else [], grams[rest:]

    return map_arrow(dealt, run, f"{names[0]} long, {names[1]} long")


def similar_pairs(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of prints (id, n, *PRINT) that connect all texts similar to STAGE_SIMILARITY.

    A first pass marks the rows that have a partner within the radii, and the slots where they meet; only these fetch
    their shingles, as 32 bits of each hash (of n shingles about n / 2 ** 32 may be taken for others), and meet again.
    Both passes give out a row's mark or a link of a forest, never all pairs of a tile.
    """
    marks = cut(_by_tile(prints.withColumn("slots", F.sequence(F.lit(0), F.lit(SLOTS - 1))), _marks, ("id", "slot")).distinct())
    wanted = marks.groupBy("id").agg(F.array_sort(F.collect_set(F.col("slot").cast("int"))).alias("slots"))  # SLOTS at most

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, STAGE_WIDTH, True) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "grams"])

    grams = map_rows(of_ids(texts(docs), marks.select("id")), shingles, "id long, grams binary").dropDuplicates(["id"])
    return _by_tile(prints.join(wanted, "id").join(grams, "id"), _similar, ("a", "b"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents without those of which a near copy with a smaller id stays.

    Prints of 256 bits over distinct five-word shingles propose pairs, which are
    held against the shingles themselves.  Equal prints are one class; one row of
    each class stays, that with the least id.  Rows that share an id are rows of
    their own if their texts differ, else one of them stays; rows with a null id stay.
    """
    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("__h"))
    repeats = cut(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    if repeats.isEmpty():
        return without_ids(docs, _copies(docs))
    # every (id, text) gets a number of its own, in order of ids
    keys = named.distinct()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = cut(keys.repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h").select("__h", F.monotonically_increasing_id().alias("__node")))
    once = docs.withColumn("__row", row_key())
    single = once.where("doc_id IS NOT NULL").join(_listed(repeats.select(F.col("doc_id").alias("__id"))), F.col("doc_id") == F.col("__id"), "left_anti")
    several = once.join(_listed(repeats.select(F.col("doc_id").alias("__id"))), F.col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "__row"])
    kept = single.unionByName(several)
    numbered = kept.join(_listed(nodes), F.col("__row") == F.col("__h")).select(F.col("__node").alias("doc_id"), "text")
    copies = cut(_copies(numbered)).join(nodes, F.col("doc_id") == F.col("__node")).select("__h")
    return without_rows(kept.drop("__row"), copies).unionByName(docs.where("doc_id IS NULL"))


def _listed(rows: DataFrame) -> DataFrame:
    """Rows of two longs at most, broadcast if there are few enough."""
    return F.broadcast(rows) if rows.count() <= MOST_IDS // 2 else rows.hint("merge")


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of documents, of ids that do not repeat, of which a near copy with a smaller id stays."""
    own = cut(wide_fingerprints(docs.where("doc_id IS NOT NULL"), STAGE_WIDTH))
    prints = cut(own.groupBy(*PRINT).agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n")))
    component = connected_components(cut(similar_pairs(prints, docs)), cut)
    heads = prints.select("id").join(component, F.col("id") == F.col("node"), "left").where("component IS NULL OR component = id").select(F.col("id").alias("doc_id")).distinct()
    return own.select("doc_id").distinct().join(heads, "doc_id", "left_anti")
