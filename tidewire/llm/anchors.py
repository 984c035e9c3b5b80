"""Where equal windows of two documents meet: minimizer segments.

A document is a row of symbols (bytes or words).  Each window of ``window``
symbols has an anchor: the gram of least hash in it.  Neighbouring windows with
one anchor make a segment.  Equal windows have equal anchors, so a window can
only repeat where its segment's anchor repeats.

1. Every document tells its segments: hash of the anchor, hash of the segment's
   symbols, where it is.  Equal segments need no further look: all but the first
   repeat it.
2. Where one anchor has segments of different symbols, the first of each is
   fetched from its document.
3. Fetched segments of an anchor come together in a shard, whose index finds the
   windows that they share.

Two rules keep every group small, whatever repeats: of equal segments in a batch
the first goes on and the rest are settled; segments of an anchor that has
``hot`` different ones or more (more than a shard holds) are cut into single
windows, which meet by their own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, id_key, map_arrow

#: Symbols of a document taken at a time; a stretch overlaps the next by a window.
STRETCH = 1 << 22
_POSITION = np.uint64((1 << 23) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of uint64 numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Unit:
    """What a document consists of: how to read symbols, hash grams and pack a stretch of symbols."""

    window: int
    gram: int
    #: text -> symbols (an array) and what pack needs
    read: Callable[[str], tuple[np.ndarray, object]]
    #: symbols -> hashes of all grams
    grams: Callable[[np.ndarray], np.ndarray]
    #: symbols -> a mixed uint64 of each
    mix: Callable[[np.ndarray], np.ndarray]
    #: (what pack needs, from, to) -> bytes of those symbols
    pack: Callable[[object, int, int], bytes]
    #: symbols in packed bytes
    count: Callable[[bytes], int]
    #: whether a repeat within one document counts
    within: bool
    #: different segments of an anchor from which on they are cut into windows
    hot: int = 8192


def segments(hashes: np.ndarray, n: int, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(40 bits of the anchor's hash, first window, end of windows) of each segment of a document of n symbols."""
    if n < unit.window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    span = unit.window - unit.gram + 1
    found = []
    for start in range(0, n - unit.window + 1, STRETCH):
        part = hashes[start : start + STRETCH + span - 1]
        least = (part & ~_POSITION) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: -(span - size)], least[span - size :])
        at = (least & _POSITION).astype(np.int64)
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        first = np.concatenate([[0], cuts])
        found.append((part[at[first]] >> np.uint64(24), first + start, np.append(cuts, len(at)) + start))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""

    factor, inverse = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 15)
            self.up = np.cumprod(np.append(np.uint64(1), np.full(size, self.factor)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(size, self.inverse)), dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def stretch_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """48 bits for each stretch of symbols, given a mixed uint64 of each symbol; with the anchor they make 88."""
    up, down = _powers.get(len(values))
    total = np.append(np.uint64(0), np.cumsum(values * up[: len(values)], dtype=np.uint64))
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)) >> np.uint64(16)


def _low(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, so many of each."""
    return np.ascontiguousarray(np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _of_low(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view(np.uint64).reshape(-1)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by the places of their bytes, as many as the largest has."""
    x = np.ascontiguousarray(x).view(np.uint64)
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _of_planes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if raw:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view(np.int64).reshape(-1)


@dataclass
class _Places:
    """Segments: anchor, symbols' hash, document, mark, first window, number of windows."""

    h: np.ndarray
    c: np.ndarray
    doc: np.ndarray
    mark: np.ndarray
    start: np.ndarray
    n: np.ndarray

    def take(self, at: np.ndarray) -> _Places:
        return _Places(*(getattr(self, f)[at] for f in ("h", "c", "doc", "mark", "start", "n")))

    def settle(self, within: bool) -> tuple[_Places, _Places]:
        """(those that stay, those that repeat a segment before them) in the order of anchor and symbols."""
        order = np.lexsort((self.start, self.doc, self.c, self.h))
        own = self.take(order)
        first = np.append(True, (own.h[1:] != own.h[:-1]) | (own.c[1:] != own.c[:-1]))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        stays = own.doc == own.doc[lead]
        if within:
            stays &= own.start == own.start[lead]
        return own.take(np.flatnonzero(stays)), own.take(np.flatnonzero(~stays))


_PLACES = "kind int, bucket int, h binary, c binary, doc binary, mark binary, start binary, n binary"


def _place_row(kind: int, bucket: int, p: _Places) -> tuple:
    """Places in the order of document and start, packed: documents by their differences."""
    doc = np.append(p.doc[:1], np.diff(p.doc))
    h, c = (_low(p.h >> np.uint64(8), 4), _low(p.c, 6)) if kind == 0 else (None, None)
    return kind, bucket, h, c, doc[:1].tobytes() + _planes(doc[1:]), p.mark.tobytes() if p.mark.any() else None, _planes(p.start), p.n.astype(np.uint8).tobytes()


def _places_of(row: tuple) -> _Places:
    _, bucket, h, c, doc, mark, start, n = row  # the bucket has the low bits of the anchor, 8 at least
    count = len(n)
    none = np.zeros(count, np.uint64)
    docs = np.cumsum(np.append(np.frombuffer(doc[:8], np.int64), _of_planes(doc[8:], count - 1)))
    return _Places((_of_low(h, 4) << np.uint64(8)) | np.uint64(bucket & 255) if h else none, _of_low(c, 6) if c else none, docs, np.frombuffer(mark, np.int64) if mark else np.zeros(count, np.int64), _of_planes(start, count), np.frombuffer(n, np.uint8).astype(np.int64))


def segment_places(docs: DataFrame, unit: Unit, bits: int) -> DataFrame:
    """Segments by the low ``bits`` of their anchor, packed, a row a batch and bucket.

    Kind 0: those that stay when a batch is settled.  Kind 1: those that repeat one of the batch; any bucket will do.
    """

    def scan(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches(iterator)):
            parts = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text")), strict=True):
                symbols, _ = unit.read(text)
                h, a, b = segments(unit.grams(symbols), len(symbols), unit)
                if len(h):
                    parts.append((h, stretch_hashes(unit.mix(symbols), a, b + unit.window - 1), np.full(len(h), doc, np.int64), np.full(len(h), mark, np.int64), a.astype(np.int64), (b - a).astype(np.int64)))
            if not parts:
                continue
            stay, repeat = _Places(*(np.concatenate(c) for c in zip(*parts, strict=True))).settle(unit.within)
            bucket = (stay.h & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.lexsort((stay.start, stay.doc, bucket))
            bucket = bucket[order]
            cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist(), len(bucket)]
            repeat = repeat.take(np.lexsort((repeat.start, repeat.doc)))
            rows = [_place_row(0, int(bucket[x]), stay.take(order[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(repeat.doc):
                rows.append(_place_row(1, hash((int(repeat.h[0]), number)) & ((1 << bits) - 1), repeat))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 6), strict=True)], [f.split()[0] for f in _PLACES.split(", ")])

    return map_arrow(docs.select("doc", "mark", "text"), scan, _PLACES)


#: A segment to fetch.
_ASK = np.dtype([("start", "<u4"), ("n", "u1"), ("hot", "u1"), ("h", "<i8")])


class _Told:
    """Arrays by (document, mark), given out as rows of packed bytes."""

    def __init__(self) -> None:
        self.spans: list[np.ndarray] = []
        self.asks: list[np.ndarray] = []
        self.size = 0

    def add(self, p: _Places, window: int) -> None:
        self.spans.append(np.stack([p.doc, p.mark, p.start, p.start + p.n + window - 1], 1))
        self.size += len(p.doc)

    def ask(self, p: _Places, hot: np.ndarray) -> None:
        self.asks.append(np.stack([p.doc, p.mark, p.start, p.n, p.h.view(np.int64), hot.astype(np.int64)], 1))
        self.size += len(p.doc)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for what, parts in (("spans", self.spans), ("asks", self.asks)):
            if not parts:
                continue
            data = np.concatenate(parts)
            data = data[np.lexsort((data[:, 2], data[:, 1], data[:, 0]))]
            cuts = [*np.flatnonzero(np.append(True, (data[1:, :2] != data[:-1, :2]).any(1))).tolist(), len(data)]
            if what == "asks":
                rest = np.empty(len(data), _ASK)
                rest["start"], rest["n"], rest["h"], rest["hot"] = data[:, 2], data[:, 3], data[:, 4], data[:, 5]
            else:
                rest = np.ascontiguousarray(data[:, 2:].astype(np.uint32))  # a text is under 2 GB
            packed = [rest[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            none = [None] * len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(data[cuts[:-1], 0]), pa.array(data[cuts[:-1], 1]), pa.array(packed if what == "spans" else none, pa.binary()), pa.array(packed if what == "asks" else none, pa.binary())], ["doc", "mark", "spans", "asks"])
        self.spans, self.asks, self.size = [], [], 0


def settled_places(rows: DataFrame, unit: Unit) -> DataFrame:
    """(doc, mark, spans, asks): packed stretches that repeat a segment before them, or packed segments to fetch.

    A task takes bucket after bucket and holds one.
    """

    def scan(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, number, held = _Told(), None, []

        def settle() -> None:
            if not held:
                return
            all_ = _Places(*(np.concatenate([getattr(p, f) for p in held]) for f in ("h", "c", "doc", "mark", "start", "n")))
            stay, repeat = all_.settle(unit.within)
            if len(repeat.doc):
                told.add(repeat, unit.window)
            new_h = np.append(True, stay.h[1:] != stay.h[:-1])
            new_c = new_h | np.append(True, stay.c[1:] != stay.c[:-1])
            first = np.flatnonzero(new_h)
            several = np.repeat(np.add.reduceat(new_c.astype(np.int64), first), np.diff(np.append(first, len(new_h))))
            at = np.flatnonzero(several > 1)
            if len(at):
                told.ask(stay.take(at), several[at] >= unit.hot)

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] == 1:
                    told.add(_places_of(row), unit.window)
                else:
                    if row[1] != number:
                        settle()
                        number, held = row[1], []
                    held.append(_places_of(row))
                if told.size > 1_000_000:
                    yield from told.rows()
        settle()
        yield from told.rows()

    return map_arrow(rows.repartition("bucket").sortWithinPartitions("kind", "bucket"), scan, "doc long, mark long, spans binary, asks binary")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) of every row: doc is never null."""
    return docs.select(id_key(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def segment_rows(asked: DataFrame, unit: Unit) -> DataFrame:
    """Rows (key, content, doc, mark, starts) of the segments asked for; or content null, and stretches already known to repeat.

    asked: doc, mark, text, spans and asks (arrays of packed bytes).  starts: where the content begins in doc.  Of
    equal windows of hot anchors in a batch the first goes on.
    """

    def scan(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(iterator, 32 << 20):
            found: dict[bytes, tuple[int, list[tuple[int, int, int]]]] = {}
            known: dict[tuple[int, int], list[tuple[int, int]]] = {}
            keys, contents, docs, marks, starts = [], [], [], [], []
            for doc, mark, text, spans, asks in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "spans", "asks")), strict=True):
                if spans:
                    known.setdefault((doc, mark), []).extend(map(tuple, np.frombuffer(b"".join(spans), np.uint32).reshape(-1, 2).tolist()))
                if not asks:
                    continue
                _, source = unit.read(text)
                for a, n, hot, h in np.frombuffer(b"".join(asks), _ASK).tolist():
                    if hot:
                        for w in range(a, a + n):
                            content = unit.pack(source, w, w + unit.window)
                            found.setdefault(content, (hash_bytes(content), []))[1].append((doc, w, mark))
                    else:
                        keys.append(h)
                        contents.append(unit.pack(source, a, a + n + unit.window - 1))
                        docs.append(doc)
                        marks.append(mark)
                        starts.append(np.array([a], np.int64).tobytes())
            for content, (key, places) in found.items():
                places.sort()
                lead = places[0]
                stay = [p for p in places if p[:2] == lead[:2]] if unit.within else [p for p in places if p[0] == lead[0]]
                for mark in sorted({p[2] for p in stay}):
                    keys.append(key)
                    contents.append(content)
                    docs.append(lead[0])
                    marks.append(mark)
                    starts.append(np.array([p[1] for p in stay if p[2] == mark], np.int64).tobytes())
                for doc, at, mark in places[len(stay) :]:
                    known.setdefault((doc, mark), []).append((at, at + unit.window))
            for (doc, mark), spans in known.items():
                keys.append(doc)
                contents.append(None)
                docs.append(doc)
                marks.append(mark)
                starts.append(np.array(spans, np.int64).tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.binary()), pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.binary())], ["key", "content", "doc", "mark", "starts"])

    return map_arrow(asked, scan, "key long, content binary, doc long, mark long, starts binary")


def hash_bytes(content: bytes) -> int:
    value = xxhash.xxh64_intdigest(content, 42)
    return value - (1 << 64) if value >= 1 << 63 else value


#: index(symbols, valid, ranks, window) -> for each valid window start, the least rank of an equal window.
Index = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


class _Shard:
    """Whole groups of segments, up to a number of symbols, and what they repeat."""

    def __init__(self, unit: Unit, symbols_of: Callable[[list[bytes]], list[np.ndarray]], index: Index) -> None:
        self.unit, self.symbols_of, self.index = unit, symbols_of, index
        self.size, self.spans, self.contents, self.leads = 0, {}, [], []

    def tell(self, doc: int, mark: int, spans: np.ndarray) -> None:
        if len(spans):
            self.spans.setdefault((doc, mark), []).append(spans)

    def add(self, rows: list[tuple[bytes | None, int, int, bytes]]) -> None:
        """One group: rows (content, doc, mark, starts)."""
        by: dict[bytes, list[tuple[int, int, np.ndarray]]] = {}
        for content, doc, mark, starts in rows:
            numbers = np.frombuffer(starts, np.int64)
            if content is None:
                self.tell(doc, mark, numbers.reshape(-1, 2))
            else:
                by.setdefault(content, []).append((doc, mark, numbers))
        several = len(by) > 1
        for content, places in by.items():
            length = self.unit.count(content)
            if len(places) == 1 and len(places[0][2]) == 1:  # nothing in its group equals it
                if several:
                    doc, mark, starts = places[0]
                    at = int(starts[0])
                    self.contents.append(content)
                    self.leads.append((doc, at, [(mark, at)]))
                    self.size += length
                continue
            lead, at = min((doc, int(starts.min())) for doc, _, starts in places)
            stay = []
            for doc, mark, starts in places:
                if self.unit.within:
                    first = (doc == lead) & (starts == at)
                else:
                    first = np.full(len(starts), doc == lead)
                stay += [(mark, x) for x in starts[first].tolist()]
                later = starts[~first]
                self.tell(doc, mark, np.stack([later, later + length], 1))
            # equal windows of one segment have one place, so a group of one content has no more to find
            if several:
                self.contents.append(content)
                self.leads.append((lead, at, stay))
                self.size += length

    def settle(self) -> pa.RecordBatch | None:
        window = self.unit.window
        if self.contents:
            texts = self.symbols_of(self.contents)
            sizes = np.array([len(t) for t in texts])
            begin = np.cumsum(sizes + 1) - sizes - 1
            leads, ats = (np.array([x[c] for x in self.leads], np.int64) for c in (0, 1))
            # a 0 after each text separates
            owner = np.repeat(np.arange(len(texts)), sizes + 1)
            inner = np.arange(len(owner)) - begin[owner]
            inside = inner < sizes[owner]
            joined = np.zeros(len(owner), np.int64)
            joined[inside] = np.concatenate(texts)
            joined[inside] += 1
            valid = inner <= (sizes - window)[owner]
            if self.unit.within:
                d, p = np.where(inside, leads[owner], -1), np.where(inside, inner + ats[owner], 0)
                order = np.lexsort((p, d))
                d, p = d[order], p[order]
                ranks = np.empty(len(joined), np.int64)
                ranks[order] = np.cumsum(np.append(0, (d[1:] != d[:-1]) | (p[1:] != p[:-1])))
            else:
                ranks = np.unique(leads, return_inverse=True)[1][owner]
            hits = np.flatnonzero((self.index(joined, valid, ranks, window) < ranks) & valid)
            if len(hits):
                # stretches covered by windows of one text
                apart = (owner[hits[1:]] != owner[hits[:-1]]) | (hits[1:] > hits[:-1] + window)
                first = np.flatnonzero(np.append(True, apart))
                of = owner[hits[first]]
                spans = np.stack([hits[first], hits[np.append(first[1:] - 1, len(hits) - 1)] + window], 1) - begin[of][:, None]
                cuts = [*np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist(), len(of)]
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    lead, _, stay = self.leads[of[x]]
                    for mark, at in stay:
                        self.tell(lead, mark, spans[x:y] + at)
        if not self.spans:
            return None
        docs, marks = zip(*self.spans, strict=True)
        packed = [np.concatenate(s).astype(np.int64).tobytes() for s in self.spans.values()]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())], ["doc", "mark", "spans"])


def repeated_spans(rows: DataFrame, unit: Unit, symbols_of: Callable[[list[bytes]], list[np.ndarray]], index: Index, shard_symbols: int) -> DataFrame:
    """(doc, mark, spans) from segment_rows: stretches of each document that repeat an earlier one.

    A task takes groups in the order of their keys into shards of about shard_symbols symbols, each indexed by itself.
    """

    def scan(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(unit, symbols_of, index)
        key, group = None, []
        for batch in batches(iterator, 8 << 20):
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "doc", "mark", "starts")), strict=True):
                if k != key:
                    shard.add(group)
                    key, group = k, []
                    if shard.size >= shard_symbols or len(shard.spans) > 20_000:
                        out = shard.settle()
                        if out is not None:
                            yield out
                        shard = _Shard(unit, symbols_of, index)
                group.append(tuple(row))
        shard.add(group)
        out = shard.settle()
        if out is not None:
            yield out

    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), scan, "doc long, mark long, spans binary")


def with_repeats(docs: DataFrame, unit: Unit, symbols_of: Callable[[list[bytes]], list[np.ndarray]], index: Index, shard_symbols: int) -> DataFrame:
    """doc, text, spans (array of packed stretches that repeat earlier ones) for every row of keyed(docs)."""
    sizes = docs.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("held")).agg(F.max("n"), F.sum("held")).first()
    # a bucket of about a million segments of 16 bytes, and 4096 buckets at least
    bits = min(18, max(12, (int(sizes[1] or 0) >> 24).bit_length()))
    # rows may repeat an id with different texts: what is found in one is then told for the id and a hash of its text
    mark = F.xxhash64("text") if (sizes[0] or 0) > 1 else F.lit(0).cast("long")
    own = docs.withColumn("mark", mark)
    dealt = docs.repartition("doc").withColumn("mark", mark)  # one shuffle of the texts for both joins
    by_doc = settled_places(segment_places(own, unit, bits), unit).groupBy("doc").agg(F.collect_list(F.struct("mark", "spans", "asks")).alias("told"))
    of_mark = F.filter("told", lambda t: t["mark"] == F.col("mark"))
    part = lambda name: F.array_compact(F.transform(of_mark, lambda t: t[name])).alias(name)
    asked = dealt.join(by_doc, "doc").select("doc", "mark", "text", part("spans"), part("asks"))
    found = repeated_spans(segment_rows(asked, unit), unit, symbols_of, index, shard_symbols)
    told = found.groupBy("doc").agg(F.collect_list(F.struct("mark", "spans")).alias("told"))
    spans = F.transform(of_mark, lambda t: t["spans"]).alias("spans")
    return dealt.join(told, "doc", "left").select("doc", "text", spans)


def merged(spans: list[bytes] | None) -> np.ndarray:
    """Maximal stretches (from, to) out of packed ones, sorted."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    all_ = np.concatenate([np.frombuffer(s, np.int64) for s in spans]).reshape(-1, 2)
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    reach = np.maximum.accumulate(all_[:, 1])
    first = np.flatnonzero(np.append(True, all_[1:, 0] > reach[:-1]))
    last = np.append(first[1:] - 1, len(all_) - 1)
    return np.stack([all_[first, 0], reach[last]], 1)
