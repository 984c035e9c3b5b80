"""Byte-level BPE encoding and decoding with DuckDB's recursive queries, one database per task.

A batch of texts is cut at the tokenizer's pattern.  Pieces not met before in
the task become rows (piece, position, token); a recursive query joins
neighbouring rows with the merge table and contracts each piece's leftmost pair
of least rank, until no piece has a pair left.  Decoding turns ids into rows
(document, position, id), joins them with the vocabulary and puts the bytes
together by an ordered aggregation.  The encoder keeps the results of the last
stretches of text it met, in a table of bounded size.

Defined cases: null text counts as empty and has no tokens; special tokens'
strings are ordinary text; a lone surrogate becomes U+FFFD; an unknown id fails.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
from array import array
from collections import ChainMap
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, give_back, map_arrow, table, texts

#: Entries that the tables of known stretches and of known pieces hold before they are emptied.
KNOWN, KNOWN_PIECES = 500_000, 400_000
#: Bytes of the pieces that one recursive query takes (one piece at least), and steps after which it hands on what is not done.
QUERY_BYTES, STEPS = 250_000, 16
#: Ids that one query decodes (one row at least).
QUERY_IDS = 200_000
#: Memory of a task's database; what goes beyond is spilled to the task's own scratch folder.
MEMORY = "100MB"
#: Freed memory beyond which the database gives it back to the system at once.
FLUSH = "128MB"

_LAST = f"""last AS (SELECT piece, max(step) AS step FROM state GROUP BY piece)
SELECT piece, list(tok ORDER BY pos) AS ids, step = {STEPS} AS unfinished FROM state JOIN last USING (piece, step) GROUP BY piece, step ORDER BY piece"""

#: A step contracts each piece's leftmost pair of least rank.  Rows also hold what stands to the right, so that a step takes hash joins only.
_ENCODE = f"""
WITH RECURSIVE state(step, piece, pos, next_pos, tok, next_tok) AS (
  SELECT 0, piece, pos, next_pos, tok, next_tok FROM fresh
  UNION ALL
  (WITH best AS (
     SELECT s.piece, min((m.made::BIGINT << 32) | s.pos) AS pair
     FROM state s JOIN ranked m ON m.pair = (s.tok::BIGINT << 32) | s.next_tok
     WHERE s.next_pos >= 0 AND s.step < {STEPS} GROUP BY s.piece),
   chosen AS (
     SELECT b.piece, l.pos AS at, (b.pair >> 33)::INT AS made, r.pos AS gone, r.next_pos, r.next_tok
     FROM best b
     JOIN state l ON l.piece = b.piece AND l.pos = b.pair & 4294967295
     JOIN state r ON r.piece = b.piece AND r.pos = l.next_pos)
   SELECT s.step + 1, s.piece, s.pos,
          CASE WHEN s.pos = c.at THEN c.next_pos ELSE s.next_pos END,
          CASE WHEN s.pos = c.at THEN c.made ELSE s.tok END,
          CASE WHEN s.pos = c.at THEN c.next_tok WHEN s.next_pos = c.at THEN c.made ELSE s.next_tok END
   FROM state s JOIN chosen c USING (piece)
   WHERE s.pos <> c.gone)
), {_LAST}
"""

#: For pieces that so many steps do not finish.  A step contracts each piece's pairs of least rank, leftmost first.  Where the token made takes part in no merge of lower rank
#: (calm: an even number in ranked), the piece's other pairs of that rank come next whatever the first one gave, so they
#: go in the same step; else only the leftmost does.
_ENCODE_ON = f"""
WITH RECURSIVE state(step, piece, pos, next_pos, tok, next_tok) AS (
  SELECT 0, piece, pos, next_pos, tok, next_tok FROM fresh
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT s.piece, s.pos, s.next_pos, m.made FROM state s JOIN ranked m ON m.pair = (s.tok::BIGINT << 32) | s.next_tok
     WHERE s.next_pos >= 0 AND s.step < {STEPS}),
   low AS (SELECT piece, min((made::BIGINT << 32) | pos) AS pair FROM pairs GROUP BY piece),
   least AS MATERIALIZED (
     SELECT p.piece, p.pos, p.next_pos, p.made, p.pos > w.pair & 4294967295 AS further
     FROM pairs p JOIN low w ON w.piece = p.piece AND p.made = w.pair >> 32
     WHERE p.made % 2 = 0 OR p.pos = w.pair & 4294967295),
   linked AS (
     SELECT piece, pos, lag(next_pos, 1, -1) OVER w <> pos AS begins, row_number() OVER w AS nth
     FROM least WHERE piece IN (SELECT piece FROM least WHERE further) WINDOW w AS (PARTITION BY piece ORDER BY pos)),
   overlapping AS (
     SELECT piece, pos FROM (
       SELECT *, nth - max(CASE WHEN begins THEN nth END) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING) AS in_run FROM linked)
     WHERE in_run % 2 = 1),
   chosen AS MATERIALIZED (SELECT piece, pos, next_pos AS gone, made // 2 AS made FROM least ANTI JOIN overlapping USING (piece, pos)),
   acts AS (
     SELECT c.piece, c.pos, c.made, r.next_pos, r.next_tok FROM chosen c JOIN state r ON r.piece = c.piece AND r.pos = c.gone
     UNION ALL SELECT piece, gone, -1, 0, 0 FROM chosen),
   merged AS (
     SELECT s.step + 1 AS step, s.piece, s.pos, CASE WHEN c.made IS NULL THEN s.next_pos ELSE c.next_pos END AS next_pos,
            coalesce(c.made, s.tok) AS tok, CASE WHEN c.made IS NULL THEN s.next_tok ELSE c.next_tok END AS next_tok
     FROM state s SEMI JOIN low w ON w.piece = s.piece LEFT JOIN acts c ON c.piece = s.piece AND c.pos = s.pos
     WHERE c.made IS NULL OR c.made >= 0)
   SELECT m.step, m.piece, m.pos, m.next_pos, m.tok, coalesce(n.made, m.next_tok)
   FROM merged m LEFT JOIN chosen n ON n.piece = m.piece AND n.pos = m.next_pos)
), {_LAST}
"""

_DECODE = """
SELECT doc, array_to_string(list(v.bytes_hex ORDER BY pos), '') AS bytes_hex
FROM fresh f JOIN vocabulary v USING (id) GROUP BY doc ORDER BY doc
"""


class Codec:
    """Encoder and decoder for one rank file, with a database of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        # where another pattern cuts is not known, so that its texts are looked up whole
        self.units = units if pattern == default_pattern() else lambda text: [text] if text else []
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(ranks[t[:s]], ranks[t[s:]], r) for t, r in ranks.items() for s in range(1, len(t)) if t[:s] in ranks and t[s:] in ranks]
        lowest: dict[int, int] = {}  # the lowest rank that a token takes part in making
        for left, right, made in rows:
            lowest[left] = min(lowest.get(left, made), made)
            lowest[right] = min(lowest.get(right, made), made)
        left, right, made = zip(*rows, strict=True)
        ranked = [2 * m + (lowest.get(m, m) < m) for m in made]
        self.tables = {
            "ranked": pa.table({"pair": pa.array([(a << 32) | b for a, b in zip(left, right, strict=True)], pa.int64()), "made": pa.array(ranked, pa.int32())}),
            "vocabulary": pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes_hex": [b.hex() for b in ranks]}),
        }
        self.whole = {t: array("i", [r]).tobytes() for t, r in ranks.items()}
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]
        self.known: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    @cached_property
    def db(self):
        """The task's database; what it spills goes to the task's own scratch folder."""
        import duckdb

        self.scratch = tempfile.TemporaryDirectory(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        opened = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.scratch.name, "allocator_flush_threshold": FLUSH, "allocator_bulk_deallocation_flush_threshold": FLUSH})
        for name, rows in self.tables.items():
            opened.register("loaded", rows)
            opened.execute(f"CREATE TABLE {name} AS FROM loaded")
            opened.unregister("loaded")
        return opened

    def release(self) -> None:
        """Close the task's database; the tables of what is known stay for the worker's next task, bounded as they are."""
        if "db" in self.__dict__:
            self.db.close()
            del self.__dict__["db"]
            self.scratch.cleanup()

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """The recursive query over distinct pieces that are no tokens themselves; ids as bytes of int32."""
        out = [b""] * len(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        start = 0
        while start < len(pieces):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + QUERY_BYTES, side="right")))
            todo = {i: self.single[np.frombuffer(pieces[i], np.uint8)] for i in range(start, stop)}
            todo = self._contract(_ENCODE, todo, out)
            while todo:
                todo = self._contract(_ENCODE_ON, todo, out)
            start = stop
        return out

    def _contract(self, query: str, todo: dict[int, np.ndarray], out: list[bytes]) -> dict[int, np.ndarray]:
        """One recursive query over pieces given as tokens: what is done goes to out, the rest comes back."""
        sizes = np.array([len(t) for t in todo.values()])
        tok = np.concatenate(list(todo.values()))
        pos = (np.arange(len(tok)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        ends = np.cumsum(sizes) - 1
        next_pos, next_tok = pos + np.int32(1), np.append(tok[1:], 0).astype(np.int32)
        next_pos[ends], next_tok[ends] = -1, 0
        fresh = pa.table({"piece": np.repeat(np.array(list(todo), np.int32), sizes), "pos": pos, "next_pos": next_pos, "tok": tok, "next_tok": next_tok})
        self.db.register("fresh", fresh)
        found = self.db.sql(query).to_arrow_table().combine_chunks()
        self.db.unregister("fresh")
        ids = found.column("ids").combine_chunks()
        at, values = np.asarray(ids.offsets, np.int64).tolist(), np.asarray(ids.values, np.int32)
        rest = {}
        for i, x, y, unfinished in zip(found.column("piece").to_pylist(), at[:-1], at[1:], found.column("unfinished").to_pylist(), strict=True):
            if unfinished:
                rest[i] = values[x:y]
            else:
                out[i] = values[x:y].tobytes()
        return rest

    def _learn(self, units: list[str]) -> None:
        """Fill the table of known units; a unit is a stretch of text that the pattern cuts alike wherever it stands."""
        cut = [[p.encode("utf-8", "replace") for p in self.pattern.findall(u)] for u in units]
        fresh = {p for ps in cut for p in ps if p not in self.whole and p not in self.pieces}
        if len(self.pieces) + len(fresh) > KNOWN_PIECES:
            self.pieces.clear()
            fresh = {p for ps in cut for p in ps if p not in self.whole}
        if fresh:
            self.pieces.update(zip(fresh, self._merge(list(fresh)), strict=True))
        whole, pieces_ = self.whole, self.pieces
        for unit, pieces in zip(units, cut, strict=True):
            self.known[unit] = b"".join([whole[p] if p in whole else pieces_[p] for p in pieces])

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of int32."""
        # texts are cut twice rather than all their stretches held at once
        known = self.known
        fresh = {u for t in texts_ for u in self.units(t) if u not in known}
        if len(known) + len(fresh) > KNOWN:
            known.clear()
            fresh = {u for t in texts_ for u in self.units(t)}
        if fresh:
            self._learn(list(fresh))
        return [b"".join(map(known.__getitem__, self.units(t))) for t in texts_]

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        out: list[bytes] = []
        while len(out) < len(rows):
            start = len(out)
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + QUERY_IDS, side="right")))
            out += self._decode(rows[start:stop])
        return out

    def _decode(self, rows: list[np.ndarray]) -> list[bytes]:
        sizes = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.decimal)):
            raise ValueError("an id is not in the vocabulary")
        pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fresh = pa.table({"doc": np.repeat(np.arange(len(rows), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "id": ids.astype(np.int32)})
        self.db.register("fresh", fresh)
        done = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("fresh")
        out = [b""] * len(rows)
        for doc, text in zip(done.column("doc").to_pylist(), done.column("bytes_hex").to_pylist(), strict=True):
            out[doc] = bytes.fromhex(text)
        return out


_ODD_SPACE = re.compile(r" \s|\s ")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def units(text: str) -> list[str]:
    """Stretches of text between which every match of the pattern ends: before a single space within visible text."""
    if not text:
        return []
    if _ODD_SPACE.search(text) is None:
        words = text.split(" ")
        return [words[0]] * (words[0] != "") + [" " + w for w in words[1:]]
    return _SAFE_CUT.split(text)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process: rank files name a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(batch: pa.RecordBatch, coder: Codec) -> pa.RecordBatch:
    raw = coder.encode(batch.column("text").to_pylist())
    sizes = np.array([0, *(len(r) // 4 for r in raw)], np.int64)
    ids = pa.LargeListArray.from_arrays(np.cumsum(sizes), pa.array(np.frombuffer(b"".join(raw), np.int32))).cast(pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])


def decoded(batch: pa.RecordBatch, coder: Codec) -> pa.RecordBatch:
    ids = batch.column("ids")
    rows = [np.asarray(x.values, np.int32) if x.is_valid else np.zeros(0, np.int32) for x in ids]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(coder.decode(rows), pa.binary())], ["doc_id", "ids", "decoded"])


def _coded(function: Callable[[pa.RecordBatch, Codec], pa.RecordBatch], path: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: function(batch, codec) of each bounded batch."""

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        try:
            for batch in batches(iterator, 4 << 20):
                yield function(batch, coder)
                give_back()
        finally:
            coder.release()

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row."""
    return map_arrow(texts(docs, id_col, text_col), _coded(encoded, path or vocabulary_path(), pattern or default_pattern()), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (binary) of rows (doc_id, ids); null ids decode to nothing."""
    return map_arrow(tokens.select("doc_id", "ids"), _coded(decoded, path or vocabulary_path(), pattern or default_pattern()), "doc_id long, ids array<int>, decoded binary")


def _digests(batch: pa.RecordBatch, coder: Codec) -> pa.RecordBatch:
    rows = [np.asarray(x.values, np.int32) for x in batch.column("ids")]
    ids_sha = [hashlib.sha256(" ".join(map(coder.decimal.__getitem__, r.tolist())).encode()).hexdigest() for r in rows]
    text_sha = [hashlib.sha256(b).hexdigest() for b in batch.column("decoded").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _digested(batch: pa.RecordBatch, coder: Codec) -> pa.RecordBatch:
    return _digests(decoded(encoded(batch, coder), coder), coder)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode and digest in one pass, batch by batch; ids do not leave the task."""
    run = _coded(_digested, vocabulary_path(), default_pattern())
    return map_arrow(texts(table(spark, sf_dir, "documents")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _tokenised(batch: pa.RecordBatch, coder: Codec) -> pa.RecordBatch:
    ids = encoded(batch, coder)
    told = _digests(decoded(ids, coder), coder)
    return pa.RecordBatch.from_arrays([*told.columns[:2], ids.column("ids"), *told.columns[2:]], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def tokenised_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every row: the pipeline's last form of a document."""
    run = _coded(_tokenised, path or vocabulary_path(), pattern or default_pattern())
    return map_arrow(texts(docs), run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
