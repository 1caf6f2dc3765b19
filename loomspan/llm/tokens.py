"""Encoding of texts with a public byte-level BPE tokenizer (problem 6).

Texts are split into words by the tokenizer's pattern, and words at the places that no entry of the vocabulary spans, as
nothing is ever merged across them. The pieces a partition has not met yet go, a batch of bytes at a time, into a DuckDB
recursive query: token-position rows join the merge table, and each round contracts, leftmost first, every pair whose
rank is the least within its reach (as many tokens on either side as the longest entry that could stand in the piece has
bytes), until nothing can be merged; an ordered aggregation gives the ids back. A token that came from outside the reach
and still touched the pair would be longer than any entry, so the ids are those of contracting one pair at a time, while
the rounds do not grow with the length of the piece.

The query's rows are keyed by piece and position, so only the last round is kept; stretches where nothing can be merged
any more leave the rounds. One rule holds for all lengths.

Defined results: an empty or null text gives an empty list; strings of special tokens in a text are ordinary text; lone
surrogates cannot stand in a Spark string.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import table

TOKENIZERS = os.environ.get("LOOMSPAN_TOKENIZERS", "/opt/tokenizers")  # folder of the vocabulary files
BYTE_BPE = "byte_bpe_50k.tiktoken"

#: The pattern that splits text before the merges (fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

REACH = 16  # bytes; entries of more count only for pieces that have all their bytes, others for pieces with their classes of bytes
KNOWN_BYTES = 48 * 1024 * 1024  # of words and pieces a worker remembers; it forgets all of them when there are more
QUERY_BYTES = 128 * 1024  # of pieces in one DuckDB query, if it isn't a single longer one
QUERY_MEMORY = "400MB"  # of DuckDB; beyond it, it spills into Spark's local folder
BATCH_BYTES = 8 * 1024 * 1024  # of texts encoded in one go; words of a longer text are taken WORDS_AT_ONCE
WORDS_AT_ONCE = 200_000

CONTRACT = """
WITH RECURSIVE r(piece, pos, step, size, reach, tok) USING KEY (piece, pos) AS (
  SELECT piece, pos, 0, 1, reach, tok FROM start
  UNION
  SELECT piece, pos, step + 1, CASE WHEN takes THEN size + next_size ELSE size END, reach, CASE WHEN taken THEN NULL WHEN takes THEN merged ELSE tok END
  FROM (
    SELECT *, coalesce(lag(takes) OVER v, false) AS taken
    FROM (
      SELECT *, best AND first_value(best) OVER i AND (row_number() OVER i) % 2 = 1 AS takes
      FROM (
        SELECT *, coalesce(rank = near, false) AS best, sum(CASE WHEN rank = before THEN 0 ELSE 1 END) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island
        FROM (
          SELECT p.*, m.rank, m.merged, lag(m.rank) OVER (PARTITION BY p.piece ORDER BY p.pos) AS before,
            min(m.rank) OVER (PARTITION BY p.piece ORDER BY p.pos ROWS BETWEEN p.reach PRECEDING AND p.reach FOLLOWING) AS near
          FROM (SELECT *, CASE WHEN lead(pos) OVER v = pos + size THEN lead(tok) OVER v END AS next, lead(size) OVER v AS next_size
            FROM r WHERE tok IS NOT NULL WINDOW v AS (PARTITION BY piece ORDER BY pos)) p
          LEFT JOIN merges m ON p.tok = m.a AND p.next = m.b)
        WHERE near IS NOT NULL)
      WINDOW i AS (PARTITION BY piece, island ORDER BY pos))
    WINDOW v AS (PARTITION BY piece ORDER BY pos)))
SELECT piece, list(tok ORDER BY pos) AS ids FROM r WHERE tok IS NOT NULL GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left id, right id, merged id) of every merge, the merged id being its rank: each token of several bytes comes from
    the two that remain of it when only merges of lesser rank are made."""
    out = []
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                q, i = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
                if q >= rank:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(parts) == 2:
                out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return out


def _classes(piece: bytes) -> int:
    """Bits for bytes outside ASCII, letters, digits and others."""
    kinds = {0 if b > 127 else 1 if 65 <= b & 0xDF <= 90 else 2 if 48 <= b <= 57 else 3 for b in piece}
    return sum(1 << k for k in kinds)


def _grams(entries: list[bytes], k: int) -> np.ndarray:
    """Codes of all ``k`` successive bytes of the entries."""
    return np.array([int.from_bytes(t[i : i + k]) for t in entries for i in range(len(t) - k + 1)], np.uint32)


def _among(code: np.ndarray, sorted_codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(code), bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, code), len(sorted_codes) - 1)] == code


def _runs(of: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of equal values."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(of)]))


class Encoder:
    """Word encoder of one worker: the merge table in DuckDB, and the words and pieces met so far."""

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        merges = np.array(merge_table(self.ranks), dtype=np.int32).reshape(-1, 3)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pattern = regex.compile(PATTERN)
        self.split, self.words_of = pattern.findall, pattern.finditer
        self.reach = [max((len(t) for t in self.ranks if len(t) <= REACH and not _classes(t) & ~m), default=1) for m in range(16)]
        self.long = sorted({(len(t), frozenset(t)) for t in self.ranks if len(t) > REACH}, key=lambda x: -x[0])
        self.twos, self.threes = (np.unique(_grams([t for t in self.ranks if len(t) == k], k)) for k in (2, 3))
        self.fours = np.unique(_grams([t for t in self.ranks if len(t) >= 4], 4))
        self.db = duckdb.connect()
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.db.execute(f"SET threads = 1; SET memory_limit = '{QUERY_MEMORY}'; SET temp_directory = '{os.path.join(spill, f'duckdb-{os.getpid()}') if spill else ''}'")
        given = pa.table({"a": merges[:, 0], "b": merges[:, 1], "rank": merges[:, 2]})  # noqa: F841  (DuckDB reads it by name)
        self.db.execute("CREATE TABLE merges AS SELECT a, b, rank, rank AS merged FROM given")
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.held = 0

    def _reach(self, piece: bytes) -> int:
        """Bytes of the longest entry that could stand in the piece."""
        if len(piece) > REACH:
            letters = set(piece)
            for size, of in self.long:
                if of <= letters:
                    return size
        return self.reach[_classes(piece)]

    def _contract(self, pieces: list[bytes]) -> list[list[int]]:
        size = np.array([len(w) for w in pieces])
        at = np.repeat(np.arange(len(pieces)), size)
        reach = np.repeat(np.array([self._reach(w) for w in pieces], np.int32), size)
        start = pa.table({"piece": at, "pos": np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size), "reach": reach, "tok": self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]})  # noqa: F841
        return self.db.sql(CONTRACT).to_arrow_table().column("ids").to_pylist()

    def cuts(self, words: list[bytes]) -> list[np.ndarray]:
        """Of each word, the places before which it can be cut as no entry of the vocabulary spans them; 0 is one. An entry
        across a place is the two bytes there, three with one next to them, or holds four successive bytes around it."""
        size = np.array([len(w) for w in words])
        u = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
        n, ends = len(u), np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(n)  # bytes from here to the end of the word
        spanned = np.zeros(n + 4, bool)
        for k, table in ((2, self.twos), (3, self.threes), (4, self.fours)):
            if n >= k:
                code = u[: n - k + 1].copy()
                for i in range(1, k):
                    code = (code << 8) | u[i : n - k + 1 + i]
                hit = np.flatnonzero(_among(code, table) & (left[: n - k + 1] >= k))
                for i in range(1, k):
                    spanned[hit + i] = True
        spanned[ends - size] = False
        place = np.flatnonzero(~spanned[:n])
        return np.split(place - np.repeat(ends - size, size)[place], np.searchsorted(place, ends)[:-1])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if self.held > KNOWN_BYTES:
            self.known, self.pieces, self.held = {}, {}, 0
            new = list(words)
        apart: list[tuple[str, bytes]] = []
        for w in new:
            b = w.encode("utf-8", "replace")
            self.held += 128 + 12 * len(b)
            if b in self.ranks:
                self.known[w] = [self.ranks[b]]
            else:
                apart.append((w, b))
        if not apart:
            return
        parts = [[b[i:j] for i, j in zip(c, [*c[1:], len(b)])] for (_, b), c in zip(apart, (c.tolist() for c in self.cuts([b for _, b in apart])))]
        waiting = []
        for piece in set(chain.from_iterable(parts)):
            if piece not in self.pieces:
                self.held += 128 + 12 * len(piece)
                if piece in self.ranks:
                    self.pieces[piece] = [self.ranks[piece]]
                else:
                    waiting.append(piece)
        waiting.sort(key=len)  # pieces of like length need like numbers of rounds
        sizes = np.cumsum([len(p) for p in waiting]) // QUERY_BYTES
        for start, stop in _runs(sizes):
            self.pieces.update(zip(waiting[start:stop], self._contract(waiting[start:stop])))
        for (w, _), ps in zip(apart, parts):
            self.known[w] = self.pieces[ps[0]] if len(ps) == 1 else list(chain.from_iterable(map(self.pieces.__getitem__, ps)))

    def portions(self, text: str | None) -> Iterator[list[str]]:
        """The words of a text, a bounded number at a time."""
        if text and len(text) > BATCH_BYTES:
            found = (m.group() for m in self.words_of(text))
            while part := list(islice(found, WORDS_AT_ONCE)):
                yield part
        elif text:
            yield self.split(text)

    def encoded(self, texts: list[str | None]) -> Iterator[tuple[int, list[list[int]]]]:
        """(place of the text, ids of its words), long texts in several portions."""
        if sum(map(len, filter(None, texts))) <= BATCH_BYTES:  # all words are learned together
            words = [self.split(t) if t else [] for t in texts]
            self.learn(set(chain.from_iterable(words)))
            for k, ws in enumerate(words):
                yield k, list(map(self.known.__getitem__, ws))
            return
        for k, text in enumerate(texts):
            for ws in self.portions(text):
                self.learn(set(ws))
                yield k, list(map(self.known.__getitem__, ws))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts after each other, offsets of the texts)."""
        flat, sizes = array("i"), [0] * len(texts)
        for k, ids in self.encoded(texts):
            before = len(flat)
            flat.extend(chain.from_iterable(ids))
            sizes[k] += len(flat) - before
        return np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        flat, offsets = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]

    def count(self, texts: list[str | None]) -> list[int]:
        sizes = [0] * len(texts)
        for k, ids in self.encoded(texts):
            sizes[k] += sum(map(len, ids))
        return sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def spread(df: DataFrame) -> DataFrame:
    """At least three partitions for each core: a small file is one partition as it is read."""
    least = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def encode(documents: DataFrame, tokenizers: str = TOKENIZERS, counts_only: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text -> doc_id, ids (or n_tokens), and the columns to carry along."""
    path = os.path.join(tokenizers, BYTE_BPE)
    kept = documents.select("doc_id", *carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for start, stop in _runs(size // BATCH_BYTES):
                part = b.slice(start, stop - start)
                texts = part.column("text").to_pylist()
                if counts_only:
                    got, name = pa.array(enc.count(texts), pa.int64()), "n_tokens"
                else:
                    flat, offsets = enc.encode_flat(texts)
                    got, name = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "ids"
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *carry)], got], names=["doc_id", *carry, name])

    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes) + (", n_tokens bigint" if counts_only else ", ids array<int>")
    return spread(documents.select("doc_id", *carry, "text")).mapInArrow(work, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source: documents, tokens, least and most of a document."""
    d = table(spark, sf_dir, "documents")
    return encode(d, counts_only=True, carry=("source",)).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most"))


QUERIES = {"p6_ids": p6_ids, "p6_counts": p6_counts}
SQL: dict[str, str] = {}
