"""Byte-level BPE encoding and decoding over whole texts.

Encoding cuts a text into pre-tokens by the public pattern, and encodes every *distinct* pre-token of a block once.
Distinct pre-tokens go into zero-padded matrices by length bucket; each round looks up the rank of every adjacent pair
in a hash table, merges the leftmost pair of minimum rank in every row at once, and compacts the rows; rows without a
mergeable pair leave the matrix.  That is the order of merges of the reference encoders.  A pre-token over `MATRIX_WIDTH`
bytes would need one round per byte, so those few take the same merges through a heap in O(n log n).

Texts are cut first at single spaces between two non-space characters.  No pre-token crosses such a place, so a chunk
with its leading space can be tokenised alone, and chunks repeat.

Null text counts as empty: zero ids, empty bytes.  Ids and decoded bytes are real columns; nothing is truncated, however
long a text is.  Rows that repeat are rows of their own, with equal results; a null id stays null.  Other columns, whatever
their names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillmark.llm.common import blocks, id_text, worker_state

MATRIX_WIDTH = 256
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 64, 128, MATRIX_WIDTH)
#: Bytes of the chunk cache of one worker, and of its pre-token cache; beyond it they start afresh.  They only save work.
CACHE_BYTES = 24 << 20
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 150
#: Text bytes that are encoded at once, and cells of a matrix.
BLOCK, CELLS = 1 << 20, 1 << 18
#: Unicode White_Space, which the reference encoders take for \s; Python's \s has four control characters more.
SPACE = r"\t-\r \x85\xa0  -     　"
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def strict_spaces(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out, inside character classes as well as outside."""
    return re.sub(r"\[\^\\s", lambda _: f"[^{SPACE}", pattern).replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id), probed for whole arrays at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        self.shift, self.mask = np.uint64(64 - int(np.log2(size))), size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            slots = at[todo]
            free = todo[self.keys[slots] == -1]
            self.keys[at[free]] = keys[free]  # of several for one slot, the last stays
            won = self.keys[slots] == keys[todo]
            self.values[slots[won]] = merged[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, which is its rank as well; NONE for pairs that don't merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


class ByteBPE:
    """Ranks are ids: a pair merges if its bytes joined are a token, at the rank of that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces_of = regex.compile(strict_spaces(pattern)).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right, merged)))
        self.top = max(ranks.values()) + 1
        words: list[bytes] = [b""] * self.top
        for token, rank in ranks.items():
            words[rank] = token
        self.vocabulary = pa.array(words, pa.large_binary())
        self._chunks: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunk_bytes = self._piece_bytes = 0

    def encode_distinct(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif len(piece) > MATRIX_WIDTH:
                out[k] = self._by_heap(piece)
            elif piece:
                by_length.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(k)
        for width, members in by_length.items():
            step = max(1, CELLS // width)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for k, ids in zip(part, self._by_matrix([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.array([len(p) for p in pieces])
        ids = self.byte_ids[raw]
        columns = np.arange(width)
        pad = columns >= length[:, None]
        ids[pad] = -1
        done_ids, done_length = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows):
            best = rank.argmin(axis=1)  # the first of equal ranks: the leftmost
            here = np.arange(len(rows))
            merged = rank[here, best]
            ended = merged == NONE
            if ended.any():
                gone = rows[ended]
                done_ids[gone, : ids.shape[1]] = ids[ended]
                done_length[gone] = length[ended]
                keep = ~ended
                rows, ids, length, rank, best, merged = rows[keep], ids[keep], length[keep], rank[keep], best[keep], merged[keep]
                if not len(rows):
                    break
                here = np.arange(len(rows))
            # Compaction: the merged id takes the left place, what stands right of the pair moves one to the left.
            w = ids.shape[1]
            ids[here, best] = merged
            move = np.arange(w - 1) > best[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            length -= 1
            if w > 2:
                rank[:, :-1] = np.where(move[:, : w - 2], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[here, best] = self._rank_at(ids, here, best, length)
            behind = best > 0
            rank[here[behind], best[behind] - 1] = self._rank_at(ids, here[behind], best[behind] - 1, length[behind])
            most = max(2, int(length.max()))
            if most < w:
                ids, rank = np.ascontiguousarray(ids[:, :most]), np.ascontiguousarray(rank[:, : most - 1])
        flat = done_ids.astype("<u4")
        return [flat[k, : done_length[k]].tobytes() for k in range(n)]

    def _rank_at(self, ids: np.ndarray, row: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        there = at + 1 < length
        out = np.full(len(row), NONE, np.int32)
        r, c = row[there], at[there]
        out[there] = self.pairs.find(ids[r, c], ids[r, c + 1])
        return out

    def _by_heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece: minimum rank first, then leftmost."""
        n, get = len(piece), self.ranks.get
        start_of_next, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)

        def offer(at: int) -> None:
            second = start_of_next[at]
            if second < n:
                rank = get(piece[at : start_of_next[second]])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, start_of_next[second]))

        heap: list[tuple[int, int, int]] = []
        for k in range(n - 1):
            offer(k)
        while heap:
            _, at, end = heapq.heappop(heap)
            second = start_of_next[at] if alive[at] else n
            if second >= n or start_of_next[second] != end:
                continue  # one of the two was merged meanwhile
            alive[second] = 0
            start_of_next[at] = end
            if end < n:
                previous[end] = at
            offer(at)
            if previous[at] >= 0:
                offer(previous[at])
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : start_of_next[at]]])
            at = start_of_next[at]
        return np.array(out, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Fills the chunk cache for chunks that aren't in it."""
        if self._chunk_bytes > CACHE_BYTES:
            self._chunks.clear()
            self._chunk_bytes = 0
        if self._piece_bytes > CACHE_BYTES:
            self._pieces.clear()
            self._piece_bytes = 0
        fresh = [c for c in chunks if c not in self._chunks]
        cut = [[c] if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else self.pieces_of(c) for c in fresh]
        unseen = list({p for pieces in cut for p in pieces if p not in self._pieces})
        found = self.encode_distinct([p.encode() for p in unseen])
        self._pieces.update(zip(unseen, found, strict=True))
        self._piece_bytes += sum(map(len, unseen)) + sum(map(len, found)) + ENTRY_BYTES * len(unseen)
        known = self._pieces
        for chunk, pieces in zip(fresh, cut, strict=True):
            ids = self._chunks[chunk] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])
            self._chunk_bytes += len(chunk) + len(ids) + ENTRY_BYTES

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [split_chunks(t) if t else [] for t in texts]
        self._learn({c for chunks in cut for c in chunks})
        get = self._chunks.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of an id sequence; an id outside the vocabulary is an error."""
        if not len(ids):
            return b""
        taken = self.vocabulary.take(pa.array(ids.astype(np.int64)))
        _, offsets, data = taken.buffers()
        first, last = np.frombuffer(offsets, np.int64)[[taken.offset, taken.offset + len(taken)]]
        return data.to_pybytes()[first:last] if data is not None else b""


_between = re.compile(r"(?<=\S) (?=\S)").split
_odd = re.compile(r" \s|\s ").search


def split_chunks(text: str) -> list[str]:
    """Cuts before every single space between two non-space characters; the chunks joined are the text."""
    first, *rest = (_between(text) if _odd(text) or text[0] == " " or text[-1] == " " else text.split(" "))
    return [first, *[" " + c for c in rest]]


def _coder(ranks_path: str, pattern: str) -> ByteBPE:
    """One coder for each Python worker, whose caches serve the tasks that follow."""
    return worker_state(("bpe", ranks_path, pattern), lambda: ByteBPE(load_ranks(ranks_path), pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for block in blocks(batches, limit=BLOCK):
            found = coder.encode(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), _lengths(found), pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def _lengths(found: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in found], pa.int64())


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds `decoded` (binary) to the result of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for block in blocks(batches, text=2, limit=4 * BLOCK):
            found = [coder.decode(np.frombuffer(x, "<u4")) for x in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(found, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return df.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), and decode() of its ids, in one pass: one Python worker and one coder for each task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for block in blocks(batches, limit=BLOCK):
            found = coder.encode(block.column(1).to_pylist())
            decoded = [coder.decode(np.frombuffer(x, "<u4")) for x in found]
            yield pa.RecordBatch.from_arrays([block.column(0), _lengths(found), pa.array(found, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")
