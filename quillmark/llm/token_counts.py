"""Token counts of whole texts without a list of ids.

Three steps, each linear in the input:

1. Documents are cut into pre-tokens as the tokenizer's own normalizer and pre-tokenizer do.  A block of about 10 MB of
   text becomes one row with each document's pre-token frequencies, packed, and a row for each bucket of its distinct
   pre-tokens.  They are written to the shared folder once.
2. Buckets, by a hash of the pre-token, go to their partition, where every distinct pre-token of the corpus is counted
   once by the tokenizer's model and joined to the blocks that have it.
3. The counts meet their block's frequencies again by its number, and are summed.

No row or group grows with the corpus: a block holds each pre-token once, so even the most frequent word is one entry
for each 10 MB of text, and buckets hold many words.

Null text counts as empty: zero bytes, zero tokens.  Repeated rows are counted each; null ids are kept.  A very long text
is a block of its own.  Other columns, whatever their names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm.common import blocks, id_text, partitions, release, worker_state, written

#: Entries of a worker's chunk cache; it only saves work.
CACHE_ENTRIES = 300_000
#: Text bytes of a block; larger blocks repeat fewer pre-tokens.
FREQUENCY_BLOCK = 10 << 20
#: Buckets of pre-tokens for each shuffle partition.
BUCKETS = 8
#: Either bucket, start, pieces: the block's pre-tokens numbered from start; or the rest: its documents' frequencies.
BLOCK_SCHEMA = "block bigint, bucket int, start int, pieces array<string>, doc_ids array<bigint>, n_bytes array<bigint>, ends array<int>, pairs binary"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())


class PreTokenizer:
    """Cuts texts into the pre-tokens of a tokenizer file whose pre-tokenizer drops white space.

    Such a pre-token never holds a space, so chunks between spaces can be cut alone, and they repeat.
    A special token inside a text is a pre-token of its own, as it is by the library's default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        alternatives = sorted(map(re.escape, self.special), key=len, reverse=True)
        self._at_special = re.compile(f"({'|'.join(alternatives)})").split if alternatives else None
        self._cache: dict[str, list[str]] = {}

        # What this file makes of a plain word, asked of its own normalizer and pre-tokenizer: itself, or itself in lower case.
        probe = "AbcXyz"
        made = self._pieces(probe)
        self._plain = str if made == [probe] else str.lower if made == [probe.lower()] else None
        if any(" " in piece or "\u0120" in piece or "\u2581" in piece for piece in self._pieces("a b")):
            raise ValueError(f"{path}: its pre-tokens hold white space; only pre-tokenizers that drop it can be cut by chunks")

    def _pieces(self, text: str) -> list[str]:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _cut(self, chunk: str) -> list[str]:
        if self._plain and chunk.isascii() and chunk.isalpha():
            return [self._plain(chunk)]
        parts = self._at_special(chunk) if self._at_special else [chunk]
        out = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif part:
                out += self._pieces(part)
        return out

    def learn(self, chunks: set[str]) -> dict[str, list[str]]:
        """The cache, with an entry for each of chunks."""
        if len(self._cache) + len(chunks) > CACHE_ENTRIES:
            self._cache.clear()
        for chunk in chunks:
            if chunk not in self._cache:
                self._cache[chunk] = self._cut(chunk)
        return self._cache

    def count(self, piece: str) -> int:
        return 1 if piece in self.special else len(self.tokenizer.model.tokenize(piece))


def _tokenizer(path: str) -> PreTokenizer:
    """One for each Python worker."""
    return worker_state(("tokens", path), lambda: PreTokenizer(path))


def _frequencies(cutter: PreTokenizer, texts: list[str], buckets: int) -> tuple[list[str], np.ndarray, np.ndarray, bytes]:
    """Distinct pre-tokens of the texts, their buckets, where each text's (pre-token, frequency) pairs end, and the packed pairs."""
    cut = [t.split(" ") for t in texts]
    chunk_number: dict[str, int] = {}
    for chunks in cut:
        for chunk in chunks:
            chunk_number.setdefault(chunk, len(chunk_number))
    known = cutter.learn(set(chunk_number))
    number: dict[str, int] = {}
    flat, chunk_ends = [], np.zeros(len(chunk_number) + 1, np.int64)
    for k, chunk in enumerate(chunk_number):
        flat += [number.setdefault(p, len(number)) for p in known[chunk]]
        chunk_ends[k + 1] = len(flat)
    pieces_of_chunk = np.array(flat, np.int64)
    sizes = np.array([len(c) for c in cut], np.int64)
    chunk_ids = np.fromiter((chunk_number[c] for chunks in cut for c in chunks), np.int64, int(sizes.sum()))
    # Ragged gather: all pre-tokens of all chunks in order, with the number of their document.
    lengths = np.diff(chunk_ends)[chunk_ids]
    total = int(lengths.sum())
    start = np.repeat(chunk_ends[chunk_ids] - (np.cumsum(lengths) - lengths), lengths)
    tokens = pieces_of_chunk[start + np.arange(total)] if total else np.zeros(0, np.int64)
    docs = np.repeat(np.repeat(np.arange(len(cut)), sizes), lengths)
    key, n = np.unique(docs * max(1, len(number)) + tokens, return_counts=True)
    doc, token = np.divmod(key, max(1, len(number)))
    ends = np.searchsorted(doc, np.arange(len(cut)), side="right")
    # Pre-tokens are numbered in order of their bucket; a document's pairs needn't be in order.
    pieces = list(number)
    bucket = np.fromiter((xxhash.xxh32_intdigest(p) % buckets for p in pieces), np.int64, len(pieces))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    token = place[token]
    by_doc = np.lexsort((token, doc))
    return [pieces[k] for k in order], bucket[order], ends, pack(token[by_doc], n[by_doc])


def pack(token: np.ndarray, n: np.ndarray) -> bytes:
    """Steps between token numbers and frequencies, by byte planes so that they compress well."""
    both = np.concatenate([np.diff(token, prepend=0), n]).astype("<i4")
    return len(token).to_bytes(4, "little") + pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(packed[:4], "little")
    raw = pa.decompress(packed[4:], size * 8, "zstd", asbytes=True)
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()
    return np.cumsum(both[:size], dtype=np.int64), both[size:].astype(np.int64)


def document_frequencies(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """Blocks of documents; see BLOCK_SCHEMA."""
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, first, k = _tokenizer(path), TaskContext.get().partitionId() << 32, 0
        for block in blocks(_gathered(batches), limit=FREQUENCY_BLOCK):
            pieces, bucket, ends, pairs = _frequencies(cutter, block.column(1).to_pylist(), buckets)
            size = pc.binary_length(block.column(1)).cast(pa.int64()).to_pylist()
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            stops = np.append(starts[1:], len(pieces))
            rows = [(first + k, None, None, None, block.column(0).to_pylist(), size, ends.tolist(), pairs)]
            rows += [(first + k, int(bucket[a]), int(a), pieces[a:b], None, None, None, None) for a, b in zip(starts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)
            k += 1

    return df.mapInArrow(run, BLOCK_SCHEMA)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins small Arrow batches up to the size of a block."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= FREQUENCY_BLOCK:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def count_pieces(pieces: DataFrame, path: str) -> DataFrame:
    """block, start, counts (unsigned 32-bit integers) of rows in order of their bucket; one bucket's pre-tokens are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known, at = _tokenizer(path), {}, None
        for batch in batches:
            counts = []
            for own, bucket in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket != at:
                    known, at = {}, bucket
                for piece in own:
                    if piece not in known:
                        known[piece] = cutter.count(piece)
                counts.append(np.fromiter((known[p] for p in own), "<u4", len(own)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.binary())], names=["block", "start", "counts"])
        release()

    return pieces.mapInArrow(run, "block bigint, start int, counts binary")


def _sum_block(freq: pa.Table, counts: pa.Table) -> pa.Table:
    ids, sizes, totals = [], [], []
    starts = counts.column("start").to_pylist()
    parts = [np.frombuffer(c, "<u4") for c in counts.column("counts").to_pylist()]
    weight = np.zeros(max((a + len(c) for a, c in zip(starts, parts, strict=True)), default=1), np.int64)
    for a, c in zip(starts, parts, strict=True):
        weight[a : a + len(c)] = c
    for row in range(freq.num_rows):
        token, n = unpack(freq.column("pairs")[row].as_py())
        ends = np.array(freq.column("ends")[row].as_py(), np.int64)
        sums = np.concatenate([[0], np.cumsum(weight[token] * n)])
        totals.append(np.diff(sums[np.concatenate([[0], ends])]))
        ids += freq.column("doc_ids")[row].as_py()
        sizes += freq.column("n_bytes")[row].as_py()
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(np.concatenate(totals) if totals else [], pa.int64())})


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row."""
    spread = partitions(df.sparkSession)
    found = written(document_frequencies(id_text(df, id_col, text_col), path, BUCKETS * spread), "pieces")
    pieces = found.filter("bucket is not null").select("block", "start", "pieces", "bucket").repartition(spread, "bucket").sortWithinPartitions("bucket")
    left = found.filter("bucket is null").select(F.col("block").alias("part"), "doc_ids", "n_bytes", "ends", "pairs")
    return left.groupBy("part").cogroup(count_pieces(pieces, path).groupBy("block")).applyInArrow(_sum_block, "doc_id bigint, n_bytes bigint, n_tokens bigint")
