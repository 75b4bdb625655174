"""Words of passages that an earlier document has too, found by doubling the length of windows that repeat.

A window is `words` consecutive words.  Its words are judged at lengths that double up to it (13, 25, 50): a window that
repeats does so at every shorter length.  At a shorter length the least hash of its windows of that length stands for it,
the same one in every document that holds the window, so few windows of a text are looked up.  Those that repeat, in
documents of different ids, go on to twice the length, and the texts around them with their words' hashes, once; where
none is left, nothing repeats and the search ends.  At the full length every window left is looked up, by 96 bits.

A window's first document is the least id that has it: ids are reduced where windows lie before they meet, so a passage
that many documents share is a row for each task, and found windows are joined back on their hash alone, a join that
adaptive execution splits where a passage is hot.  Of rows with the same text, the one of the least id is searched; the
others hold nothing of their own, and lose all that windows cover.

Documents are read in the first pass, once more for those with a candidate, and once for the result.  Null and empty
texts have no words, and texts of fewer words than a window keep all.  Rows that repeat an id are rows of their own, and
the same document where first ones are sought: none is smaller.  Rows without an id stay whole and are no one's first.
Other columns aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import BLOCK_BYTES, blocks, counted, small_batches, worker_state, written

#: Lengths below this aren't looked up; doubling starts at this or the next more.
LEAST_LENGTH = 13
#: Rows, and hashes or ranges in them, up to which a table is broadcast (16 MB each); beyond it is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def lengths(words: int) -> list[int]:
    """The lengths to look up, doubling up to words."""
    out = [words]
    while (out[0] + 1) // 2 >= LEAST_LENGTH:
        out.insert(0, (out[0] + 1) // 2)
    return out


def doubled(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hashes of all windows of a length, from those of the two halves, which overlap in a word if the length is odd."""
    if len(h) < length:
        return h[:0]
    if length == 1:
        return h
    half, n = (length + 1) // 2, len(h) - length + 1
    part = doubled(h, half, seed)
    out = part[:n] * _MIX[0] + (part[length - half : length - half + n] ^ np.uint64(length + (seed << 32))) * _MIX[1]
    out ^= out >> np.uint64(29)
    out *= _MIX[2 + seed % 2]
    out ^= out >> np.uint64(32)
    return out


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width entries."""
    size = 1
    while 2 * size <= width:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return h if size == width else np.minimum(h[: size - width], h[width - size :])


def stand_ins(h: np.ndarray, length: int, words: int) -> np.ndarray:
    """For every window of `words` words, the least hash of its windows of that length."""
    return least_in(doubled(h, length), words - length + 1) if len(h) >= words else h[:0]


def word_hashes(texts: list[bytes | None]) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text and their 64-bit hashes; a word that occurs again isn't hashed again."""
    known: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = (text or b"").split()  # of bytes: the six ASCII white-space characters
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out.append((words, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
    return out


def _longs(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, text as bytes."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """row (a number), doc_id, digest, n_words, anchors: what stands for the windows of each row at the first length."""
    length = lengths(words)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("substring", lambda: None)  # what another operator keeps is let go
        for block in blocks(batches, 2):
            cut = word_hashes(block.column(2).to_pylist())
            anchors = [np.unique(stand_ins(h, length, words)) for _, h in cut]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array([len(w) for w, _ in cut], pa.int64()), _longs(anchors)], names=["doc_id", "digest", "n_words", "anchors"])

    done = docs.mapInArrow(run, "doc_id bigint, digest binary, n_words bigint, anchors array<bigint>")
    return done.withColumn("row", F.monotonically_increasing_id())


def repeated(windows: DataFrame) -> DataFrame:
    """Those of row, doc_id, hash whose hash documents of different ids have."""
    several = windows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("hash")
    return windows.join(several, "hash", "left_semi")


def runs_of(kept: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of true entries."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


RUNS = "row bigint, doc_id bigint, start int, hashes binary"


def _runs(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["row", "doc_id", "start", "hashes"])


def _narrowed(h: np.ndarray, anchors: np.ndarray, length: int, words: int) -> list[tuple[int, int]]:
    """Runs of windows whose stand-ins are among anchors."""
    return runs_of(np.isin(stand_ins(h, length, words), anchors))


def opened(docs: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """row, doc_id, start, hashes: the runs of windows that candidates (row, doc_id, digest, anchors) leave, with their words' hashes."""
    length = lengths(words)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 0):
            rows = []
            for (_, h), row, doc_id, anchors in zip(word_hashes(block.column(0).to_pylist()), block.column(1).to_pylist(), block.column(2).to_pylist(), block.column(3), strict=True):
                found = _narrowed(h, anchors.values.to_numpy().view(np.uint64), length, words)
                rows += [(row, doc_id, a, h[a : b + words - 1].tobytes()) for a, b in found]
            if rows:
                yield _runs(rows)

    both = docs.join(candidates, ["doc_id", "digest"])
    return both.select("text", "row", "doc_id", "anchors").mapInArrow(run, RUNS)


def looked_up(runs: DataFrame, length: int, words: int) -> DataFrame:
    """row, doc_id, start, hash: what stands for the windows of each run at a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 3):
            found = [np.unique(stand_ins(np.frombuffer(h.as_buffer(), np.uint64), length, words)) for h in block.column(3)]
            size = [len(f) for f in found]
            columns = [np.repeat(block.column(k).to_numpy(zero_copy_only=False), size) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(found).view(np.int64))], names=["row", "doc_id", "start", "hash"])

    return runs.mapInArrow(run, "row bigint, doc_id bigint, start int, hash bigint")


def narrowed(runs: DataFrame, length: int, words: int) -> DataFrame:
    """The runs of windows whose stand-ins at a length repeat."""
    left = repeated(looked_up(runs, length, words)).groupBy("row", "start").agg(F.collect_list("hash").alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 3):
            rows = []
            for row, doc_id, start, bits, anchors in zip(*(block.column(k).to_pylist() for k in range(4)), block.column(4), strict=True):
                h = np.frombuffer(bits, np.uint64)
                rows += [(row, doc_id, start + a, h[a : b + words - 1].tobytes()) for a, b in _narrowed(h, anchors.values.to_numpy().view(np.uint64), length, words)]
            if rows:
                yield _runs(rows)

    return runs.join(left, ["row", "start"]).select("row", "doc_id", "start", "hashes", "anchors").mapInArrow(run, RUNS)


def full_windows(runs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, place, hash, more: every window of the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 3, BLOCK_BYTES // 4):
            found = [np.frombuffer(h.as_buffer(), np.uint64) for h in block.column(3)]
            size = [len(h) - words + 1 for h in found]
            row, doc_id, start = (np.repeat(block.column(k).to_numpy(zero_copy_only=False), size) for k in range(3))
            place = start + np.concatenate([np.arange(n, dtype=np.int32) for n in size])
            first, second = (np.concatenate([doubled(h, words, seed) for h in found]) for seed in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(doc_id), pa.array(place.astype(np.int32)), pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32))], names=["row", "doc_id", "place", "hash", "more"])

    return runs.mapInArrow(run, "row bigint, doc_id bigint, place int, hash bigint, more int")


def covered(places: DataFrame, words: int) -> DataFrame:
    """row, starts, ends: the ranges of words that windows at places cover."""
    gathered = places.groupBy("row").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches:
            starts, ends = [], []
            for places in block.column(1):
                p = np.unique(places.values.to_numpy())
                gap = np.flatnonzero(np.diff(p) > words)
                starts.append(p[np.r_[0, gap + 1]].tolist())
                ends.append((p[np.r_[gap, len(p) - 1]] + words).tolist())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["row", "starts", "ends"])

    return gathered.mapInArrow(run, "row bigint, starts array<int>, ends array<int>")


def _sized(df: DataFrame, what: str, size: str) -> DataFrame:
    """Written, and broadcast if its rows and the entries of its arrays are few."""
    out, seen = counted(df, what, entries=F.coalesce(F.sum(F.size(size)), F.lit(0)))
    return F.broadcast(out) if max(seen["n"], seen["entries"]) <= BROADCAST_ROWS else out


def removals(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, starts, ends of the rows that lose words, each once."""
    rows = written(sketch(docs, words), "sketch").filter((F.col("n_words") >= words) & F.col("doc_id").isNotNull())
    # Of a text that several rows have, one is searched: rows with its least id.
    first = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    named = rows.join(first, "digest")
    copies = named.filter("doc_id > first.doc_id").select("doc_id", "digest", F.array(F.lit(0)).alias("starts"), F.array(F.col("n_words").cast("int")).alias("ends"))
    searched = named.filter("row = first.row").select("row", "doc_id", "digest", "anchors")
    windows = searched.select("row", "doc_id", F.explode("anchors").alias("hash"))
    left = repeated(windows).groupBy("row").agg(F.collect_list("hash").alias("anchors"))
    candidates = _sized(searched.drop("anchors").join(left, "row"), "candidates", "anchors")
    runs = written(opened(docs, candidates, words), "runs")
    for length in lengths(words)[1:-1]:
        if runs.isEmpty():
            break
        runs = written(narrowed(runs, length, words), "runs")
    windows = full_windows(runs, words)
    least = windows.groupBy("hash", "more").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("hash", "more", "least")
    places = windows.join(least, ["hash", "more"]).filter("doc_id > least").select("row", "place")
    partly = searched.select("row", "doc_id", "digest").join(covered(places, words), "row").drop("row")
    return _sized(partly.unionByName(copies).dropDuplicates(["doc_id", "digest"]), "removals", "starts")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """doc_id, n_words, starts, ends (ranges of words removed), kept (the others, joined by a space) of every row.

    A word is removed if a window of `words` words covers it whose words also start in a row of a smaller id.
    """
    docs = _columns(df, id_col, text_col)
    found = removals(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 1):
            n, kept = [], []
            for text, starts, ends in zip(*(block.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                cut = text.split()
                n.append(len(cut))
                for a, b in zip(reversed(starts or []), reversed(ends or []), strict=True):
                    del cut[a:b]
                kept.append(b" ".join(cut))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(n, pa.int64()), block.column(2), block.column(3), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "starts", "ends", "kept"])

    both = docs.join(found, ["doc_id", "digest"], "left").select("doc_id", "text", "starts", "ends")
    done = both.mapInArrow(run, "doc_id bigint, n_words bigint, starts array<int>, ends array<int>, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))
