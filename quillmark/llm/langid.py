"""Language identification by words first, then by ever shorter character n-grams.

Training counts words and the n-grams (5 down to 1, with word edges marked) of a bounded sample of documents with a
language: about `per_language` of each at most, chosen by a hash of their id.  Words seen less than `LEAST_WORD` times
and n-grams seen less than `LEAST_GRAM` times in it are left out, as chance finds.  The model has at most `max_cells`
numbers for words and as many for n-grams, which bounds what is sent to the workers: beyond it, the least count rises.
No language is left out.

A known word adds its log frequency in each language.  An unseen word adds the mean log frequency of its known n-grams
of the greatest length that has any.  The language of the greatest mean wins, ties go to the name that sorts first.
The score is that language's share when the mean log frequencies are turned back into probabilities: 0 to 1.

A text that is null, empty or without letters (Unicode category L) is `und` with score 0, as is any text if nothing could
be learned: an empty table, or one without languages.  Words are compared in lower case; digits, number signs and
punctuation say nothing.  Whole texts are read, however long.  Rows that repeat, with or without their id, are rows of
their own, and equal texts get equal results.  Other columns, whatever their names, aren't read; `tagged` keeps them.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillmark.llm.common import blocks, counted, fold, fresh, id_text, own_columns, small_batches, worker_state, written

UNDETERMINED = "und"
LONGEST = 5
SMOOTHING = 0.5
LEAST_WORD, LEAST_GRAM = 2, 3
#: Labels up to which their rates are broadcast.
BROADCAST_LABELS = 1_000_000
#: Entries of a worker's chunk cache; it only saves work.
CACHE_ENTRIES = 300_000
_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters; the pattern's runs may hold number signs such as a half or a Roman eight as well."""
    runs = _runs(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Log frequencies: a row for each word or n-gram, a column for each language."""

    languages: list[str]
    words: list[str]
    word_logs: np.ndarray
    grams: list[str]
    gram_logs: np.ndarray
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


def _sampled(docs: DataFrame, label: str, per_label: int) -> tuple[DataFrame, list]:
    """Rows whose hash falls under their label's rate; the rate makes about per_label rows of each label.

    Rates are a table, joined where rows lie as long as labels are few enough to broadcast.  The model has a column for
    each label, so their names are gathered.
    """
    sizes, seen = counted(docs.groupBy(label).count(), "labels")
    if not seen["n"]:
        return docs.limit(0), []
    rates = sizes.select(label, (F.least(F.lit(1.0), per_label / F.col("count")) * (1 << 30)).cast("bigint").alias("_rate"))
    rated = docs.join(F.broadcast(rates) if seen["n"] <= BROADCAST_LABELS else rates, label)
    return rated.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.col("_rate")).drop("_rate"), sorted(r[label] for r in sizes.select(label).collect())


def _kept(counts: DataFrame, most: int) -> list:
    """At most `most` rows (label, term, n): the most frequent ones, of those with one n the first by term and label."""
    by_n = sorted(counts.groupBy("n").count().collect(), key=lambda r: -r["n"]) if most else []
    least, total, tied = None, 0, None
    for r in by_n:
        if total + r["count"] > most:
            tied = r["n"]
            break
        least, total = r["n"], total + r["count"]
    rows = counts.filter(F.col("n") >= least).collect() if least is not None else []
    if tied is not None and total < most:
        rows += counts.filter(F.col("n") == tied).orderBy("term", "label").limit(most - total).collect()
    return rows


def _matrix(rows: list, languages: list[str], groups: list[str]) -> tuple[list[str], np.ndarray]:
    """Log of the smoothed frequency of each term within its group (words, or n-grams of one length)."""
    column = {name: k for k, name in enumerate(languages)}
    terms: dict[str, int] = {}
    for r in rows:
        terms.setdefault(r["term"], len(terms))
    counts = np.full((len(terms), len(languages)), SMOOTHING)
    for r in rows:
        counts[terms[r["term"]], column[r["label"]]] += r["n"]
    out, kinds = np.zeros(counts.shape, np.float32), np.array([groups[0] if len(groups) == 1 else len(t) for t in terms])
    for kind in set(kinds.tolist()):
        own = kinds == kind
        out[own] = np.log(counts[own] / counts[own].sum(axis=0))
    return list(terms), out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, max_cells: int = 1_600_000) -> Model:
    """Learns from documents with a language that aren't held out (crc32 of the id modulo 4 isn't 2)."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    train = own.filter(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 2))
    sample, languages = _sampled(train, "label", per_language)
    if not languages:
        return Model([], [], np.zeros((0, 0)), [], np.zeros((0, 0)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found: dict[str, Counter] = {}
            for label, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                found.setdefault(label, Counter()).update(words_of((text or "").lower()))
            yield from _counted(found)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for label, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = found.setdefault(label, Counter())
                for length in range(1, LONGEST + 1):
                    for gram in grams_of(word, length):
                        own[gram] += n
            yield from _counted(found)

    schema = "label string, term string, n bigint"
    words = sample.select("label", "text").mapInArrow(count_words, schema).groupBy("label", "term").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    grams = written(words.mapInArrow(count_grams, schema).groupBy("label", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_GRAM), "grams")
    most = max_cells // len(languages)
    word_terms, word_logs = _matrix(_kept(words.filter(F.col("n") >= LEAST_WORD), most), languages, ["word"])
    gram_terms, gram_logs = _matrix(_kept(grams, most), languages, [])
    return Model(languages, word_terms, word_logs, gram_terms, gram_logs)


def _counted(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for label, counts in found.items():
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["label", "term", "n"])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.words = {w: k for k, w in enumerate(model.words)}
        self.grams = {g: k for k, g in enumerate(model.grams)}
        self._number: dict[str, int] = {}
        self._sums = np.zeros((CACHE_ENTRIES, self.width + 2))

    def word(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word, or of its longest known n-grams; None if no character is known."""
        k = self.words.get(word)
        if k is not None:
            return self.model.word_logs[k]
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return self.model.gram_logs[known].mean(axis=0)
        return None

    def _learn(self, chunks: set[str]) -> None:
        if len(self._number) + len(chunks) > len(self._sums):
            self._number.clear()
            if len(chunks) > len(self._sums):  # of one very long text
                self._sums = np.zeros((len(chunks), self.width + 2))
        for chunk in chunks:
            if chunk in self._number:
                continue
            row = self._sums[len(self._number)]
            row[:] = 0
            for word in words_of(chunk.lower()):
                logs = self.word(word)
                if logs is not None:
                    row[: self.width] += logs
                    row[self.width] += 1
                row[self.width + 1] += 1
            self._number[chunk] = len(self._number)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        cut = [t.split() for t in texts]
        self._learn({c for chunks in cut for c in chunks})
        get = self._number.__getitem__
        names, scores = [], np.zeros(len(texts))
        for k, chunks in enumerate(cut):
            sums = self._sums[np.fromiter(map(get, chunks), np.int64, len(chunks))].sum(axis=0)
            if not self.width or not sums[-1]:
                names.append(UNDETERMINED)
                continue
            mean = sums[: self.width] / max(1.0, sums[self.width])
            share = np.exp(mean - mean.max())
            best = int(share.argmax())
            names.append(self.model.languages[best])
            scores[k] = 1.0 / share.sum()
        return names, scores


def _scorer(model: Broadcast) -> Scorer:
    """One for each Python worker and model."""
    return worker_state(("langid", model.value.uid), lambda: Scorer(model.value))


def identify(df: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for block in blocks(batches):
            names, scores = scorer.score(block.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def tagged(df: DataFrame, model: Broadcast, text_col: str = "text", names: tuple[str, str] = ("_lang_pred", "_lang_score")) -> DataFrame:
    """All columns of df, with the language and its score by the names given.

    Only the text goes through Python; the other columns stay in the JVM.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(model)
        for batch in batches:
            languages, scores = [], []
            for block in blocks([pa.RecordBatch.from_arrays([batch], names=["text"])], text=0):
                own, found = scorer.score([t or "" for t in block.column(0).to_pylist()])
                languages += own
                scores.append(found)
            yield pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["lang_pred", "score"])

    small_batches(df.sparkSession)
    found = fresh(df, "found")
    score = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()  # not to be run twice, for a filter and again
    both = df.select(*own_columns(df), score(F.col(text_col).cast("string")).alias(found))
    return both.select(*own_columns(df), *(F.col(found)[field].alias(name) for field, name in zip(("lang_pred", "score"), names, strict=True)))


def detect(docs: DataFrame, **fitting) -> DataFrame:
    """Fits on documents with a language and identifies every row of the same table."""
    model = fit(docs, **fitting)
    return identify(docs, docs.sparkSession.sparkContext.broadcast(model))
