"""Toxicity scores from a lexicon, its misspellings, and the words around each find.

The lexicon is a trie of terms, some of them open: stems that any ending may follow.  A Levenshtein automaton of each
term length's tolerance is intersected with it: a state is the set of trie nodes that a word's prefix can have reached
with so many edits.  States and their transitions are made when a word first needs them, so a word costs one table
lookup for each character, and most end after three.  Every find is made by the automaton, exact ones with no edit.

Terms are a short fixed list and words and stems learned from a bounded sample of labelled rows, by a likelihood ratio
test of their document frequencies; a stem must stand for several words.  All have the tolerance of their length.  How
often a term, or a misspelling seen in the sample, stands in a toxic document there is its precision.  A word of the
sample near a term is a misspelling only if it is as precise as terms must be; else it's a word of its own.  Each find is
weighed by its context window: quotation marks around it or a verb of reporting next to it lower its weight, an address
to a person raises it.  A text's score is the probability that not every find is harmless: one minus the product of
(1 - weight).  A text with one find only scores no more than such texts of the sample are toxic, by the kind of the find:
an insult of the fixed list, a learned term or stem, a misspelling, one with digits for letters.  A misspelling never
weighs more than what it misspells.  A text without finds gets the share of toxic rows among such texts of the sample.

What the model learns is bounded by the sample: at most about `max_toxic` and `max_clean` rows, `max_terms` terms, and
the `MAX_VARIANTS` most frequent misspellings of it.

Null and empty texts have no finds.  Labels, language, source and id aren't inputs of a score.  Whole texts are read,
however long.  Rows that repeat are rows of their own with equal scores; a null id stays null and isn't held out.  Other
columns, whatever their names, aren't read.  An empty table gives an empty result; without labels of both kinds the fixed
list is the lexicon.  A row labelled both ways counts as toxic, one without a label of 0 or 1 isn't in the sample.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import blocks, fold, id_text, worker_state, written

THRESHOLD = 0.3
#: Insults that the lexicon has before it learns any.
BASE_TERMS = ("idiot", "stupid", "moron", "scum", "trash", "worthless", "pathetic", "loser", "clown", "disgusting", "imbecile", "bastard", "dumbass", "asshole", "retard", "vermin", "filthy", "degenerate")
BASE_PRECISION, BASE_WEIGHT = 0.6, 2.0
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes term word phrase reported claimed alleged sagte schrieb nannte dijo escribió llamó dit écrit appelé".split())
ADDRESS = frozenset("you your you're u du dich dir ihr tu te ti usted vous toi votre".split())
OPEN, CLOSE = "\"“„«‘'", "\"”“»’'"
WINDOW, IN_QUOTES, REPORTED, ADDRESSED = 6, 0.4, 0.6, 1.15
#: Sample and lexicon bounds.
MAX_TOXIC, MAX_CLEAN, MAX_TERMS, MAX_VARIANTS = 3000, 6000, 4000, 20_000
STEMS, STEM_WORDS, LEAST_TEST, TERM_PRECISION, STEM_PRECISION = range(4, 9), 3, 8.0, 0.6, 0.9
CACHE_ENTRIES = 300_000
words_of = re.compile(r"\w+").findall


def tolerance(term: str) -> int:
    """Edits that a term of this length may differ by."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms, intersected with their trie and determinised as words need it."""

    def __init__(self, terms: dict[str, int] | list[str], stems: frozenset[str] | set[str] = frozenset(), most_states: int = 100_000):
        """terms: with the edits that each may differ by, or by tolerance(); stems: those that any ending may follow."""
        terms = terms if isinstance(terms, dict) else {t: tolerance(t) for t in terms}
        self.tolerance = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.open = [False]
        self.budget: list[int] = [0]  # greatest tolerance of a term at or below the node
        self.most_states = most_states
        for term, edits in sorted(terms.items()):
            node = 0
            self.budget[0] = max(self.budget[0], edits)
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.open.append(False)
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], edits)
            self.term[node], self.open[node] = term, term in stems
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {(): 0}
        self.sets: list[tuple] = [()]
        self.moves: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, str] | None] = [None]  # the best term of a word that ends here
        self.passes: list[tuple[int, str] | None] = [None]  # the best stem of a word that goes on
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """reached: fewest edits for each node; closed under skipped letters of a term."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            edits = reached[node] + 1
            for child in self.children[node].values():
                if edits <= self.budget[child] and edits < reached.get(child, 99):
                    reached[child] = edits
                    todo.append(child)
        key = tuple(sorted(reached.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found = [(e, self.term[n], self.open[n]) for n, e in key if self.term[n] is not None and e <= self.tolerance[self.term[n]]]
            self.accepts.append(min((x[:2] for x in found), default=None))
            self.passes.append(min((x[:2] for x in found if x[2]), default=None))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if edits < self.budget[node]:  # a letter too many
                reached[node] = min(edits + 1, reached.get(node, 99))
            for letter, child in self.children[node].items():
                cost = edits + (letter != ch)
                if cost <= self.budget[child]:
                    reached[child] = min(cost, reached.get(child, 99))
        to = self.moves[state][ch] = self._state(reached) if reached else 0
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its tolerance, ties to the one that sorts first, and the edits between.

        A stem is as far from a word as from the nearest of the word's beginnings.
        """
        if len(self.sets) > self.most_states:
            self._reset()
        state, best = self.start, None
        for ch in word:
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if not state:
                break
            stem = self.passes[state]
            if stem is not None and (best is None or stem < best):
                best = stem
        end = self.accepts[state]
        if end is not None and (best is None or end < best):
            best = end
        return None if best is None else (best[1], best[0])


@dataclass
class Model:
    """Precisions of terms, stems and seen misspellings; of other misspellings by term or stem.

    rest: the toxic share of texts without a find; single: of those with one find only, by its kind, and by kind and term.
    """

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    variants: dict[str, float] = field(default_factory=dict)
    unseen: dict[str, float] = field(default_factory=dict)
    rest: float = 0.01
    single: dict[str, float] = field(default_factory=dict)
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = LexiconAutomaton([*model.terms, *model.stems], frozenset(model.stems))
        self._clean: set[str] = set()
        self._bad: dict[str, list[tuple[str, tuple[str, str, float]]]] = {}

    def kind(self, word: str) -> tuple[str, str, float] | None:
        """('term', 'stem' or 'variant'; the term or stem; precision) of a word in lower case."""
        m, found = self.model, self.automaton.match(word)
        if found is None:
            return None
        term, edits = found
        if not edits:
            exact = m.terms.get(word)
            return ("term", word, exact) if exact is not None else ("stem", term, m.stems[term])
        p, most = m.variants.get(word), m.terms.get(term, m.stems.get(term, 1.0))
        if p is None:
            return "variant", term, min(most, m.unseen.get(term, BASE_PRECISION) * 0.8 ** (edits - 1))
        return ("variant", term, min(most, p)) if p >= TERM_PRECISION else None

    @staticmethod
    def single_kind(word: str, kind: str) -> str:
        """What a find says if it is a text's only one: a letter becomes a digit by no accident, unlike other edits."""
        if kind == "variant":
            return "masked" if any(ch.isdigit() or ch == "_" for ch in word) else "misspelled"
        return "insult" if word in BASE_TERMS else "learned"

    def alone(self, word: str, kind: str, term: str) -> float:
        """The most that a text scores whose only find is this one; for a misspelling, at most that of its term."""
        own = self.single_kind(word, kind)
        most = self.model.single.get(f"{own}:{term}", self.model.single.get(own, 1.0))
        return most if kind != "variant" else min(most, self.alone(term, "term", term))

    def _learn(self, chunks: set[str]) -> None:
        if len(self._clean) + len(chunks) > CACHE_ENTRIES:
            self._clean.clear()
        if len(self._bad) > CACHE_ENTRIES:
            self._bad.clear()
        for chunk in chunks - self._clean:
            if chunk in self._bad:
                continue
            finds = [(w, k) for w in words_of(chunk.lower()) if (k := self.kind(w)) is not None]
            if finds:
                self._bad[chunk] = finds
            else:
                self._clean.add(chunk)

    @staticmethod
    def _context(tokens: list[str], at: int) -> float:
        """The factor of a find at tokens[at]."""
        low, high = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
        window = [t.lower().strip(".,;:!?()[]") for t in tokens[low:high]]
        opened = tokens[at][0] in OPEN or any(t[0] in OPEN and t[-1] not in CLOSE for t in tokens[low:at])
        closed = tokens[at].rstrip(".,;:!?")[-1:] in tuple(CLOSE) or any(t.rstrip(".,;:!?")[-1:] in tuple(CLOSE) and t[0] not in OPEN for t in tokens[at + 1 : high])
        factor = IN_QUOTES if opened and closed else 1.0
        if not REPORTING.isdisjoint(window):
            factor *= REPORTED
        if factor == 1.0 and not ADDRESS.isdisjoint(window):
            factor = ADDRESSED
        return factor

    def score(self, texts: list[str]) -> list[tuple[float, int, int, int]]:
        """score, finds, of them misspelled, of them discounted by context, of each text."""
        cut = [t.split() for t in texts]
        sets = [set(tokens) for tokens in cut]
        out = []
        for tokens, own in zip(cut, sets, strict=True):
            self._learn(own)
            bad = own & self._bad.keys()
            if not bad:
                out.append((self.model.rest, 0, 0, 0))
                continue
            best: dict[str, float] = {}
            variant = 0.0  # of all misspellings only the surest counts: near words of one kind come together
            finds = misspelled = discounted = 0
            most = 1.0
            for at, token in enumerate(tokens):
                if token in bad:
                    factor = self._context(tokens, at)
                    for word, (kind, term, p) in self._bad[token]:
                        finds += 1
                        most = self.alone(word, kind, term) if finds == 1 else 1.0
                        misspelled += kind == "variant"
                        discounted += factor < 1
                        p = min(0.995, p * factor)
                        if kind == "variant":
                            variant = max(variant, p)
                        else:
                            best[word] = max(best.get(word, 0.0), p)
            clean = (1.0 - self.model.rest) * (1.0 - variant)
            for p in best.values():
                clean *= 1.0 - p
            out.append((min(1.0 - clean, most), finds, misspelled, discounted))
        return out


def _sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """toxic, text of a bounded sample of labelled documents that aren't held out; chosen by a hash of the id.

    Only ids and labels are counted and sampled; their bound makes the sampled side of the join a small one.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 2))
    size = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = {k: int(min(1.0, most / max(1, size.get(k, 0))) * (1 << 30)) for k, most in ((0, max_clean), (1, max_toxic))}
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return id_text(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text", "doc_id")


def _without_copies(sample: DataFrame, functions: int = 4) -> DataFrame:
    """Drops a row if one of the least hashes of its five-word shingles is that of a row before it, by id and text.

    A group of near copies would make every rare word of its text look like a sign of its label.
    """
    seeds = np.random.default_rng(1).integers(1, 2**63, functions, dtype=np.uint64) | np.uint64(1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            least = []
            for text in block.column(1).to_pylist():
                words = text.lower().split()
                shingles = {xxhash.xxh64_intdigest(" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))}
                hashes = np.fromiter(shingles, np.uint64, len(shingles))
                least.append([int(((hashes * seed) >> np.uint64(1)).min()) for seed in seeds])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(least, pa.list_(pa.int64()))], names=["toxic", "text", "doc_id", "digest", "keys"])

    # Rows are told apart by id and text: an id that occurs with several texts has the firsts of each.
    keyed = written(sample.withColumn("digest", F.md5("text")).mapInArrow(keys, "toxic int, text string, doc_id bigint, digest string, keys array<bigint>"), "sample")
    firsts = keyed.select("doc_id", "digest", F.posexplode("keys")).groupBy("pos", "col").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    kept = firsts.groupBy("first").count().filter(F.col("count") == functions).select("first.doc_id", "first.digest")
    return keyed.join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_terms: int = MAX_TERMS) -> Model:
    """Learns the lexicon and its precisions from at most about max_toxic + max_clean labelled documents."""
    sample = _without_copies(_sample(docs, labels, max_toxic, max_clean)).persist()
    try:
        return _fit(sample, max_terms)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame, max_terms: int) -> Model:
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    base = {t: BASE_PRECISION for t in BASE_TERMS}
    if not n1 or not n0:
        return Model(terms=base)
    share = n1 / (n1 + n0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = (Counter(), Counter())
            for toxic, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                words = set(words_of(text.lower()))
                found[toxic].update(words)
                found[toxic].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
            yield _class_counts(found)

    schema = "term string, c1 bigint, c0 bigint"
    counted = written(sample.mapInArrow(count, schema).groupBy("term").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")), "counted")
    c1, c0, total = F.col("c1"), F.col("c0"), F.col("c1") + F.col("c0")
    part = lambda c, s: F.when(c > 0, c * F.log(c / (total * s))).otherwise(0.0)
    tested = counted.filter("c1 >= 3").withColumn("test", part(c1, share) + part(c0, 1 - share)).withColumn("precision", (c1 + 0.5 * share) / (total + 0.5))
    is_stem = F.col("term").endswith("*")
    likely = tested.filter((F.col("test") >= LEAST_TEST) & (F.col("precision") >= F.when(is_stem, STEM_PRECISION).otherwise(TERM_PRECISION)) & (F.length("term") >= 4))
    prefixes = F.filter(F.array(*(F.when(F.length("term") > n, F.concat(F.substring("term", 1, n), F.lit("*"))) for n in STEMS)), lambda x: x.isNotNull())
    several = counted.filter(~is_stem & (c1 > 0)).select(F.explode(prefixes).alias("term")).groupBy("term").count().filter(F.col("count") >= STEM_WORDS).select("term")
    learned = likely.filter(~is_stem).unionByName(likely.filter(is_stem).join(several, "term", "left_semi"))
    rows = learned.orderBy(F.desc("test"), "term").limit(max_terms).collect()
    seen = {r["term"]: r for r in counted.filter(F.col("term").isin(list(BASE_TERMS))).collect()}
    terms = {t: (BASE_PRECISION * BASE_WEIGHT + (seen[t]["c1"] if t in seen else 0)) / (BASE_WEIGHT + (seen[t]["c1"] + seen[t]["c0"] if t in seen else 0)) for t in BASE_TERMS}
    stems, found = {}, {r["term"][:-1]: r["c1"] for r in rows if r["term"].endswith("*")}
    longer = {s[:n] for s, c in found.items() for n in range(1, len(s)) if found.get(s[:n]) == c}  # as often as a longer one, which says more
    for r in rows:
        if r["term"].endswith("*"):
            if r["term"][:-1] not in longer:
                stems[r["term"][:-1]] = r["precision"]
        else:
            terms[r["term"]] = max(terms.get(r["term"], 0.0), r["precision"])
    # A stem that goes on a shorter one adds nothing to the trie but states.
    stems = {s: p for s, p in stems.items() if not any(s[:n] in stems for n in range(1, len(s)))}
    model = Model(terms=terms, stems=stems)
    first = Scorer(model)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = (Counter(), Counter())
            for toxic, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                kinds = {w: k for w in set(words_of(text.lower())) if (k := first.kind(w)) is not None}
                found[toxic].update({f"{k[1]} {w}" for w, k in kinds.items() if k[0] == "variant"})
            yield _class_counts(found)

    total = lambda counts: counts.groupBy("term").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    rows = total(sample.mapInArrow(variants, schema)).orderBy(F.desc(F.expr("c1 + c0")), "term").limit(MAX_VARIANTS).collect()
    by_term: dict[str, list[float]] = {}
    seen_variants: list[tuple[str, str, int, int]] = []
    for r in rows:
        c1, c0 = r["c1"], r["c0"]
        term, word = r["term"].split(" ")
        by_term.setdefault(term, []).append(c1 / (c1 + c0))
        seen_variants.append((term, word, c1, c1 + c0))
    # A misspelling that the sample doesn't show is as precise as others of its term there: each counts once, as a
    # single frequent ordinary word near a term says nothing of the rest.  One that it shows seldom is nearly so.
    model.unseen = {t: (sum(p) + BASE_PRECISION) / (len(p) + 1.0) for t, p in by_term.items()}
    model.variants = {word: (c1 + model.unseen[term]) / (n + 1.0) for term, word, c1, n in seen_variants}
    known = Scorer(model)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What texts with one find, and with none, say."""
        for block in blocks(batches):
            found = (Counter(), Counter())
            for toxic, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                finds = [(w, k) for w in words_of(text.lower()) if (k := known.kind(w)) is not None]
                if not finds:
                    found[toxic].update(["none"])
                elif len(finds) == 1:
                    word, (kind, term, _) = finds[0]
                    own = known.single_kind(word, kind)
                    found[toxic].update([own, f"{own}:{term}"])
            yield _class_counts(found)

    alone = {r["term"]: (r["c1"], r["c1"] + r["c0"]) for r in total(sample.mapInArrow(few, schema)).collect()}  # at most a few for each term
    c1, n = alone.pop("none", (0, 0))
    model.rest = min(0.25, (c1 + 0.5) / (n + 1.0))
    # Each kind starts from what terms must be; each term from its kind.
    share = lambda name, start: (alone.get(name, (0, 0))[0] + BASE_WEIGHT * start) / (alone.get(name, (0, 0))[1] + BASE_WEIGHT)
    kinds = {k: share(k, BASE_PRECISION) for k in ("insult", "learned", "misspelled", "masked")}
    model.single = kinds | {k: share(k, kinds[k.split(":")[0]]) for k in alone if ":" in k}
    return model


def _class_counts(found: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(found[0].keys() | found[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()), pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "c1", "c0"])


def _scorer(model: Broadcast) -> Scorer:
    """One for each Python worker and model."""
    return worker_state(("toxicity", model.value.uid), lambda: Scorer(model.value))


def score(df: DataFrame, model: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, and counts of finds, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for block in blocks(batches):
            found = scorer.score(block.column(1).to_pylist())
            cols = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(cols[0], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "score", "finds", "misspelled", "discounted"])

    found = id_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, score double, finds bigint, misspelled bigint, discounted bigint")
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "finds", "misspelled", "discounted")


def detect(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Fits on the labelled documents and scores every document."""
    model = fit(docs, labels, **fitting)
    return score(docs, docs.sparkSession.sparkContext.broadcast(model))
