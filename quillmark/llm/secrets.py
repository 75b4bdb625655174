"""Secret scans by DataFrame functions only.

Base detectors are three patterns: assignments to password-like names, access key ids, long hex runs.  Positions come
from the text cut at the matches: a match starts after all pieces and matches before it, in code points.

The entropy detector looks at candidates, runs of at least 20 characters of the base64 alphabet.  A window of 20
characters slides over each; the counts of its characters are kept in an array, and stepping by one character changes
two of them, so the sum of c * log2(c) changes by two table entries.  The table holds millionths as integers: the same
sum results in any order.  A candidate of hex digits only needs less entropy than one of mixed characters.  An
allow-list suppresses what looks random but isn't a secret: plain words, numbers, UUIDs, paths, placeholders, and
sequences.  Entropy spans that overlap a base span aren't reported again.

Null and empty texts have no spans.  Ids may be null or repeat; each row is scanned by itself, without a shuffle.
scan() reads no other column; redact() hands all of them on, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import id_text, own_columns

#: Fixed by the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least entropy, in bits, of the best window: of hex digits, of letters and digits, of the whole alphabet.
LEAST_BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.7}
ALLOWED = (
    r"^[^0-9]*$",  # words, however long
    r"^[0-9+/_=-]*$",  # numbers, dates, rulers
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^/?([a-z]+[/_-]+)+[a-z0-9]{0,19}$",  # paths and names
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxxxx)",
    r"(?i)(0123456789|abcdefghij)",
)


def _scaled(k: int) -> int:
    return round(k * math.log2(k) * 1_000_000) if k > 1 else 0


STEP = [_scaled(k + 1) - _scaled(k) for k in range(WINDOW + 1)]


def most_sum(bits: float) -> int:
    """The largest scaled sum of c * log2(c) over a window whose entropy is at least `bits`."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1_000_000)


#: Matches of a text that are placed together.
BLOCK = 64
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _placed(text: Column, pattern: str, kind: str, keep, *groups: int) -> Column:
    """Spans of the non-overlapping matches for which keep(match, *groups) holds.

    Matches are taken in blocks: a block starts after the lengths of all blocks before, so that no list is copied for
    each match of a text, only for those of a block.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), *(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))
    ends_after = lambda at, x: at + F.length(x["before"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def merge(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["before"]), ends_after(acc["at"], x)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        wanted = x["m"].isNotNull() & keep(x["m"], *(x[f"g{g}"] for g in groups))
        return F.struct(end.alias("at"), F.when(wanted, F.concat(acc["out"], F.array(span).cast(f"array<{SPAN}>"))).otherwise(acc["out"]).alias("out"))

    def spans(parts: Column) -> Column:
        of_block = lambda k: F.slice(parts, k * BLOCK + 1, F.lit(BLOCK))
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(of_block(k), F.lit(0), ends_after))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        found = F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda at, k: F.aggregate(of_block(k), F.struct(at.alias("at"), _none().alias("out")), merge, lambda acc: acc["out"]))
        return F.flatten(found)

    return F.transform(F.array(parts), spans)[0]


def window_sum(candidate: Column) -> Column:
    """The least scaled sum of c * log2(c) over all windows of a candidate of at least WINDOW characters."""
    codes = lambda: F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = F.zip_with(codes(), F.concat(F.array_repeat(F.lit(0), WINDOW), codes()), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    table = F.array(*(F.lit(x) for x in STEP))

    def merge(acc: Column, x: Column) -> Column:
        counts, new, old = acc["counts"], x["new"], x["old"]
        same = new == old
        out_step = F.when((old == 0) | same, 0).otherwise(F.get(table, F.get(counts, old - 1) - 1))
        in_step = F.when(same, 0).otherwise(F.get(table, F.get(counts, new - 1)))
        total = acc["total"] + in_step - out_step
        n = acc["n"] + 1
        moved = F.transform(counts, lambda c, k: c + F.when(k == new - 1, 1).otherwise(0) - F.when(k == old - 1, 1).otherwise(0))
        best = F.when((n >= WINDOW) & (total < acc["best"]), total).otherwise(acc["best"])
        going = F.struct(moved.alias("counts"), total.alias("total"), best.alias("best"), n.alias("n"))
        return F.when(new.isNull(), acc).otherwise(going)  # the list of leaving characters is longer

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("total"), F.lit(2**31 - 1).alias("best"), F.lit(0).alias("n"))
    return F.aggregate(steps, start, merge, lambda acc: acc["best"])


def is_random(candidate: Column) -> Column:
    """Whether a window of the candidate has the entropy that its character class asks for."""
    bound = F.when(candidate.rlike("^[0-9a-fA-F]+$"), most_sum(LEAST_BITS["hex"])).when(candidate.rlike("^[A-Za-z0-9]+$"), most_sum(LEAST_BITS["alnum"])).otherwise(most_sum(LEAST_BITS["base64"]))
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, False).otherwise(window_sum(candidate) <= bound)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, kind, end in order of start, then kind) of every row."""
    return _scanned(id_text(df, id_col, text_col)).select("doc_id", "base", "spans")


def _scanned(df: DataFrame) -> DataFrame:
    """Adds base and spans to a table with a non-null column text."""
    text, lower = F.col("text"), F.lower("text")
    named = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    long_hex = rf"[0-9a-f]{{{HEX_LEAST},}}"  # the same runs as those of HEX that are long enough
    long_key = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
    always = lambda m: F.lit(True)
    found = df.withColumn(
        "base",
        F.array_sort(
            F.concat(
                F.when(named, _placed(text, ASSIGN, "assign", lambda m, g: F.length(g) >= ASSIGN_LEAST, 2)).otherwise(_none()),
                F.when(text.contains("AKIA"), _placed(text, long_key, "access", always)).otherwise(_none()),
                F.when(text.rlike(long_hex), _placed(text, long_hex, "hex", always)).otherwise(_none()),
            )
        ),
    ).withColumn("candidates", F.when(text.rlike(CANDIDATE), _placed(text, CANDIDATE, "entropy", is_random)).otherwise(_none()))
    new = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.withColumn("spans", F.array_sort(F.concat("base", new)))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """text with MASK in place of each group of overlapping spans, which are in order of their starts.

    Spans are taken in blocks of about the root of their number.  A block cuts its own piece out of the text once, and
    its spans cut theirs out of that piece, so neither the text nor what is made of it is copied for each span.
    """
    block = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(spans))).cast("int"))
    of_block = lambda k: F.slice(spans, k * block + 1, block)
    numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / block).cast("int"))
    further = lambda at, s: F.greatest(at, s["end"])
    ends = F.transform(numbers, lambda k: F.aggregate(of_block(k), F.lit(0), further))
    starts = F.aggregate(ends, F.array(F.lit(0)), lambda acc, end: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), end))))

    def with_starts(x: Column) -> Column:
        starts = x["starts"]

        def opened(k: Column) -> Column:
            low, high = F.get(starts, k), F.get(starts, k + 1)
            return F.struct(low.alias("low"), F.substring(text, low + 1, high - low).alias("piece"), of_block(k).alias("spans"))

        return F.concat(F.array_join(F.transform(F.transform(numbers, opened), cut), ""), F.substring(text, F.element_at(starts, -1) + 1, F.length(text)))

    def cut(x: Column) -> Column:
        def merge(acc: Column, s: Column) -> Column:
            before = F.substring(x["piece"], acc["at"] - x["low"] + 1, s["start"] - acc["at"])
            out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(before, F.lit(MASK))))
            return F.struct(further(acc["at"], s).alias("at"), out.alias("out"))

        start = F.struct(x["low"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(x["spans"], start, merge, lambda acc: F.array_join(acc["out"], ""))

    return F.transform(F.array(F.struct(starts.alias("starts"))), with_starts)[0]


def redact(docs: DataFrame) -> DataFrame:
    """The same columns and rows, however columns are named; every span of a text is replaced by MASK, and n_chars follows.

    Null texts stay null.  A text without a span keeps its n_chars, whatever that says.  Rows that repeat are masked alike.
    """
    columns = docs.columns
    found = _scanned(docs.select(F.struct(*(c.alias(name) for c, name in zip(own_columns(docs), columns, strict=True))).alias("_doc"), F.coalesce("text", F.lit("")).alias("text")))
    own = lambda name: F.col("_doc").getField(name)
    none = F.size("spans") == 0
    cleaned = found.withColumn("_clean", F.when(none, own("text")).otherwise(_masked(F.col("text"), F.col("spans"))))
    new = {"text": F.col("_clean")} | ({"n_chars": F.when(none, own("n_chars")).otherwise(F.length("_clean").cast("bigint"))} if "n_chars" in columns else {})
    return cleaned.select(*(new.get(c, own(c)).alias(c) for c in columns))
