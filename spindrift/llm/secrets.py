"""Secret scanning in SQL functions: patterns, and sliding-window entropy over candidate strings.

No row leaves its task and nothing is exploded: a text's spans are worked out in
one projection.

Base spans come from three patterns.  Besides, every candidate, a run of 20 or
more characters of keys and encodings, is read once with a window of WINDOW
characters.  The window's entropy is log2(WINDOW) - sum(n log2 n) / WINDOW over
the counts n of its characters; as it moves by one, only the counts of the
character that enters and the one that leaves change, and with them the sum.  A
candidate whose highest window reaches the limit of its character class is a
span, unless an allow-list pattern holds for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import boxed, read, unboxed
from .spans_sql import let, split_matches, with_starts

#: The contract's patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
#: Character classes, the first that holds counts, and the entropy in bits from which a window tells.
CLASSES = ((r"^[0-9]+$", 99.0), (r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.6), (r"^(?=.*[0-9])(?=.*[A-Za-z]).+$", 3.75))
#: What is no secret though it looks random: UUIDs, integrity digests, placeholders.
ALLOWED = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^sha(1|256|384|512)-", r"(?i)example|placeholder|x{8}|0123456789abcdef|abcdefghijklmnop")

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of an ASCII text at least as long as one."""
    bits = (window + 1).bit_length()
    each = 63 // bits
    terms = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    codes = F.transform(F.split(text, ""), F.ascii)
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-128 // each)).alias("n"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))
    # for each code the number that holds its count, and the count's unit in it
    place = F.array(*(F.lit(c // each) for c in range(128)))
    unit = F.array(*(F.lit(1 << bits * (c % each)).cast("long") for c in range(128)))

    def count(n: Column, code: Column) -> Column:
        return (F.get(n, F.get(place, code)) / F.get(unit, code)).cast("long") % (1 << bits)

    def moved(chars: Column, acc: Column, i: Column) -> Column:
        enters = F.get(chars, i)
        leaves = F.when(i >= window, F.get(chars, i - window)).otherwise(F.lit(-1))

        def change(p: Column) -> Column:
            n_in, n_out = p["n_in"].cast("int"), p["n_out"].cast("int")
            return F.get(terms, n_in + 1) - F.get(terms, n_in) + F.when(leaves >= 0, F.get(terms, n_out - 1) - F.get(terms, n_out)).otherwise(0.0)

        both = F.struct(count(acc["n"], enters).alias("n_in"), count(acc["n"], leaves).alias("n_out"))
        now = F.when(enters == leaves, acc["sum"]).otherwise(acc["sum"] + let(both, change))
        at_in, at_out = F.get(place, enters), F.get(place, leaves)
        counts = F.transform(acc["n"], lambda n, c: n + F.when(c == at_in, F.get(unit, enters)).otherwise(0) - F.when(c == at_out, F.get(unit, leaves)).otherwise(0))
        return let(F.struct(counts.alias("n"), now.alias("sum")), lambda s: F.struct(s["n"].alias("n"), s["sum"].alias("sum"), F.when(i >= window - 1, F.least(acc["least"], s["sum"])).otherwise(acc["least"]).alias("least")))

    least = let(codes, lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), zero, lambda a, i: moved(c, a, i), lambda a: a["least"]))
    return F.lit(math.log2(window)) - least / window


def is_random(candidate: Column, classes=CLASSES, allowed=ALLOWED, window: int = WINDOW) -> Column:
    limit = F.lit(99.0)
    for pattern, bits in reversed(classes):
        limit = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(limit)
    known = F.lit(False)
    for pattern in allowed:
        known = known | candidate.rlike(pattern)
    return let(limit, lambda x: F.when((x < math.log2(window)) & ~known, window_entropy(candidate, window) >= x).otherwise(F.lit(False)))


def _spans(found: Column, kind: str, kept=None) -> Column:
    """Spans of the matches for which `kept(found, i)` holds."""
    code = F.lit(KINDS.index(kind))

    def each(f: Column, i: Column, start: Column) -> Column:
        span = F.struct(start.alias("start"), code.alias("kind"), (start + F.length(F.get(f["m"], i))).cast("int").alias("stop"))
        return F.when(kept(f, i), span) if kept else span

    spans = let(found, lambda f: F.when(f.isNotNull(), F.filter(with_starts(f, each), F.isnotnull)))
    return F.coalesce(spans, F.array()).cast(SPAN)


def find_secrets(docs: DataFrame, classes=CLASSES, allowed=ALLOWED, window: int = WINDOW) -> DataFrame:
    """`docs` with `base` and `found`: base spans and all spans, each by start, then kind; columns so named give way."""
    text = F.col("text")
    assign = _spans(split_matches(text, ASSIGN, value=2), "assign", lambda f, i: F.length(F.get(f["value"], i)) >= LEAST_VALUE)
    base = F.array_sort(F.concat(assign, _spans(split_matches(text, ACCESS), "access"), _spans(split_matches(text, HEX), "hex")))
    extra = _spans(split_matches(text, CANDIDATE), "entropy", lambda f, i: is_random(F.get(f["m"], i), classes, allowed, window))
    rest = [c for c in docs.columns if c.lower() not in ("base", "found")]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = held.withColumns({"base": base, "extra": extra}).withColumn("found", F.array_sort(F.concat("base", "extra")))
    return held.select(*(F.col("row").getField(c).alias(c) for c in rest), "base", "found")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span replaced by the mark, spans that touch or overlap by one; n_chars, if there is one, follows the text."""
    found = find_secrets(boxed(docs))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(text: Column, acc: Column, s: Column) -> Column:
        before = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    text = F.col("text")
    new = F.aggregate("found", begin, lambda a, s: step(text, a, s), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    changed = F.size("found") > 0
    held = found.withColumn("redacted", F.when(changed, new).otherwise(text))
    values = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unboxed(held, docs, **values)


def span_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document.

    A null or empty text has none and an empty list of spans; a very long text,
    or candidate, counts whole; repeated rows give repeated rows; an empty table
    gives no rows; further columns are not read.
    """
    found = find_secrets(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["kind"] == 3)).cast("long").alias("n_entropy"))
