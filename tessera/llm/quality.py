"""Quality rules as a bitmask ledger, in built-in functions only.

``ledger`` evaluates every rule once and stores the measurements with a bit for each failed rule. Policies are
named, versioned masks over those bits: a new policy, or the effect of leaving one rule out, never reads a text
again. Words are runs outside of ``[\\x20\\x09-\\x0D]``.

Cases: a null text has no words, an empty ledger bit only where a rule speaks of few words; very long texts are
measured whole inside their row; repeated rows give a row each; a measurement at a threshold passes; empty tables give empty results; the
ledger takes only the id and the text from its input, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "[#*$%&|<>]"

#: Rule by bit: a name and when it fails, over the struct of measurements.
RULES = (
    ("few_words", lambda m: m.n_words < 50),
    ("repeated_windows", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    ("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    ("duplicate_lines", lambda m: 10 * m.n_dup_lines > 6 * m.n_lines),
    ("word_length_low", lambda m: (m.n_words > 0) & (m.word_chars < 2 * m.n_words)),
    ("word_length_high", lambda m: m.word_chars > 20 * m.n_words),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << k for k, (name, _) in enumerate(RULES) if name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
PRODUCTION = Policy("production", 1, tuple(name for name, _ in RULES))
POLICIES = (BASE, PRODUCTION)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more."""
    # Each window as (hash, place), sorted, so that equal windows are neighbours.
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def places(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, k: (x.h == F.get(ordered, k - 1).h) | (x.h == F.get(ordered, k + 1).h))
        return F.sort_array(F.transform(again, lambda x: x.i))

    # A window covers three words, less what the one before covers already.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(let(F.sort_array(windows), places), start, lambda a, p: F.struct((a.n + F.least(F.lit(3), p - a.last)).alias("n"), p.alias("last")), lambda a: a.n)


def failed_bits(m: Column) -> Column:
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measures(text: Column) -> Column:
    """A struct of the measurements and ``failed``."""
    body = F.coalesce(text, F.lit(""))
    raw = F.struct(
        F.array_remove(F.split(body, f"{SPACE}+"), "").alias("words"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"),
        F.length(F.regexp_replace(body, f"{SPACE}+", "")).alias("solid"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).alias("symbols"),
    )
    counts = let(raw, lambda r: F.struct(
        F.size(r.words).cast("long").alias("n_words"),
        r.solid.cast("long").alias("word_chars"),
        r.symbols.cast("long").alias("n_symbols"),
        F.size(r.lines).cast("long").alias("n_lines"),
        (F.size(r.lines) - F.size(F.array_distinct(r.lines))).cast("long").alias("n_dup_lines"),
        let(r.words, covered).alias("n_repeat_words"),
    ))
    return let(counts, lambda m: F.struct(*[m[n].alias(n) for n in MEASURES], failed_bits(m).alias("failed")))


def ledger(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failed``, a bit for each failed rule."""
    rows = docs.select(F.col(doc_id).alias("_id"), measures(F.col(text)).alias("_m"))
    return rows.select(F.col("_id").alias(doc_id), "_m.*")


def passes(policy: Policy, failed: Column | None = None) -> Column:
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policies(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a verdict column ``<name>_v<version>`` for each policy."""
    return entries.withColumns({f"{p.name}_v{p.version}": passes(p) for p in policies})


def ablations(entries: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """By rule of the policy: documents that fail it, and those kept if it alone were left out. Aggregates over bit patterns, of which there are at most 2 ** rules."""
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(k, name) for k, (name, _) in enumerate(RULES) if name in policy.rules]
    sums = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(F.col("bits") == (1 << k), F.col("n"))), F.lit(0)).alias("n_only"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs")) for k, name in rules]
    return patterns.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def keep(docs: DataFrame, *, text: str = "text", policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that pass the policy, all their columns as they were. Each text is measured once, as the documents are read; no ledger is written."""
    return docs.where(passes(policy, measures(F.col(text)).getField("failed")))
