"""Quality rules as a bitmask ledger: measure once, store failure bits, apply versioned policies, compute ablations.

``measured`` reads every whole text once. ``ledger`` adds ``fail_bits``, one bit per rule, so a policy is a mask
(``fail_bits & mask``) and neither policies nor ablations touch a text again.

Defined cases: a null text has no words and fails ``too_short``; an empty one likewise. Repeated rows are
measured each by itself. Null ids stay null. An empty table gives an empty ledger. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, text_bytes

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_exclaimed", "n_distinct")
#: Words end at these bytes only.
BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements, stored in bit ``bit`` of the ledger."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_short", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("shouting", 3, "10 * n_shouted > 3 * n_words"),
    Rule("exclaiming", 4, "10 * n_exclaimed > n_words"),
    Rule("repeated_lines", 5, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 6, "word_chars > 12 * n_words or word_chars < 2 * n_words"),
    # Longer texts repeat their function words, so the share says less there.
    Rule("low_variety", 7, "n_words <= 100 and 2 * n_distinct <= n_words"),
)
#: Versions of the policy: which rules reject a document.
POLICIES: Mapping[str, Sequence[str]] = {
    "base": ("too_short", "repeated_windows"),
    "v1": ("too_short", "repeated_windows", "symbols"),
    "v2": ("too_short", "repeated_windows", "symbols", "shouting", "exclaiming", "repeated_lines", "word_length", "low_variety"),
}


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    # Windows are numbered exactly: a run of k + 1 words is the pair (number of its first k, next word).
    run, top = ids, len(seen)
    for k in range(1, window):
        run, keys = run[:-1] * len(seen) + ids[k:], top * len(seen)
        if keys < 2**62 // max(1, len(seen)) and k < window - 1:
            top = keys
        else:
            _, run = np.unique(run, return_inverse=True)
            top = int(run.max()) + 1
    twice = np.bincount(run)[run] > 1
    edge = np.zeros(n + 1, np.int64)
    edge[:len(twice)] += twice
    edge[window:window + len(twice)] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.split()  # bytes.split() breaks at exactly BREAKS
    lines, dup, filled = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            filled += 1
            if line in lines:
                dup += 1
            lines.add(line)
    continuation = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    breaks = len(text) - len(text.translate(None, BREAKS))
    return (
        len(words), len(text) - continuation - breaks, len(text) - len(text.translate(None, SYMBOLS)), dup, repeated_words(words), filled,
        sum(map(bytes.isupper, words)), sum(map(bytes.endswith, words, repeat(b"!"))), len(set(words)),
    )


def _with_measures(docs: DataFrame, text_col: str) -> DataFrame:
    """Whole rows as a struct ``row``, so that no name can clash, with their measurements."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values = np.array([measure(t) for t in text_bytes(batch)], np.int64).reshape(batch.num_rows, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(len(MEASURES)))], ["row", *MEASURES])

    return arrow_map(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        values = np.array([measure(t) for t in text_bytes(batch)], np.int64).reshape(batch.num_rows, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, _measure_batches, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def filtered(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns, in one pass over the texts."""
    rows = _with_measures(docs, text_col)
    return ledger(rows).where(~_base() & passes(policy)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def ledger(measures: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measurements with ``fail_bits``: bit ``rule.bit`` is set where the rule fails."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measures.withColumn("fail_bits", bits)


def policy_mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    by_name = {rule.name: rule.bit for rule in rules}
    return sum({1 << by_name[name] for name in names})


def passes(policy: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy fails, from ``fail_bits`` alone."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policies[policy], rules)).cast("long")) == 0


def _base() -> Column:
    return ~passes("base")


def ablations(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: rows failing it, rejected by it alone, and kept if it were dropped.

    Failure bits are grouped first (at most 2^rules rows, combined before the shuffle); masks do the rest.
    """
    names = {rule.name: rule.bit for rule in rules}
    terms = [(p, r, policy_mask(chosen, rules), 1 << names[r]) for p, chosen in policies.items() for r in chosen]
    grid = rows.sparkSession.createDataFrame(terms, "policy string, rule string, mask long, bit long")
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias

    # At most 2^rules patterns against the handful of (policy, rule) terms.
    return patterns.join(F.broadcast(grid), F.lit(True)).groupBy("policy", "rule").agg(
        total(hit.bitwiseAND(F.col("bit")) != 0)("failed"),
        total(hit == F.col("bit"))("failed_alone"),
        total(hit == 0)("kept"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0)("kept_without_rule"),
    )


def judged(docs: DataFrame, policy: str = "v2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of ``docs`` with ``base_failed`` and the policy's ``kept``."""
    rows = ledger(measured(docs, id_col, text_col))
    return rows.withColumn("base_failed", _base()).withColumn("kept", ~_base() & passes(policy))
