"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``quality_ledger`` evaluates every rule once over whole texts and stores one row per document:
the measurements and ``failures``, in which bit k says that rule k failed. Policies are named
masks, so applying a new version, or asking what a rule alone rejects, is a bitwise test on
the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Rules by bit, each true where a document fails. The first two are the base rules.
RULES: dict[str, Callable[[Column], Column]] = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_words": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "shouting": lambda m: 100 * m["n_upper"] > 50 * m["word_chars"],
    "exclamations": lambda m: 100 * m["n_exclamations"] > 30 * m["n_words"],
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of the rules to apply: a document that fails any of them is rejected."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = (
    Policy("v1-base", BASE),
    Policy("v2-symbols", (*BASE, "symbols", "repeated_lines")),
    Policy("v3-full", tuple(RULES)),
)
CURRENT = POLICIES[-1]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words inside windows of three that the text has twice or more.

    Windows are sorted by a hash; neighbours are twins if their hashes and then their words are equal.
    """
    last = F.size(words) - WINDOW

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), i.alias("i"))

    def again(found: Column) -> Column:
        def twin(e: Column, at: Column) -> Column:
            def same(other: Column) -> Column:
                equal = other["h"] == e["h"]
                for k in range(WINDOW):
                    equal &= F.get(words, other["i"] + k) == F.get(words, e["i"] + k)
                return F.coalesce(equal, F.lit(False))

            return same(F.get(found, at - 1)) | same(F.get(found, at + 1))

        return F.sort_array(F.transform(F.filter(found, twin), lambda e: e["i"]))

    def widen(state: Column, i: Column) -> Column:
        return F.struct(i.alias("at"), (state["n"] + F.least(F.lit(WINDOW), i - state["at"])).alias("n"))

    found = F.sort_array(F.transform(F.sequence(F.lit(0), last), window))
    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(_let(found, again), start, widen, lambda s: s["n"])
    return F.when(last >= 1, covered).otherwise(0)


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _row(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: expressions and filters on it never repeat its work."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_ledger(docs: DataFrame) -> DataFrame:
    """Two structs a row of ``docs``: ``row``, as it is, and ``ledger``. No name of a column can clash."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    split = _row(rows, "split", F.struct(F.filter(F.split("text", BLANK), lambda w: w != "").alias("words"), lines.alias("lines")))
    words, lines = F.col("split.words"), F.col("split.lines")
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")),
        "n_symbols": _without(F.col("text"), SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated_words(words),
        "n_upper": F.regexp_count("text", F.lit(r"\p{Lu}")),
        "n_exclamations": _without(F.col("text"), "!"),
    }
    measured = _row(split, "m", F.struct(*(m.cast("long").alias(name) for name, m in measures.items())))
    bits = [F.when(rule(F.col("m")), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    ledger = F.struct(*(F.col(f"m.{name}") for name in measures), sum(bits[1:], bits[0]).cast("long").alias("failures"))
    return measured.select("row", ledger.alias("ledger"))


def quality_ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failed rules of each document (doc_id, text): one row a row.

    Null and empty texts have no words, so they fail ``few_words``. Repeated rows and null
    doc_ids are measured like any other; other columns are not looked at.
    """
    return _with_ledger(docs.select("doc_id", "text")).select("row.doc_id", "ledger.*")


def passing(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and ``policy``, with their own columns, whatever their names."""
    passed = ~fails(Policy("base", BASE), "ledger.failures") & ~fails(policy, "ledger.failures")
    return _with_ledger(docs).where(passed).select("row.*")


def fails(policy: Policy, failures: str = "failures", without: str | None = None) -> Column:
    """Whether a ledger row fails ``policy``, with one rule left out if named."""
    mask = policy.mask & ~(1 << list(RULES).index(without) if without else 0)
    return F.col(failures).bitwiseAND(F.lit(mask)) != 0


def apply_policies(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a verdict per policy version, in a map column ``kept``."""
    pairs = [x for p in policies for x in (F.lit(p.version), ~fails(p))]
    return ledger.withColumn("kept", F.create_map(*pairs))


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that it alone rejects, and that pass without it.

    Failure patterns are counted first, so what is tested bit by bit is at most 2^rules rows.
    """
    patterns = ledger.groupBy("failures").agg(F.count("*").alias("n"))
    cells: Mapping[tuple[str, str], Column] = {
        (p.version, r): F.struct(
            F.lit(p.version).alias("version"),
            F.lit(r).alias("rule"),
            _total(F.col("failures").bitwiseAND(F.lit(1 << list(RULES).index(r))) != 0).alias("failing"),
            _total(fails(p) & ~fails(p, without=r)).alias("rejected_alone"),
            _total(~fails(p, without=r)).alias("kept_without"),
        )
        for p in policies
        for r in p.rules
    }
    return patterns.agg(F.array(*cells.values()).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def quality_digest(ledger: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """doc_id, the contract's measurements, base_failed and the verdict of ``policy``."""
    base = Policy("base", BASE)
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(base).alias("base_failed"), (~fails(base) & ~fails(policy)).alias("kept"),
    )
