"""Quality rules as a ledger: every rule is evaluated once per document, and what it found is kept.

``ledger`` gives each document its measurements and one long, ``failures``, with bit i set where rule i fails. A policy is a
named, versioned set of rules; ``apply_policy`` needs one bitwise AND, so a new version is judged from the stored ledger
without reading a text again. ``ablations`` counts, from the distinct failure masks of a corpus, what each rule of a policy
rejects, rejects alone, and what would be kept without it.

Everything is built-in column functions: arrays are handled inside the row of the document, nothing is shuffled, and a hot
source makes no difference. Words are ``[^\\x20\\x09-\\x0D]+``.

Null and empty texts measure 0 everywhere and fail ``few_words``. Repeated rows get a row each; an empty table gives an empty
ledger (and ablations of zeros). Columns beyond the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASUREMENTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs"]

# bit i of ``failures`` is rule i; rules are appended, never reordered, so stored ledgers stay valid
RULES: list[tuple[str, Callable[[], Column]]] = [
    ("few_words", lambda: F.col("n_words") < 50),
    ("repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    ("symbol_heavy", lambda: 10 * F.col("n_symbols") > 3 * F.col("n_words")),
    ("duplicate_lines", lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    ("shouting", lambda: 100 * F.col("n_upper") > 40 * F.col("word_chars")),
    ("bangs", lambda: 10 * F.col("n_bangs") > 5 * F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    ("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
]
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbol_heavy"],
    "v2": ["few_words", "repeated_words", "symbol_heavy", "duplicate_lines", "shouting", "bangs", "short_words", "long_words"],
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _covered(grams: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more."""
    def in_order(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["g"] == F.get(s, k)["g"], F.lit(False))
        at = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(s, j)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.array_sort(F.filter(at, lambda i: i.isNotNull())), start, step, lambda acc: acc["n"])
    tagged = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(F.array_sort(tagged), in_order))


def _from_words(w: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    repeated = F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_let(grams, _covered))
    return F.struct(F.size(w).cast("long").alias("n_words"), repeated.alias("n_repeat_words"))


def _from_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failures``, for each row of (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda characters: (F.char_length(text) - F.char_length(_strip(text, characters))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: _strip(x, SPACES) != "")
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _let(words_of(text), _from_words).alias("_w"), _let(lines, _from_lines).alias("_l"),
        F.char_length(_strip(text, SPACES)).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"), count(UPPER).alias("n_upper"),
        count("!").alias("n_bangs")).select("doc_id", "_w.*", "_l.*", "word_chars", "n_symbols", "n_upper", "n_bangs")
    bits = [F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measured.select("doc_id", *MEASUREMENTS, failures.alias("failures"))


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def failed(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(entries: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    return entries.withColumn("kept", ~failed(policy))


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and documents kept by the policy and without the rule."""
    m = mask(policy)
    masks = entries.groupBy(F.col("failures").bitwiseAND(F.lit(m)).alias("f")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if m >> i & 1])
    zero = entries.sparkSession.range(1).select(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("n"))
    each = masks.unionByName(zero).select("f", "n", F.explode(rules).alias("r")).select("f", "n", "r.rule", "r.bit")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule", "bit").agg(
        total(F.col("f").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(F.col("f") == F.col("bit")).alias("failed_alone"),
        total(F.col("f") == 0).alias("kept"), total(F.col("f").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"))


def rule_overlap(entries: DataFrame, by: str) -> DataFrame:
    """Per value of a ledger column: rules that fail somewhere (OR) and everywhere (AND), as masks."""
    return entries.groupBy(by).agg(F.bit_or("failures").alias("anywhere"), F.bit_and("failures").alias("everywhere"), F.count("*").alias("n"))
