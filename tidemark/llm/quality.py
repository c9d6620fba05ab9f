"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one
bit per failed rule, so policies (sets of rules, versioned) and ablations (what leaving a
rule out would change) are integer operations on the ledger; the text is never read again.

Everything stays inside one row: no shuffle, no Python. Null text counts as empty
(no words, base rule fails); repeated rows give repeated ledger rows; an empty table
gives an empty ledger; other columns of the input pass through untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, text_of, whole_row

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_stutter")

#: name -> the condition under which a document fails, over the measurements. Position = bit.
RULES: dict[str, Column | object] = {
    "too_few_words": lambda: F.col("n_words") < 20,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbols_per_word": lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words"),
    "duplicate_lines": lambda: (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    "stuttering": lambda: 100 * F.col("n_stutter") > 30 * F.col("n_words"),
    "shouting": lambda: 100 * F.col("n_upper") > 40 * F.col("n_letters"),
    "marks_per_word": lambda: 100 * F.col("n_marks") > 50 * F.col("n_words"),
    "few_letters": lambda: 100 * F.col("n_letters") < 50 * F.col("word_chars"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words")),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("too_few_words", "repeated_windows")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols_per_word", "duplicate_lines", "stuttering", "shouting", "marks_per_word", "few_letters"),
    "v2": (*BASE, "symbols_per_word", "duplicate_lines", "stuttering", "shouting", "marks_per_word", "few_letters", "word_length"),
}
DEFAULT_POLICY = "v2"


def mask(policy: str) -> int:
    return reduce(lambda m, name: m | BIT[name], POLICIES[policy], 0)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more.

    Window hashes are sorted with their positions; equal neighbours are compared word
    by word, so that a hash collision can't make a repeat.
    """
    at = lambda i: F.slice(words, i + 1, WINDOW)
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), lambda _, i: F.xxhash64(at(i)))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (at(a["i"]) == at(b["i"])), F.lit(False))

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, positions), covered))

    return let(hashes, of).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the MEASURES columns, all long."""
    body = text_of(text)
    left = lambda pattern: F.char_length(F.regexp_replace(body, pattern, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    both = let(F.array_remove(F.split(body, SPACE), ""), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("s")))
    both_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    out = docs.withColumns({"_w": both, "_l": both_lines})
    values = {
        "n_words": F.col("_w")["n"],
        "word_chars": left(SPACE),
        "n_symbols": F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.col("_l")["d"],
        "n_repeat_words": F.col("_w")["r"],
        "n_lines": F.col("_l")["n"],
        "n_stutter": F.col("_w")["s"],
        "n_letters": F.char_length(F.regexp_replace(body, r"[^\p{L}]+", "")),
        "n_upper": F.char_length(F.regexp_replace(body, r"[^\p{Lu}]+", "")),
        "n_marks": F.char_length(F.regexp_replace(body, r"[^!?#*$%&|<>~^{}\\\[\]]+", "")),
    }
    return out.withColumns({k: v.cast("long") for k, v in values.items()}).drop("_w", "_l")


def _with_bits(book: DataFrame) -> DataFrame:
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(rule(), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()))
    return book.withColumn("fail_bits", bits.cast("long"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, the measurements and ``fail_bits``."""
    return _with_bits(measured(docs.select(*keep, F.col(text).alias("_text")), "_text").drop("_text"))


def _fails(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))


def apply_policy(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed``, ``kept`` and ``lone_bit``: that of the rule without which the document would be kept, 0 for none."""
    hit = _fails(policy).bitwiseOR(_fails("base"))
    return book.withColumns({"base_failed": _fails("base") != 0, "kept": hit == 0, "lone_bit": F.when(F.bit_count(hit) == 1, hit).otherwise(F.lit(0).cast("long"))})


def ablations(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy, from the ledger: n_docs, ``failed``, ``decided_alone`` (kept without the rule), and two
    bitwise aggregates over the documents that fail it: ``ever_with`` and ``always_with``, the bits that any, and
    that all of them have.

    Documents are counted per pattern of bits first, of which there are at most 2 to the
    number of rules, whatever the corpus.
    """
    patterns = book.groupBy(_fails(policy).alias("bits")).agg(F.count("*").alias("n"))
    n_docs = F.sum("n")
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy])))
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    out = patterns.select("bits", "n", rules.alias("r")).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("decided_alone"),
        F.bit_or(F.when(has, F.col("bits"))).alias("ever_with"), F.bit_and(F.when(has, F.col("bits"))).alias("always_with"), n_docs.alias("n_docs"),
    )
    return out.select(F.lit(policy).alias("policy"), "*")


def filter_documents(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The documents that the policy keeps by their ledger, with their own columns only."""
    book = _with_bits(measured(docs.select(whole_row(docs).alias("_doc"), F.col("text").alias("_text")), "_text").drop("_text"))
    # a row number keeps the filter above the ledger: pushed below, it would evaluate each measurement once per use
    book = book.withColumn("_row", F.monotonically_increasing_id())
    return book.filter((_fails(policy).bitwiseOR(_fails("base")) == 0) & (F.col("_row") >= 0)).select("_doc.*")
