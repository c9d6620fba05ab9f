"""Secret scan: fixed patterns, and a battery of randomness tests for what they miss.

Patterns give spans of key assignments, access keys and long hex runs. Further candidates
are long runs of key characters, or what is left of them outside those spans. For each,
the narrowest encoding that holds it is inferred, and three tests ask whether it looks
random in that encoding: chi-squared of the alphabet's use, the number of runs of
character classes, and the serial correlation of neighbours. A candidate that passes gets
a p-value under the hypothesis that it is written language (which letters follow each
other or how evenly they are used, how often classes change, at its length), and
Benjamini-Hochberg within length strata over all candidates of the corpus decides. Runs
of decimal digits alone are numbers and get no p-value.

All of it is column expressions on single rows; only counts per stratum and p-value step
are aggregated (a table of fixed size), and at most one threshold per stratum reaches the
driver. Texts never shuffle. Null text is empty and has no spans; repeated rows are
scanned alike; an empty table gives no thresholds and no rows; other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, text_of

#: Fixed patterns of the base scan, in order of kind.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}+"
STRATA = (20, 28, 40, 64)
STEPS = 400
FDR = 0.001
#: Standard deviations beyond which a test rejects randomness.
REJECT = 4.0
#: Written language: chance that two letters agree, its spread, and how often character classes change.
TEXT_MATCH, TEXT_TRIPLE, TEXT_CHANGE = 0.065, 0.0013, 0.15
#: Chance that a letter of language is one of a-f (hex), and that a digit is none of 0, 1, 8, 9 (base 32).
TEXT_HEX, TEXT_DIGIT = 0.3, 0.5
#: Row a, column b: evidence against language of letter b after a, in fifths of a nat, from "q" = 0; the log of
#: 1/26 over its share among the pairs of the words of ``byte_bpe_multi_50k.tiktoken`` (weight 1 / rank), of which a tenth is spread evenly.
PAIRS = (
    "zrnp{wrwqzskpj{q{knkrtwzqx kv{zh|{|lx|jz{k||lpwly||v| l|t{k||jn|oq||i|{oxlq|||vz l{ztf{vziz|uxvl{|pozovz|qz"
    "nxpmruuyu{ynqjxtyikoxsvsvz k||{jl{|i||o||i||mzom|||w| m{|{g|sjm|{qypm{|krvo|||u| iz{zg||zj||wxuj||qwnr|z|s|"
    "qumpnsq{{zwoqgmuzqmmzq|y{v i{{yg|{|r{u{|wh|||x|h{|||| l{{{fyyyh|yr|opz|umss|y|t| kzyphvy{j|vjx{lx|zrqqxz|l|"
    "ip{|gz||k||{ozkl|{s{p|||v| o{okluiyoztxzsp{{{miuv{|uz wusqxvtyt{tnmhqq|joplspzw{ k{{zi{{qo||lz|kn|isqp|||x|"
    "{|||||||w||z||||||||a||||| kytqgxu{k|tvrrlx{snnsvz|qz o{p{iy{nl|vuvxnpy{lho|x|vz l{v|h{|ji||tyzn{|mopp|w|qz"
    "qrpqovpzq{ymokzr|jjl{z|zxz l|||c|||h||{||m||y||y|||y| h{{xi{|jj|{w|oj||sqzz|y|x| kzl|mz|sk||{{|wg|||it|{|u|"
    "oqruizx{n{{qpqip|vjpu|u||z j|xyf|{vj||u{wn{{z|so|u|mo"
).replace(" ", "")


def _located(text: Column, pattern: str, body) -> Column:
    """``body(match, start, end, k)`` of every match; offsets in code points, end exclusive.

    Splitting by the pattern and extracting it give gaps and matches in turn, and their
    lengths add up to the offsets.
    """
    pair = F.struct(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def walk(p: Column) -> Column:
        sizes = F.transform(p["hit"], lambda m, k: F.struct((F.char_length(F.get(p["gap"], k))).alias("gap"), F.char_length(m).alias("n")))
        zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))
        step = lambda acc, x: F.struct(
            (acc["end"] + x["gap"] + x["n"]).alias("end"),
            F.concat(acc["all"], F.array(F.struct((acc["end"] + x["gap"]).alias("start"), (acc["end"] + x["gap"] + x["n"]).alias("end")))).alias("all"),
        )
        places = F.aggregate(sizes, zero, step, lambda acc: acc["all"])
        return let(places, lambda at: F.transform(p["hit"], lambda m, k: body(m, F.get(at, k)["start"], F.get(at, k)["end"], k)))

    return let(pair, walk)


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then kind."""
    none = F.array().cast(SPANS)
    values = lambda t: F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))
    long_enough = let(values(text), lambda v: F.filter(_located(text, ASSIGN, lambda m, s, e, k: F.struct(s.alias("start"), F.lit(0).alias("kind"), e.alias("end"), F.char_length(F.get(v, k)).alias("n"))), lambda x: x["n"] >= 6))
    parts = [
        F.when(F.rlike(text, F.lit(ASSIGN)), F.transform(long_enough, lambda x: _span(0, x["start"], x["end"]))).otherwise(none),
        F.when(F.rlike(text, F.lit(ACCESS)), _located(text, ACCESS, lambda m, s, e, k: _span(1, s, e))).otherwise(none),
        F.when(F.rlike(text, F.lit(HEX)), _located(text, HEX, lambda m, s, e, k: _span(2, s, e))).otherwise(none),
    ]
    return F.array_sort(F.concat(*parts))


def _moments(s: Column) -> Column:
    """Of a string: sums for the serial correlation, the sum of squared character counts, and the evidence of its letter pairs in nats."""
    table = F.lit([(ord(c) - ord("q")) / 5 for c in PAIRS])
    letters = F.transform(F.split(F.lower(s), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - ord("a")))
    pairs = F.aggregate(
        letters, F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.coalesce(F.get(table, 26 * a["last"] + x), F.lit(0.0))).alias("sum")), lambda a: a["sum"],
    )

    def of(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
        zero = F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("uu"), F.lit(0.0).alias("uv"), F.lit(None).cast("double").alias("last"))
        serial = F.aggregate(codes, zero, lambda a, x: F.struct((a["u"] + x).alias("u"), (a["uu"] + x * x).alias("uu"), (a["uv"] + F.coalesce(a["last"] * x, F.lit(0.0))).alias("uv"), x.alias("last")))
        counts = F.aggregate(
            F.array_sort(chars),
            F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sq")),
            lambda a, x: let(F.when(a["c"] == x, a["run"] + 1.0).otherwise(F.lit(1.0)), lambda run: F.struct(x.alias("c"), run.alias("run"), (a["sq"] + 2.0 * run - 1.0).alias("sq"))),
        )
        return F.struct(serial.alias("serial"), counts["sq"].alias("sq"), pairs.alias("pairs"), F.get(codes, F.lit(0)).alias("first"))

    return let(F.split(s, ""), of)


def alphabet(s: Column) -> Column:
    """Symbols of the narrowest encoding that holds ``s``: decimal, hex, letters of one case, base 32, base 36, letters, base 62 or base 64."""
    fits = [(10, r"^[0-9]+$"), (16, r"^(?:[0-9a-f]+|[0-9A-F]+)$"), (26, r"^(?:[a-z]+|[A-Z]+)$"), (32, r"^[A-Z2-7]+$"), (36, r"^(?:[0-9a-z]+|[0-9A-Z]+)$"), (52, r"^[A-Za-z]+$"), (62, r"^[0-9A-Za-z]+$")]
    return reduce(lambda rest, fit: F.when(F.rlike(s, F.lit(fit[1])), F.lit(fit[0])).otherwise(rest), reversed(fits), F.lit(64)).cast("double")


def _tail(z: Column) -> Column:
    """A bound from above on the normal tail beyond ``z``."""
    return F.when(z > 0, 0.5 * F.exp(-z * z / 2)).otherwise(F.lit(1.0))


def battery(candidate: Column) -> Column:
    """The p-value of a candidate in steps of a tenth of a decade (0: not random or no evidence)."""
    s = F.regexp_replace(candidate, "=+$", "")
    core = F.regexp_replace(s, "[^0-9A-Za-z]+", "")

    def of(v: Column) -> Column:
        n, k, m, sq = v["n"], v["k"], v["m"]["serial"], v["m"]["sq"]
        chi = k / n * sq - n
        even = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
        # circular serial correlation
        uv = m["uv"] + m["last"] * v["m"]["first"]
        spread = n * m["uu"] - m["u"] * m["u"]
        serial = F.when(spread > 0, (n * uv - m["u"] * m["u"]) / spread).otherwise(F.lit(1.0))
        squares = v["lower"] * v["lower"] + v["upper"] * v["upper"] + v["digit"] * v["digit"]
        c = v["lower"] + v["upper"] + v["digit"]
        few_runs = (1 + (c * c - squares) / F.greatest(c, F.lit(1.0)) - v["runs"]) / F.sqrt(F.greatest(c, F.lit(1.0)) / 4)
        random = (even <= REJECT) & (F.abs(serial) <= REJECT / F.sqrt(n)) & (few_runs <= REJECT) & (k > 10)
        pairs, agree = n * (n - 1) / 2, (sq - n) / 2
        spread_text = F.sqrt(pairs * TEXT_MATCH * (1 - TEXT_MATCH) + n * (n - 1) * (n - 2) * TEXT_TRIPLE)
        p_even = _tail((pairs * TEXT_MATCH - agree) / spread_text)
        # narrow alphabets are hardly more even than language, but language seldom has their pairs, or keeps to their digits
        p_pairs = F.least(F.exp(-v["m"]["pairs"]), F.lit(1.0)) * F.when(k == 32, F.pow(F.lit(TEXT_DIGIT), v["digit"])).otherwise(F.lit(1.0))
        p_use = F.when(k == 16, F.pow(F.lit(TEXT_HEX), n)).otherwise(F.least(2 * F.least(p_even, p_pairs), F.lit(1.0)))  # the better of two
        changes = v["runs"] - 1
        p_runs = _tail((changes - (c - 1) * TEXT_CHANGE) / F.sqrt(F.greatest(c - 1, F.lit(1.0)) * TEXT_CHANGE * (1 - TEXT_CHANGE)))
        both = F.greatest(p_use * p_runs, F.lit(1e-300))
        product = F.least(both * (1 - F.log(both)), F.lit(1.0))  # of two p-values
        # one class has no changes to ask about
        p = F.when(squares == c * c, F.greatest(p_use, F.lit(1e-300))).otherwise(product)
        return F.when(random, F.least(F.floor(-10 * F.log10(p)), F.lit(STEPS))).otherwise(F.lit(0)).cast("int")

    count = lambda pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    values = F.struct(
        F.char_length(s).cast("double").alias("n"), alphabet(s).alias("k"), _moments(s).alias("m"), count("[a-z]").alias("lower"), count("[A-Z]").alias("upper"), count("[0-9]").alias("digit"),
        F.regexp_count(core, F.lit("[a-z]+|[A-Z]+|[0-9]+")).cast("double").alias("runs"),
    )
    return F.when(F.char_length(s) >= STRATA[0], let(values, of)).otherwise(F.lit(0))


def _outside(start: Column, end: Column, base: Column) -> Column:
    """The parts of start to end that no base span covers and that are long enough for a candidate."""
    near = F.filter(base, lambda b: (b["start"] < end) & (start < b["end"]))
    part = lambda a, to: F.when(to > a["at"], F.concat(a["all"], F.array(F.struct(a["at"].alias("start"), to.alias("end"))))).otherwise(a["all"])
    zero = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))
    parts = F.aggregate(near, zero, lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), part(a, b["start"]).alias("all")), lambda a: part(a, end))
    return F.filter(parts, lambda x: x["end"] - x["start"] >= STRATA[0])


def candidates(text: Column, base: Column) -> Column:
    """start, end, stratum (shortest length in it) and step of each candidate; base spans, sorted, are cut out of them."""
    def one(m: Column, start: Column, end: Column, _: Column) -> Column:
        def tested(x: Column) -> Column:
            n = x["end"] - x["start"]
            part = F.substring(m, x["start"] - start + 1, n)
            # separators at a cut belong to neither side
            bare = F.regexp_replace(part, "^[=_/+-]+|[=_/+-]+$", "")
            s = F.when((n < end - start) & (F.char_length(bare) >= STRATA[0]), bare).otherwise(part)
            stratum = reduce(lambda rest, low: F.when(n >= low, F.lit(low)).otherwise(rest), STRATA, F.lit(STRATA[0]))
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum.alias("stratum"), let(s, battery).alias("step"))

        return F.transform(_outside(start, end, base), tested)

    none = F.array().cast("array<struct<start:int,end:int,stratum:int,step:int>>")
    return F.when(F.rlike(text, F.lit(CANDIDATE)), F.flatten(_located(text, CANDIDATE, one))).otherwise(none)


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Stratum -> least step that Benjamini-Hochberg accepts, over all candidates of ``found`` (column ``cands``).

    The table of counts has at most STEPS + 1 rows per stratum whatever the corpus.
    """
    steps = found.select(F.explode("cands").alias("c")).groupBy("c.stratum", "c.step").agg(F.count("*").alias("n"))
    by_step = F.array_sort(F.collect_list(F.struct("step", "n")))
    above = lambda all_, x: F.aggregate(F.filter(all_, lambda y: y["step"] >= x["step"]), F.lit(0).cast("long"), lambda a, y: a + y["n"])
    rows = steps.groupBy("stratum").agg(by_step.alias("all"), F.sum("n").alias("m"))
    passed = F.filter("all", lambda x: (x["step"] > 0) & (F.pow(F.lit(10.0), -x["step"] / 10.0) * F.col("m") <= F.lit(fdr) * above(F.col("all"), x)))
    return {r.stratum: r.least for r in rows.select("stratum", F.array_min(F.transform(passed, lambda x: x["step"])).alias("least")).collect() if r.least is not None}


def merged_spans(base: Column, cands: Column, least: dict[int, int]) -> Column:
    """Base spans and those candidates (which lie outside them) that the thresholds accept."""
    def ok(c: Column) -> Column:
        return reduce(lambda a, b: a | b, ((c["stratum"] == s) & (c["step"] >= t) for s, t in least.items()), F.lit(False))

    added = F.transform(F.filter(cands, ok), lambda c: _span(3, c["start"], c["end"]))
    return F.array_sort(F.concat(base, added))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def found_in(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, base and cands of every row."""
    both = let(base_spans(text_of(text)), lambda b: F.struct(b.alias("base"), candidates(text_of(text), b).alias("cands")))
    return docs.select(*keep, both.alias("found")).select(*keep, "found.base", "found.cands")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", fdr: float = FDR) -> DataFrame:
    """``keep``, base and spans (arrays of start, kind, end) of every row; one read of the texts."""
    found = staged(found_in(docs, keep, text), "secret-spans")
    return found.select(*keep, "base", merged_spans(F.col("base"), F.col("cands"), thresholds(found, fdr)).alias("spans"))


def redact(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; n_chars follows the text.

    Two reads of the texts, one for the thresholds and one to apply them; no shuffle of either.
    """
    text = text_of()
    least = thresholds(docs.select(let(base_spans(text), lambda b: candidates(text, b)).alias("cands")), fdr)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def rebuilt(spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        cut = lambda a, x: F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.get(names, x["kind"]))
        step = lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], cut(a, x)).otherwise(a["out"]).alias("out"))
        return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))

    spans = let(base_spans(text), lambda b: merged_spans(b, candidates(text, b), least))
    new = let(spans, lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(F.col("text")))
    out = docs.withColumn("text", new)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
