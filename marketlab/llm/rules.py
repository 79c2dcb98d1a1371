"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a ratio of text counts and a fixed grid of cutoffs from lenient to
strict. On labelled documents, per stratum (language), the number of good
documents a cutoff would reject is compared with the exact binomial bound: the
cutoff is safe if so few rejections would be seen with probability at most
``delta / (strata * rules)`` were the true false-rejection rate ``alpha / rules``.
Bonferroni covers strata and rules; inside a grid the cutoffs are tested in
order and testing stops at the first that is not safe, which needs no further
correction. Without enough labels a stratum gets no cutoff and loses nothing.

Defined results: null text has no words and fails the base rule; null language
is a stratum of its own; labels without a document, null labels and repeated
labels of one id (the highest counts once) are harmless; no labels, no cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.session import materialise

ALPHA = 0.05
DELTA = 0.05
SYMBOLS = "#*$%&|<>"
#: Rules as (name, numerator, denominator, cutoffs from lenient to strict).
RULES: tuple[tuple[str, str, str, tuple[float, ...]], ...] = (
    ("symbols", "n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    ("marks", "n_marks", "n_words", (2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    ("repeats", "n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1)),
    ("lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """Counts of every whole text; no row meets another."""
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = d.withColumns({"_w": F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda x: x != ""), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    d = d.withColumns({"_h": F.transform("_w", lambda x: F.xxhash64(x)), "_n": F.size("_w")})
    gram = lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i"))
    d = d.withColumn("_g", F.when(F.col("_n") > 2, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - 3), gram))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda x, j: F.coalesce(F.get("_g", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_g", j + 1)["h"] == x["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("_g", same), lambda x: x["i"]))
    start = F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n"))
    repeat = F.aggregate(again, start, lambda s, i: F.struct(i.alias("p"), (s["n"] + F.least(F.lit(3), i - s["p"])).alias("n")), lambda s: s["n"])
    gone = lambda chars: (F.char_length("_t") - F.char_length(F.translate("_t", chars, ""))).cast("long")
    return d.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        gone(SYMBOLS).alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        gone("!?").alias("n_marks"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _lgamma(x: Column) -> Column:
    """Log gamma for x >= 1 by Stirling's series after a shift of eight."""
    y = x + F.lit(8.0)
    shift = sum((F.log(x + F.lit(float(i))) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed downwards from k.

    Below the mean the terms fall at least geometrically times exp(-j^2 / 2np),
    so 50 + 10 sqrt(n) of them hold all but 1e-16; at or above it the result
    is only used as "not small" and 1 is returned.
    """
    kd, nd = k.cast("double"), n.cast("double")
    log_top = _lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1) + kd * F.lit(_ln(p)) + (nd - kd) * F.lit(_ln(1 - p))
    steps = F.least(k, F.ceil(50 + 10 * F.sqrt(nd))).cast("int")
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def down(s: Column, j: Column) -> Column:
        i = kd - j + 1
        t = s["t"] * i / (nd - i + 1) * F.lit((1 - p) / p)
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    total = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), one, down, lambda s: s["s"])).otherwise(F.lit(1.0))
    return F.when(kd >= nd * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def _ln(x: float) -> float:
    import math

    return math.log(x)


def ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1)).cast("double")


def cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum: n_good, and the chosen cutoff of each rule (null: none is safe)."""
    lab = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    good = counted.where(~F.col("base_failed")).join(lab, F.col("doc_id") == F.col("_id")).where(F.col("_q") == 1)
    aggs = [F.count(F.lit(1)).alias("n_good")]
    for name, top, bottom, grid in RULES:
        aggs += [F.sum(F.when(ratio(top, bottom) > c, 1).otherwise(0)).alias(f"{name}_{i}") for i, c in enumerate(grid)]
    per = good.groupBy(F.coalesce("lang", F.lit("")).alias("stratum"), F.col("lang").isNull().alias("no_lang")).agg(*aggs)
    strata = per.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_strata"))
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(i).alias("i"), F.col(f"{name}_{i}").alias("k")) for r, (name, _, _, grid) in enumerate(RULES) for i in range(len(grid))])
    one = per.crossJoin(F.broadcast(strata)).select("stratum", "no_lang", "n_good", "n_strata", F.explode(cells).alias("c"))  # strata has one row
    unsafe = binomial_tail(F.col("c.k"), F.col("n_good"), alpha / len(RULES)) > F.lit(delta) / (F.col("n_strata") * len(RULES))
    first = one.groupBy("stratum", "no_lang", "n_good", F.col("c.r").alias("r")).agg(F.min(F.when(unsafe, F.col("c.i"))).alias("first"))
    out = []
    for r, (name, _, _, grid) in enumerate(RULES):
        strictest = F.coalesce(F.col("first"), F.lit(len(grid))) - 1  # the cutoff before the first unsafe one
        out.append(F.max(F.when((F.col("r") == r) & (strictest >= 0), F.get(F.array(*[F.lit(c) for c in grid]), strictest))).alias(f"cut_{name}"))
    return first.groupBy("stratum", "no_lang", "n_good").agg(*out)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document with its counts, base_failed, the rule that rejects it, and kept."""
    counted = materialise(measures(docs))
    cuts = cutoffs(counted, labels, alpha, delta)
    d = counted.join(cuts, (F.coalesce(counted["lang"], F.lit("")) == cuts["stratum"]) & (counted["lang"].isNull() == cuts["no_lang"]), "left")
    rule = F.coalesce(*[F.when(ratio(top, bottom) > F.col(f"cut_{name}"), F.lit(name)) for name, top, bottom, _ in RULES])
    d = d.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(rule))
    names = [c for c in counted.columns if c != "lang"]
    return d.select(*names, "failed_rule", F.col("failed_rule").isNull().alias("kept"))
