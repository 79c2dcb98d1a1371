"""Secret scans in DataFrame functions only.

Base patterns are found with a marking replacement: matches are wrapped in a
control character, the text is split there, and prefix sums of the part lengths
give code-point positions. Long candidate strings are then scanned with a
window of ``WINDOW`` characters whose Shannon entropy is kept by incremental
counts: a step adds the terms of the entering and the leaving character only,
and a prefix sum of these steps is the running entropy. Windows above the
threshold of their own character class, or of that of a whole hex or base64
candidate, merge into spans. Left out on purpose: windows that overlap a part
the allow list names, candidates it names as a whole (UUIDs, paths of short
names), and windows of letters without ``MIXED`` case, which entropy does not
tell from long words.

Defined results: null and empty texts have no spans; positions are code points;
repeated rows get equal results; text length is not bounded: prefix sums go by
blocks of blocks, and the class of a window comes from running counts of its
kinds of characters, so time is near linear in the text and in a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MARK, STAND_IN = "\x01", "\x03"
#: Fixed patterns, in the order in which their kinds are listed: (kind, pattern, least length, group measured).
PATTERNS: tuple[tuple[str, str, int, int], ...] = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    ("access", "AKIA[A-Z0-9]+", 20, 0),
    ("hex", "[0-9a-f]{24,}", 24, 0),
)
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Classes of candidates, tried in order: (name, characters match, least bits in a window). A window of
#: digits needs a digit, one of letters ``MIXED`` lower and ``MIXED`` upper ones.
CLASSES: tuple[tuple[str, str, float], ...] = (
    ("digits", "^[0-9_=-]+$", 3.0),  # ten digits alone hold at most 3.32
    ("letters", "^[A-Za-z_=-]+$", 3.9),  # 20 characters hold at most 4.32
    ("hex", "^[0-9a-fA-F]+$", 3.2),
    ("base64", "", 3.7),
)
MIXED = 3
NEVER = 9.0  # bits that no window holds
#: Allow list: candidates that look random and are not secret, and parts of candidates.
ALLOWED: tuple[str, ...] = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^(?:/[A-Za-z0-9_-]{1,16}+){2,}+/?$",  # possessive: matched in a loop, however long
)
ALLOWED_PARTS = "(?i)example|sample|placeholder|changeme|dummy|0123456789|abcdefghij|^[0-9]{4}-[0-9]{2}-[0-9]{2}"
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_sums(xs: Column, zero: Column, levels: int = 2) -> Column:
    """Exclusive prefix sums of an array: blocks of ``BLOCK``, their sums by the same rule ``levels`` deep, so near linear."""
    add = lambda part: F.aggregate(part, zero, lambda s, x: s + x)
    block = lambda v, b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
    inside = lambda own, base: F.transform(own, lambda _, j: base + add(F.slice(own, F.lit(1), j)))
    if levels == 0:
        return let(xs, lambda v: inside(v, zero))

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int"))
        bases = before_sums(F.transform(blocks, lambda b: add(block(v, b))), zero, levels - 1)
        parts = F.arrays_zip(bases.alias("base"), F.transform(blocks, lambda b: block(v, b)).alias("own"))
        return F.flatten(F.transform(parts, lambda p: inside(p["own"], p["base"])))

    return let(xs, of)


def _parts(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn (gaps first)."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def _odd(parts: Column) -> Column:
    """(text, start) of the matches."""
    pair = lambda v, at: F.filter(F.transform(v, lambda p, i: F.struct(p.alias("m"), F.get(at, i).alias("a"), (i % 2 == 1).alias("odd"))), lambda x: x["odd"])
    return let(parts, lambda v: let(before_sums(F.transform(v, lambda p: F.char_length(p)), F.lit(0)), lambda at: pair(v, at)))


def _shape(kind: int, a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), F.lit(kind).alias("k"), b.cast("int").alias("b"))


SPANS = "array<struct<a:int,k:int,b:int>>"


def _found(d: DataFrame, kind: int) -> DataFrame:
    name, pattern, least, group = PATTERNS[kind]
    d = d.withColumn("_p", F.when(F.col("_t").rlike(pattern), _parts(F.col("_t"), pattern)))
    own = F.filter(_odd(F.col("_p")), lambda x: F.char_length(F.regexp_extract(x["m"], pattern, group)) >= least)
    spans = F.transform(own, lambda x: _shape(kind, x["a"], x["a"] + F.char_length(x["m"])))
    return d.withColumn(f"_{name}", F.coalesce(F.when(F.col("_p").isNotNull(), spans), F.array().cast(SPANS))).drop("_p")


def _plog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def dense_windows(chars: Column, bits: Column, passes=None) -> Column:
    """Spans (from, to) of one candidate whose windows hold at least ``bits`` of entropy and pass (end, entropy).

    The entropy of a window is log2(w) - sum(c log2 c) / w over its character
    counts c; a step changes the counts of two characters.
    """
    w = WINDOW
    count = lambda cs, x, start, size: F.size(F.filter(F.slice(cs, start, size), lambda y: y == x))

    def step(cs: Column, x: Column, i: Column) -> Column:
        entering = let(count(cs, x, F.greatest(i - w + 2, F.lit(1)), F.least(i, F.lit(w - 1))), lambda c: _plog(c + 1) - _plog(c))
        leaving = let(count(cs, F.get(cs, i - w), F.greatest(i - w + 1, F.lit(1)), F.lit(w)), lambda c: _plog(c) - _plog(c - 1))
        return entering - F.when(i >= w, leaving).otherwise(F.lit(0.0))

    def spans(cs: Column) -> Column:
        run = before_sums(F.concat(F.transform(cs, lambda x, i: step(cs, x, i)), F.array(F.lit(0.0))), F.lit(0.0))  # run[i + 1]: after character i
        return let(run, lambda r: let(F.filter(F.sequence(F.lit(w), F.size(cs)), lambda e: dense(F.lit(_log2(w)) - F.get(r, e) / w, e)), merged))

    def dense(h: Column, e: Column) -> Column:
        return h >= bits if passes is None else (h >= bits) & passes(e, h)

    def merged(es: Column) -> Column:
        heads = F.filter(es, lambda e, k: (k == 0) | F.coalesce(e - F.get(es, k - 1) > w, F.lit(False)))
        tails = F.filter(es, lambda e, k: (k == F.size(es) - 1) | F.coalesce(F.get(es, k + 1) - e > w, F.lit(False)))
        return F.transform(F.arrays_zip(heads.alias("h"), tails.alias("t")), lambda x: F.struct((x["h"] - w).alias("f"), x["t"].alias("to")))

    return let(chars, spans)


def _log2(x: float) -> float:
    import math

    return math.log2(x)


#: What a window's packed counts hold, five bits each.
FIELDS = ("digit", "lower", "upper", "hex", "sign", "allowed")


def packed(chars: Column, allowed: Column) -> Column:
    """Per character one number with a one in the field of each class it belongs to; sums over a window keep fields apart."""
    bit = {f: 1 << (5 * k) for k, f in enumerate(FIELDS)}
    within = lambda x, a, b: (x >= a) & (x <= b)
    letter = lambda x, low, a, f, z: F.when(within(x, a, f), F.lit(bit[low] + bit["hex"])).when(within(x, a, z), F.lit(bit[low]))
    kind = lambda x: F.coalesce(F.when(within(x, "0", "9"), F.lit(bit["digit"])), letter(x, "lower", "a", "f", "z"), letter(x, "upper", "A", "F", "Z"), F.when(x.isin("+", "/"), F.lit(bit["sign"])), F.lit(0))
    return F.transform(chars, lambda x, i: (kind(x) + F.coalesce(F.get(allowed, i), F.lit(0)) * bit["allowed"]).cast("long"))


def window_bits(counts: Column) -> Column:
    """Least entropy of a window by its own class, from its packed counts; ``NEVER`` where it overlaps an allowed part."""
    of = {f: F.shiftright(counts, 5 * k).bitwiseAND(F.lit(31)) for k, f in enumerate(FIELDS)}
    digits, letters, hexes, other = (F.lit(bits) for _, _, bits in CLASSES)
    case = (
        F.when(of["allowed"] > 0, F.lit(NEVER))
        .when(of["lower"] + of["upper"] + of["sign"] == 0, F.when(of["digit"] > 0, digits).otherwise(F.lit(NEVER)))
        .when(of["digit"] + of["sign"] == 0, F.when((of["lower"] >= MIXED) & (of["upper"] >= MIXED), letters).otherwise(F.lit(NEVER)))
        .when(of["digit"] + of["hex"] == WINDOW, hexes)
    )
    return F.coalesce(case, other)


def _entropy(d: DataFrame) -> DataFrame:
    d = d.withColumn("_p", F.when(F.col("_t").rlike(CANDIDATE), _parts(F.col("_t"), CANDIDATE)))
    least = min(bits for _, _, bits in CLASSES)
    first = lambda m, says: F.coalesce(*[F.when(m.rlike(rx) if rx else F.lit(True), says(name, bits)) for name, rx, bits in CLASSES])
    some = lambda m, rx: m.rlike(f"^(?:[^{rx}]*+[{rx}]){{{MIXED}}}")
    able = lambda m: first(m, lambda name, _: {"digits": m.rlike("[0-9]"), "letters": some(m, "a-z") & some(m, "A-Z")}.get(name, F.lit(True)))
    # a whole hex or base64 candidate keeps its threshold in all windows
    whole = lambda m: first(m, lambda name, bits: F.lit(NEVER if name in ("digits", "letters") else bits))
    suspects = F.filter(_odd(F.col("_p")), lambda x: able(x["m"]) & ~F.exists(F.array(*[x["m"].rlike(rx) for rx in ALLOWED]), lambda y: y))
    none = F.array().cast("array<struct<m:string,a:int,odd:boolean>>")
    d = d.withColumn("_c", F.coalesce(F.when(F.col("_p").isNotNull(), suspects), none)).drop("_p")

    def dense(m: Column) -> Column:
        named = F.when(m.rlike(ALLOWED_PARTS), F.flatten(F.transform(_parts(m, ALLOWED_PARTS), lambda p, i: F.array_repeat(i % 2, F.char_length(p)))))
        chars = F.filter(F.split(m, ""), lambda y: y != "")

        def within(cs: Column, keep: Column, sums: Column) -> Column:
            def passes(e: Column, h: Column) -> Column:
                own = lambda n: (h >= window_bits(n)) | ((h >= keep) & (F.shiftright(n, 5 * FIELDS.index("allowed")) == 0))
                return let(F.get(sums, e) - F.get(sums, e - WINDOW), own)

            return dense_windows(cs, F.lit(least), passes)

        zero = F.lit(0).cast("long")
        own = F.struct(chars.alias("cs"), F.coalesce(named, F.array().cast("array<int>")).alias("al"))
        sums = lambda y: before_sums(F.concat(packed(y["cs"], y["al"]), F.array(zero)), zero)
        return let(own, lambda y: let(F.struct(whole(m).alias("keep"), sums(y).alias("sums")), lambda x: within(y["cs"], x["keep"], x["sums"])))

    spans = F.flatten(F.transform("_c", lambda x: F.transform(dense(x["m"]), lambda s: _shape(len(PATTERNS), x["a"] + s["f"], x["a"] + s["to"]))))
    return d.withColumn("_entropy", F.when(F.size("_c") > 0, spans).otherwise(F.array().cast(SPANS))).drop("_c")


def _say(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in PATTERNS], F.lit("entropy"))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: counts by kind, base (text of the base spans), spans (text of all spans)."""
    d = docs.select(*keep, F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, STAND_IN).alias("_t"))
    for kind in range(len(PATTERNS)):
        d = _found(d, kind)
    d = _entropy(d)
    base = F.concat(*[F.col(f"_{k}") for k, *_ in PATTERNS])
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in (*[p[0] for p in PATTERNS], "entropy")]
    return d.select(*keep, *counts, _say(base).alias("base"), _say(F.concat(base, F.col("_entropy"))).alias("spans"))
