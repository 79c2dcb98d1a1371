"""Market links: complements, similar titles, exclusive sets, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.functions.columns import clip, lit
from marketlab.functions.text import DATE_HINT, normal_text, question_stem, words
from marketlab.operators.similarity import SALT_SIZE, cosine_pairs, fold_sets, jaccard_join, set_key, tfidf_vectors
from marketlab.session import materialise


def edit_ratio(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; letters beyond ASCII count as one sign."""
    x, y = (F.regexp_replace(c, r"[^\x00-\x7F]", "?") for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), 1.0 - F.levenshtein(x, y) / longest).otherwise(lit(0))


def relation_type(event_a: Column, event_b: Column, question_a: Column, question_b: Column, sim: Column, jac: Column) -> Column:
    """Same event, dated candidates, or how closely the titles are related."""
    same = F.coalesce((event_a != "") & (event_a == event_b), F.lit(False))
    return relation_kind(same, has_date(question_a) & has_date(question_b), sim, jac)


def has_date(question: Column | str) -> Column:
    return F.rlike(normal_text(question), F.lit(DATE_HINT))


def relation_kind(same: Column, dated: Column, sim: Column, jac: Column) -> Column:
    """:func:`relation_type` where it is known whether the event is the same and both questions hold a date."""
    return (
        F.when(same, "same_event")
        .when(dated & ((sim >= 0.7) | (jac >= 0.5)), "time_window_consistency_candidate")
        .when((sim >= 0.8) | (jac >= 0.65), "fuzzy_related")
        .otherwise("weak_related")
    )


def link_id(a: Column, b: Column, relation: Column) -> Column:
    return F.md5(F.concat_ws("|", F.least(a, b), F.greatest(a, b), relation))


def similar_titles(markets: DataFrame, min_jaccard: float = 0.55, per_market: int = 12) -> DataFrame:
    """Links between markets of one event (else one category) with similar titles.

    A pair qualifies by the Jaccard similarity of its word sets, found by an
    exact join; the edit ratio of the titles only ranks the pairs, and each
    title keeps its best partners. Titles with equal words meet other titles
    through their smallest market and are linked to it each with its own title.
    """
    m = markets.where(F.col("question").isNotNull()).select(
        F.col("market_id").cast("string").alias("market_id"), F.col("event_id").cast("string").alias("event_id"), "category", normal_text("question").alias("title")
    )
    has_event = F.coalesce((F.col("event_id") != "") & (F.lower("event_id") != "none"), F.lit(False))
    m = m.withColumns({"block": F.when(has_event, F.concat(F.lit("e:"), F.col("event_id"))).otherwise(F.concat(F.lit("c:"), F.coalesce("category", F.lit("unknown")))), "toks": words("title")})
    # the title of the smallest member stands for the folded set
    sets = materialise(fold_sets(m, "block", "toks", "market_id", {"title": F.min_by("title", "market_id"), "event_id": F.min_by("event_id", "market_id"), "category": F.min_by("category", "market_id")}))
    p = jaccard_join(sets, sets, "block", min_jaccard, ordered_pairs=True)
    side = lambda s, n: sets.select(F.col("set_id").alias(s), F.col("title").alias(f"title_{n}"), F.col("event_id").alias(f"event_{n}"), F.col("category").alias(f"category_{n}"), F.col("first_member").alias(f"market_{n}"))
    p = p.join(side("l", "a"), "l").join(side("r", "b"), "r").select("market_a", "market_b", "title_a", "title_b", "event_a", "event_b", "category_a", "category_b", "jaccard")
    # markets with the same words hang on their representative: n - 1 links, not n squared
    star = m.where(F.size("toks") > 0).withColumn("l", set_key("block", "toks")).join(side("l", "a"), "l").where(F.col("market_id") != F.col("market_a"))
    p = p.unionByName(star.select("market_a", F.col("market_id").alias("market_b"), "title_a", F.col("title").alias("title_b"), "event_a", F.col("event_id").alias("event_b"), "category_a", F.col("category").alias("category_b"), lit(1).alias("jaccard")))
    p = p.withColumn("sim", edit_ratio(F.col("title_a"), F.col("title_b"))).withColumn("score", 0.6 * F.col("sim") + 0.4 * F.col("jaccard"))
    p = p.withColumn("relation_type", relation_type(F.col("event_a"), F.col("event_b"), F.col("title_a"), F.col("title_b"), F.col("sim"), F.col("jaccard")))
    kept = best_partners(p, per_market)
    return kept.select(
        link_id(F.col("market_a"), F.col("market_b"), F.col("relation_type")).alias("link_id"),
        F.least("market_a", "market_b").alias("market_id_a"),
        F.greatest("market_a", "market_b").alias("market_id_b"),
        "relation_type",
        clip("score", 0.0, 1.0).alias("link_confidence"),
        F.lit("event_id+fuzzy_title").alias("heuristic_source"),
        F.to_json(F.struct(F.round("sim", 6).alias("title_similarity"), F.round("jaccard", 6).alias("token_jaccard"), F.coalesce("event_a", F.lit("")).alias("event_id_a"), F.coalesce("event_b", F.lit("")).alias("event_id_b"), F.coalesce("category_a", F.lit("")).alias("category_a"), F.coalesce("category_b", F.lit("")).alias("category_b"))).alias("metadata_json"),
    ).dropDuplicates(["link_id"])


TFIDF_WORD = "[a-z0-9]{2,}"


def question_sets(df: DataFrame, threshold: float = 0.72, stop_words: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Markets of one event folded by equal words, and the pairs of sets with a tf-idf cosine at the threshold.

    Members are (event_id, doc, market_id) and pairs (event_id, l, r,
    similarity); a set is named by its smallest market. All texts of a market
    in an event are one document, those without market id too. Document
    frequencies count all markets.
    """
    words_of = F.regexp_extract_all(F.lower("question"), F.lit(TFIDF_WORD), F.lit(0))
    kept = F.filter(words_of, lambda x: ~x.isin(*stop_words)) if stop_words else words_of
    d = df.where(F.col("event_id").isNotNull() & F.col("question").isNotNull())
    rows = F.count(F.lit(1)).alias("rows")
    # words travel as one string, which is a third of an array of them
    line = lambda bag: F.array_join(F.array_sort(bag), " ")
    known = d.where(F.col("market_id").isNotNull()).select("event_id", "market_id", F.array_join(kept, " ").alias("bag"))
    bags = known.groupBy("event_id", "market_id").agg(line(F.filter(F.split(F.concat_ws(" ", F.collect_list("bag")), " "), lambda x: x != "")).alias("bag"), rows)
    # a market of several events is a set of its own, as its length counts all of them
    several = materialise(d.groupBy("market_id").agg((F.min("event_id") < F.max("event_id")).alias("_own")).where("_own"))
    key = F.md5(F.concat_ws("\x1f", "bag", F.when(F.col("_own"), F.col("market_id").cast("string"))))
    bags = materialise(bags.join(several, "market_id", "left").select("event_id", "market_id", "bag", "rows", key.alias("key")))
    agg = (F.min("market_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.sum("rows").alias("rows"))
    none = d.where(F.col("market_id").isNull()).select("event_id", kept.alias("bag")).groupBy("event_id").agg(line(F.array_distinct(F.flatten(F.collect_set("bag")))).alias("bag"), rows)
    none = none.select("event_id", F.lit(None).cast(df.schema["market_id"].dataType).alias("doc"), F.lit(1).cast("long").alias("copies"), "rows", "bag")
    docs = bags.groupBy("event_id", "key").agg(*agg, F.first("bag").alias("bag")).drop("key").unionByName(none)
    words_in = F.filter(F.split("bag", " "), lambda x: x != "")
    pairs = cosine_pairs(tfidf_vectors(docs, "event_id", "doc", words_in, (), "copies", "rows"), "event_id", threshold)
    names = bags.where("bag <> ''").select("event_id", "key", "market_id")
    members = names.join(names.groupBy("event_id", "key").agg(F.min("market_id").alias("doc")), ["event_id", "key"]).drop("key")
    return materialise(members), materialise(pairs)


def member_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of members of one set (similarity one) or of two paired sets, smaller id first.

    Members of large sets are dealt into slices and every two slices meet in a
    task of their own.
    """
    n = members.groupBy("event_id", "doc").agg(F.count(F.lit(1)).alias("n")).withColumn("slices", F.ceil(F.col("n") / SALT_SIZE).cast("int"))
    sliced = materialise(members.join(n, ["event_id", "doc"]).withColumn("slice", F.pmod(F.xxhash64("market_id"), F.col("slices")).cast("int")))
    n = sliced.select("event_id", "doc", "n", "slices").distinct()
    links = pairs.select("event_id", "l", "r", "similarity")
    inner = n.where("n > 1").select("event_id", F.col("doc").alias("l"), F.col("doc").alias("r"), lit(1).alias("similarity"))
    cells = links.unionByName(inner)
    for s in ("l", "r"):
        cells = cells.join(n.select("event_id", F.col("doc").alias(s), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias(f"slice_{s}")), ["event_id", s])
    for s in ("l", "r"):
        cells = cells.join(sliced.select("event_id", F.col("doc").alias(s), F.col("slice").alias(f"slice_{s}"), F.col("market_id").alias(f"m_{s}")), ["event_id", s, f"slice_{s}"])
    met = cells.where((F.col("l") != F.col("r")) | (F.col("m_l") < F.col("m_r")))
    return met.select(F.least("m_l", "m_r").alias("market_a"), F.greatest("m_l", "m_r").alias("market_b"), "similarity")


def related_questions(df: DataFrame, threshold: float = 0.72, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of markets of one event whose questions have a tf-idf cosine at the threshold."""
    return member_pairs(*question_sets(df, threshold, stop_words))


def representative_questions(df: DataFrame, threshold: float = 0.72, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of :func:`related_questions` with equal questions compared once.

    Pairs run between representatives (the smallest market id), and every other
    copy is paired with its own representative at similarity one.
    """
    members, pairs = question_sets(df, threshold, stop_words)
    text = F.md5("question")
    worded = F.size(F.regexp_extract_all(F.lower("question"), F.lit(TFIDF_WORD), F.lit(0))) > 0
    d = df.where(F.col("event_id").isNotNull() & F.col("question").isNotNull()).select("event_id", "market_id", text.alias("text"), worded.alias("worded"))
    reps = materialise(d.groupBy("event_id", "text").agg(F.min("market_id").alias("rep")))
    own = member_pairs(members.join(reps.select(F.col("rep").alias("market_id")), "market_id", "left_semi"), pairs)
    copies = d.where("worded").join(reps, ["event_id", "text"]).where(F.col("market_id") != F.col("rep"))
    return own.unionByName(copies.select(F.col("rep").alias("market_a"), F.col("market_id").alias("market_b"), lit(1).alias("similarity")))


def best_partners(pairs: DataFrame, k: int, score: str = "score", left: str = "market_a", right: str = "market_b") -> DataFrame:
    """Pairs that are among the k best of either end.

    The rank filter lets Spark cut each end to its k best inside every map
    task before the shuffle, so a popular end stays small.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col(left).alias("me"), F.col(right).alias("you")), F.struct(F.col(right).alias("me"), F.col(left).alias("you")))).alias("e"), score).select("e.me", "e.you", score)
    ranked = ends.withColumn("_rk", F.row_number().over(W.partitionBy("me").orderBy(F.col(score).desc(), F.col("you").desc()))).where(F.col("_rk") <= k)
    keep = ranked.select(F.least("me", "you").alias("_lo"), F.greatest("me", "you").alias("_hi")).distinct()
    return pairs.withColumns({"_lo": F.least(left, right), "_hi": F.greatest(left, right)}).join(keep, ["_lo", "_hi"], "left_semi").drop("_lo", "_hi")


def outcome_links(outcomes: DataFrame) -> DataFrame:
    """YES and NO token side by side per market."""
    lab = F.lower(F.trim(F.coalesce("outcome_label", F.lit(""))))
    g = outcomes.where(F.col("token_id").isNotNull()).groupBy("market_id").agg(F.min(F.when(lab == "yes", F.col("token_id"))).alias("yes_token_id"), F.min(F.when(lab == "no", F.col("token_id"))).alias("no_token_id"))
    return g.where(F.col("yes_token_id").isNotNull() & F.col("no_token_id").isNotNull()).withColumns({"link_source": F.lit("market_outcomes_yes_no_labels"), "metadata_json": F.lit("{}")})


def linked_markets(markets: DataFrame, links: DataFrame) -> DataFrame:
    """Markets that have both outcome tokens, with defaults for set building."""
    m = markets.select("market_id", F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("event_id"), F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("question", F.lit("")).alias("question"), "active")
    return m.join(links.select("market_id"), "market_id", "left_semi")


def market_sets(markets: DataFrame, min_size: int = 2) -> DataFrame:
    """Candidate exclusive sets: same event, category and question stem."""
    m = markets.withColumn("question_stem", question_stem("question")).where(F.trim("question_stem") != "")
    key = ["event_id", "category", "question_stem"]
    size = m.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    known = (F.trim("event_id") != "") & (F.lower("event_id") != "none")
    return (
        m.join(size, key)
        .select(
            F.md5(F.concat_ws("|", "event_id", "category", "question_stem", F.lit("exclusive"))).alias("set_id"),
            F.col("market_id").cast("string").alias("market_id"),
            F.lit("YES").alias("outcome_label"),
            lit(1).alias("weight"),
            F.lit("exclusive").alias("set_type"),
            F.when(known, lit(0.85)).otherwise(lit(0.65)).alias("link_confidence"),
            F.to_json(F.struct("event_id", "category", "question_stem", "active")).alias("metadata_json"),
        )
        .dropDuplicates(["set_id", "market_id"])
    )


def links_summary(outcome: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """Counts per link table as (metric, value, detail)."""
    o = outcome.agg(F.count(F.lit(1)).cast("double").alias("value"), F.concat(F.lit("markets="), F.countDistinct("market_id").cast("string")).alias("detail")).select(F.lit("outcome_links").alias("metric"), "value", "detail")
    s = sets.agg(
        F.countDistinct("set_id").cast("double").alias("value"),
        F.concat(F.lit("members="), F.count(F.lit(1)).cast("string"), F.lit(" avg_conf="), F.format_string("%.3f", F.coalesce(F.avg("link_confidence"), lit(0)))).alias("detail"),
    ).select(F.lit("market_sets").alias("metric"), "value", "detail")
    r = links.groupBy("relation_type").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.concat(F.lit("market_links:"), F.col("relation_type")).alias("metric"), "value", F.lit("").alias("detail"))
    return o.unionByName(s).unionByName(r)
