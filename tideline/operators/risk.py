"""Reversal risk of events from their own text and the posts of the last hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, Rules, Settings
from .temporal import MINUTE, bucket, cut, first_after, keyed, ranged, running, shifted, sums_before, timed

SETTINGS = Settings()
WINDOWS = (5, 15, 30, 60, 240)
DAY_MINUTES = 1440.0
COMPONENTS = ["headline_risk_score", "market_relevance_score", "text_contradiction_score", "same_topic_score", "post_burst_score", "direction_flip_score", "volatility_regime_score"]
# Weights of the components.
WEIGHTS = {"headline_risk_score": 0.35, "market_relevance_score": 0.30, "text_contradiction_score": 0.15, "post_burst_score": 0.10, "direction_flip_score": 0.07, "same_topic_score": 0.03, "volatility_regime_score": 0.0}

#: what score() adds without timing features
SCORED = [*(f"posts_last_{m}m" for m in WINDOWS), "topic_entropy_60m", *COMPONENTS, "whipsaw_score", "whipsaw_risk_level", "risk_ttl_seconds", "contradicting_post_ids", "whipsaw_reason"]


def recent_topics(df: DataFrame, ts: str, topics: str, minutes: int) -> DataFrame:
    """_row and _entropy: entropy in bits of the topics of the posts of the last minutes, the row's own instant excluded.

    How often each topic was there is the difference of two running counts. There are as many topics as the rules have.
    """
    slim = df.select("_row", ts, F.coalesce(topics, F.array().cast("array<string>")).alias("_own"))
    names = [r[0] for r in slim.select(F.explode("_own").alias("t")).where("t is not null").distinct().collect()]
    if not names:
        return slim.select("_row", F.lit(0.0).alias("_entropy"))
    times = lambda topic: F.size(F.filter("_own", lambda x: x == topic))
    counts = sums_before(slim, ts, "_row", [minutes], {f"n{i}": times(t) for i, t in enumerate(names)})
    n = F.array(*(F.col(f"n{i}_{minutes}") for i in range(len(names))))
    total = F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    weighted = F.aggregate(n, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0))
    return counts.select("_row", F.when(total > 0, F.round(F.log2(total.cast("double")) - weighted / total, 6)).alias("_entropy"))


def burst_counts(df: DataFrame, ts: str = "received_at_utc", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """posts_last_{m}m for each window; the row's own instant doesn't count. Rows without a time have 0.

    Counts are those of an instant, however many posts it has: the scan has a row for each instant, not for each post.
    """
    own = "_row" in df.columns
    df = keyed(df)
    instants = df.groupBy(F.col(ts).alias("_instant")).agg(F.count("*").alias("_posts"))
    counts = sums_before(instants, "_instant", "_instant", windows, {"n": F.col("_posts")})
    out = df.join(counts, F.col(ts) == F.col("_instant"), "left").withColumns({f"posts_last_{m}m": F.coalesce(f"n_{m}", F.lit(0).cast("long")) for m in windows}).drop("_instant", *(f"n_{m}" for m in windows))
    return out if own else out.drop("_row")


def burst_features(df: DataFrame, ts: str = "received_at_utc", topics: str = "rule_topic_labels", windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """burst_counts() and topic_entropy_60m, which is 0 for rows without a time."""
    own = "_row" in df.columns
    df = keyed(df)
    out = burst_counts(df, ts, windows).join(recent_topics(df, ts, topics, 60), "_row", "left").withColumn("topic_entropy_60m", F.coalesce("_entropy", F.lit(0.0)) + 0.0).drop("_entropy")
    return out if own else out.drop("_row")


def timing_features(df: DataFrame, ts: str = "received_at_utc", tie: str = "post_id") -> DataFrame:
    """Gap to the post before, and over all gaps so far (the row's own too) the share within 15, 30 and 60 minutes and the mean.

    Rows without a time are as the first row is: a day, and 0.
    """
    df = keyed(df, "_timing")
    order = list(dict.fromkeys([ts, tie, "_timing"]))
    near = shifted(ranged(timed(df.select(*order), ts)[0], order), order, {"_previous": F.col(ts)})
    micros = F.unix_micros(ts) - F.unix_micros("_previous")
    near = near.withColumn("_gap", micros / MINUTE)
    sums = {"_n": F.when(F.col("_gap").isNotNull(), 1).otherwise(0), "_sum": F.coalesce(micros, F.lit(0).cast("long"))}
    sums |= {f"_in{h}": F.when(F.col("_gap") <= h, 1).otherwise(0) for h in (15, 30, 60)}
    found = running(near, order, sums).select("_timing", "_gap", *sums)
    out = df.join(found, "_timing", "left")
    columns = {"minutes_since_previous_post": F.coalesce("_gap", F.lit(DAY_MINUTES)), "expected_minutes_to_next_post": F.when(F.col("_n") > 0, F.round(F.col("_sum") / F.col("_n") / MINUTE, 4)).otherwise(DAY_MINUTES)}
    columns |= {f"p_next_post_{h}m": F.when(F.col("_n") > 0, F.round(F.col(f"_in{h}") / F.col("_n"), 6)).otherwise(0.0) for h in (15, 30, 60)}
    return out.withColumns(columns).drop("_timing", "_gap", *sums)


def same_topic(a: Column, b: Column) -> Column:
    """Jaccard overlap of two topic arrays; 0 where one is empty."""
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / either).otherwise(0.0)


def sentiment_direction(label: Column) -> Column:
    return F.when(label == "bullish_market", 1).when(label.isin("bearish_market", "geopolitical_risk"), -1).otherwise(0)


def opposite(a: Column, b: Column) -> Column:
    return sentiment_direction(a) * sentiment_direction(b) == -1


def contradiction(a: Column, b: Column, topics_a: Column, topics_b: Column) -> Column:
    return F.when(opposite(a, b), F.round(0.4 + 0.6 * same_topic(topics_a, topics_b), 4)).otherwise(0.0)


def pair_scores(df: DataFrame, s: Settings = SETTINGS, *, key: str = "post_id") -> DataFrame:
    """Per post (a value of key) the largest contradiction, topic overlap and flip against posts of the lookback, and the earliest most contradicting one.

    Scores depend on a prior's direction and set of topics only, its class. A lookback is the end of one bucket of its
    width and the beginning of the next: a class is in it if its last post of the bucket before isn't too old, or its
    first of the post's own bucket is earlier. So instants, a row for all their posts of a class, meet one row for their bucket and class, with the scores
    that it can have; only the first prior of the classes that give the best one is looked up, by an as-of join.
    """
    width = s.lookback_minutes * MINUTE
    topics = F.array_sort(F.array_distinct(F.coalesce("rule_topic_labels", F.array().cast("array<string>"))))
    own = timed(df, "received_at_utc")[0].select(F.col(key).alias("_key"), F.col("post_id").alias("_id"), F.col("received_at_utc").alias("_time"), topics.alias("_topics"), sentiment_direction(F.col("rule_sentiment_label")).alias("_way"))
    own = own.withColumns({"_class": F.concat_ws("|", F.col("_way").cast("string"), "_topics"), "_at": bucket("_time", width)})
    first = F.struct(F.col("_time").alias("at"), F.col("_id").isNull().alias("unnamed"), F.col("_id").alias("prior"))
    # posts of one instant and class have the same scores
    spots = keyed(own.groupBy("_at", "_class", "_topics", "_way", "_time").agg(F.min(first).alias("first")), "_spot")
    spans = cut(spots.groupBy("_at", "_class", "_topics", "_way").agg(F.min("first").alias("first"), F.max("_time").alias("last")))
    posts = spots.select("_spot", "_time", "_class", "_at", F.timestamp_micros(F.unix_micros("_time") - width).alias("_since")).join(_possible(spans), ["_at", "_class"])
    posts = posts.withColumn("_met", F.filter("_possible", lambda x: (x["last"] >= F.col("_since")) | (x["first"]["at"] < F.col("_time")))).where(F.size("_met") > 0)
    of = lambda name: F.array_max(F.transform("_met", lambda x: x[name]))
    posts = posts.select("_spot", "_since", "_met", of("text").alias("text"), of("topic").alias("topic"), of("flip").alias("flip"))
    best = F.when(F.col("text") > 0, F.filter("_met", lambda x: x["text"] == F.col("text")))
    before = F.filter(F.flatten(F.transform(best, lambda x: x["classes"])), lambda c: c["last"] >= F.col("_since"))
    scores = ["_spot", "text", "topic", "flip"]
    # the buckets before come first: where a class has a post in them, it isn't needed what follows
    posts = posts.select(*scores, "_since", F.array_min(F.transform(best, lambda x: x["first"])).alias("first"), F.coalesce(before["class"], F.array().cast("array<string>")).alias("_before"))
    firsts = spots.where("_way <> 0").select("_class", F.col("_time").alias("at"), F.col("first.prior").alias("prior"))
    asked = posts.select(*scores, "_since", F.explode("_before").alias("_class"))
    found = first_after(asked, firsts, keys=scores, at="_since", point_at="at", by=["_class"], name="first")
    scored = posts.where(F.size("_before") == 0).select(*scores, "first.at", "first.prior").unionByName(found.select(*scores, "first.at", "first.prior"))
    earliest = F.min(F.when(F.col("text") > 0, F.struct(-F.col("text"), "at", F.col("prior").isNull(), "prior")))
    scored = scored.groupBy("_spot").agg(F.max("text").alias("text"), F.max("topic").alias("topic"), F.max("flip").alias("flip"), earliest.alias("earliest"))
    placed = own.select("_key", "_class", "_time").join(spots.select("_spot", "_class", "_time").join(scored, "_spot"), ["_class", "_time"])
    return placed.groupBy(F.col("_key").alias(key)).agg(F.max("text").alias("text_contradiction_score"), F.round(F.max("topic"), 6).alias("same_topic_score"), F.max("flip").alias("direction_flip_score"), F.min("earliest")["prior"].alias("_prior"))


def _possible(spans: DataFrame) -> DataFrame:
    """For each bucket and class of posts `_possible`: the scores against all classes of the bucket and the one before.

    Of equal scores there is one entry, with the first post in the bucket, the time of the last one in the bucket
    before, and the classes that flip with theirs. There are as many classes as the rules allow.
    """
    none = lambda c: F.lit(None).cast(spans.schema[c].dataType).alias(c)
    theirs = [F.col("_class").alias("class"), F.col("_topics").alias("_theirs"), F.col("_way").alias("_other")]
    seen = spans.select("_at", *theirs, "first", none("last")).unionByName(spans.select((F.col("_at") + 1).alias("_at"), *theirs, none("first"), "last"))
    flipped, overlap = F.col("_way") * F.col("_other") == -1, same_topic(F.col("_topics"), F.col("_theirs"))
    text = F.when(flipped, F.round(0.4 + 0.6 * overlap, 4)).otherwise(0.0)
    scored = spans.select("_at", "_class", "_topics", "_way").join(seen, "_at").select("_at", "_class", "class", "first", "last", text.alias("text"), overlap.alias("topic"), F.when(flipped, 1.0).otherwise(0.0).alias("flip"))
    classes = F.collect_list(F.when((F.col("flip") > 0) & F.col("last").isNotNull(), F.struct("class", "last"))).alias("classes")
    entries = scored.groupBy("_at", "_class", "text", "topic", "flip").agg(F.min("first").alias("first"), F.max("last").alias("last"), classes)
    return entries.groupBy("_at", "_class").agg(F.collect_list(F.struct("text", "topic", "flip", "first", "last", "classes")).alias("_possible"))


def level(score: Column, s: Settings = SETTINGS) -> Column:
    return F.when(score >= s.hard, "HARD_KILL").when(score >= s.soft, "SOFT_RISK").when(score >= s.watch, "WATCH").otherwise("NONE")


def ttl(risk: Column, s: Settings = SETTINGS) -> Column:
    return F.when(risk == "HARD_KILL", s.hard_ttl).when(risk == "SOFT_RISK", s.soft_ttl).when(risk == "WATCH", s.watch_ttl).otherwise(0)


def dominant(columns: list[str]) -> tuple[Column, Column]:
    """Name and value of the largest column, the first of equals."""
    values = F.array(*columns)
    at = F.array_position(values, F.array_max(values)).cast("int")
    return F.element_at(F.array(*map(F.lit, columns)), at), F.array_max(values)


def score(df: DataFrame, s: Settings = SETTINGS, rules: Rules = DEFAULT_RULES, *, timing: bool = True, context: bool = True) -> DataFrame:
    """Labelled events with burst and timing features, seven components, weighted score, level, time to live and reason. Every row is a post: ids may be repeated.

    Without timing features, what a row gets depends on itself and on the rows of the last span_minutes() before it.
    Without context there are none of them, no entropy, and of the counts only posts_last_60m: the score needs no others.
    """
    df = keyed(df)
    out = burst_features(df) if context else burst_counts(df, windows=(60,))
    out = (timing_features(out) if timing and context else out).join(pair_scores(df, s, key="_row"), "_row", "left").drop("_row")
    sentiment, topics = F.col("rule_sentiment_label"), F.col("rule_topic_labels")
    relevant = F.size(F.array_intersect(topics, F.array(*map(F.lit, rules.relevant_topics))))
    out = out.withColumns(
        {
            "headline_risk_score": F.when(sentiment.isin("bearish_market", "geopolitical_risk"), 1.0).when(sentiment == "volatility_only", 0.65).when(sentiment == "bullish_market", 0.2).otherwise(0.0),
            "market_relevance_score": F.when(relevant > 0, F.round(F.least(F.lit(1.0), 0.4 + 0.2 * relevant), 6)).otherwise(0.0),
            "text_contradiction_score": F.coalesce("text_contradiction_score", F.lit(0.0)),
            "same_topic_score": F.coalesce("same_topic_score", F.lit(0.0)),
            "post_burst_score": F.round(F.least(F.lit(1.0), F.col("posts_last_60m") / 3.0), 6),
            "direction_flip_score": F.coalesce("direction_flip_score", F.lit(0.0)),
            "volatility_regime_score": F.lit(0.0),
        }
    )
    total = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    name, value = dominant(COMPONENTS)
    out = out.withColumn("whipsaw_score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6))
    out = out.withColumn("whipsaw_risk_level", level(F.col("whipsaw_score"), s))
    reason = F.format_string("%s=%.2f", name, value)
    return out.withColumns(
        {
            "risk_ttl_seconds": ttl(F.col("whipsaw_risk_level"), s),
            "contradicting_post_ids": F.when(F.col("_prior").isNotNull(), F.array("_prior")).otherwise(F.array().cast("array<string>")),
            "whipsaw_reason": F.when(F.col("_prior").isNotNull(), F.concat(reason, F.lit("; prior="), F.col("_prior"))).otherwise(reason),
        }
    ).drop("_prior")


def span_minutes(s: Settings = SETTINGS) -> int:
    """How far back score() looks, timing features apart."""
    return max(s.lookback_minutes, *WINDOWS)


def binary_metrics(actual: Column, predicted: Column, prefix: str, n: Column | None = None) -> list[Column]:
    """Confusion, precision and recall; n is the number of rows that a row stands for, one without it."""
    count = F.count_if if n is None else lambda x: F.sum(F.when(x, n).otherwise(0))
    tp, fp = count(actual & predicted), count(~actual & predicted)
    tn, fn = count(~actual & ~predicted), count(actual & ~predicted)
    ratio = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 6)).otherwise(0.0)
    return [tp.alias(f"{prefix}_tp"), fp.alias(f"{prefix}_fp"), tn.alias(f"{prefix}_tn"), fn.alias(f"{prefix}_fn"), ratio(tp, fp).alias(f"{prefix}_precision"), ratio(tp, fn).alias(f"{prefix}_recall")]


def evaluate(scored: DataFrame) -> DataFrame:
    """One row: level counts, confusion of soft-or-harder and hard against the market's flag, mean scores by flag."""
    actual, risk = F.coalesce("market_whipsaw_flag", F.lit(False)), F.col("whipsaw_risk_level")
    levels = [F.count_if(risk == x).alias(f"n_{x.lower()}") for x in ("HARD_KILL", "SOFT_RISK", "WATCH", "NONE")]
    means = [F.round(F.avg(F.when(actual, F.col("whipsaw_score"))), 6).alias("mean_score_true"), F.round(F.avg(F.when(~actual, F.col("whipsaw_score"))), 6).alias("mean_score_false")]
    return scored.agg(F.count("*").alias("row_count"), *levels, *binary_metrics(actual, risk.isin("SOFT_RISK", "HARD_KILL"), "soft"), *binary_metrics(actual, risk == "HARD_KILL", "hard"), *means)
