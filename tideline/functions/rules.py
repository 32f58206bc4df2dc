"""Keyword rules as column expressions: topics, sentiment, confidence and tradeability of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, Rules
from .text import punctuation_features, url_domains


def plain(keyword: str) -> bool:
    """Whether a keyword is one run of word characters: it matches where it is one of the text's words."""
    return re.fullmatch(r"\w+", keyword) is not None


def known_words(lower: Column, rules: Rules) -> Column:
    """The plain keywords that are words of a text (runs of Unicode word characters): texts are cut once for all keywords."""
    lists = [*rules.topics.values(), rules.bullish, rules.bearish, rules.geopolitical, rules.neutral]
    keywords = sorted({k for words in lists for k in words if plain(k)})
    return F.array_intersect(F.regexp_extract_all(lower, F.lit(r"(?U)\w+"), F.lit(0)), F.array(*map(F.lit, keywords)).cast("array<string>"))


def matches(lower: Column, words: Column, keyword: str) -> Column:
    """A phrase with a space anywhere; a single word between Unicode word boundaries."""
    if plain(keyword):
        return F.array_contains(words, keyword)
    found = F.contains(lower, F.lit(keyword))
    if " " in keyword:
        return found
    return found & lower.rlike(r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", keyword) + r"\b")


def hits(lower: Column, words: Column, keywords: list[str]) -> Column:
    """The keywords that match, in list order."""
    return F.array_compact(F.array(*(F.when(matches(lower, words, k), F.lit(k)) for k in keywords)))


def enrich(df: DataFrame, *, raw_col: str = "text_raw", clean_col: str = "text_clean", urls_col: str = "urls", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """All text features of posts: url_domains, the punctuation features, and the columns of classify().

    Addresses are an array, or text parted by `|`; a frame without raw text or addresses is taken to have the clean
    text, and none. Null texts count as empty.
    """
    clean = F.coalesce(F.col(clean_col), F.lit(""))
    raw = F.coalesce(F.col(raw_col), F.lit("")) if raw_col in df.columns else clean
    if urls_col not in df.columns:
        addresses = F.array().cast("array<string>")
    elif dict(df.dtypes)[urls_col].startswith("array"):
        addresses = F.coalesce(F.col(urls_col), F.array().cast("array<string>"))
    else:
        addresses = F.split(F.coalesce(F.col(urls_col), F.lit("")), r"\|")
    return classify(df.withColumns({"url_domains": url_domains(addresses)} | punctuation_features(raw, clean)), clean_col, rules)


def unmatched(rules: Rules = DEFAULT_RULES) -> dict[str, Column]:
    """What classify() says of an empty text."""
    return {
        "rule_topic_labels": F.array(F.lit(rules.other)),
        "rule_topic_confidence": F.create_map(F.lit(rules.other), F.lit(0.5)),
        "rule_sentiment_label": F.lit("low_confidence"),
        "rule_sentiment_confidence": F.lit(0.45),
        "rule_reason_codes": F.array(F.lit("no_market_keyword")),
        "rule_tradeability_label": F.lit("ambiguous"),
    }


def classify(df: DataFrame, text_col: str = "text_clean", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Adds rule_topic_labels, rule_topic_confidence, rule_sentiment_label, rule_sentiment_confidence, rule_tradeability_label and rule_reason_codes.

    A null text counts as empty. Topics are ordered by score, equal scores in taxonomy order.
    """
    df = df.withColumn("_lower", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    lower, known = F.col("_lower"), F.col("_known")
    df = df.withColumn("_known", known_words(lower, rules))
    scored = [F.struct(F.lit(i).alias("at"), F.lit(t).alias("topic"), F.size(hits(lower, known, words)).alias("n")) for i, (t, words) in enumerate(rules.topics.items())]
    found = F.filter(F.array(*scored), lambda x: x["n"] > 0)
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-F.round(F.least(F.lit(0.95), 0.5 + 0.15 * x["n"]), 4)).alias("score"), x["at"].alias("at"), x["topic"].alias("topic"))))
    lists = {"_geo": rules.geopolitical, "_bull": rules.bullish, "_bear": rules.bearish, "_neutral": rules.neutral}
    df = df.withColumns({"_topics": ranked} | {k: hits(lower, known, v) for k, v in lists.items()}).drop("_lower", "_known")
    any_ = {k: F.size(k) > 0 for k in lists}
    boost = F.coalesce(-F.get("_topics", F.lit(0))["score"], F.lit(0.0))
    sure = lambda c: F.round(F.least(F.lit(0.95), 0.55 + 0.10 * F.size(c) + 0.15 * boost), 4)
    reason = lambda c, name: F.transform(c, lambda k: F.concat(F.lit(name), k))
    cases = [
        (any_["_geo"], "geopolitical_risk", sure("_geo"), reason("_geo", "geo:")),
        (any_["_bull"] & ~any_["_bear"], "bullish_market", sure("_bull"), reason("_bull", "bullish:")),
        (any_["_bear"] & ~any_["_bull"], "bearish_market", sure("_bear"), reason("_bear", "bearish:")),
        (any_["_bull"] & any_["_bear"], "volatility_only", F.lit(0.62), F.array(F.lit("mixed_bullish_bearish_keywords"))),
        (any_["_neutral"], "neutral", F.lit(0.68), reason("_neutral", "neutral:")),
        (F.lit(True), "low_confidence", F.lit(0.45), F.array(F.lit("no_market_keyword"))),
    ]
    pick = F
    for i, (when, label, confidence, why) in enumerate(cases):
        value = F.struct(F.lit(label).alias("label"), confidence.alias("confidence"), why.alias("why"))
        pick = F.when(when, value) if i == 0 else pick.when(when, value)
    names = F.transform("_topics", lambda x: x["topic"])
    confidences = F.map_from_arrays(names, F.transform("_topics", lambda x: -x["score"]))
    none = F.size("_topics") == 0
    df = df.withColumn("_case", pick).withColumns(
        {
            "rule_topic_labels": F.when(none, F.array(F.lit(rules.other))).otherwise(names),
            "rule_topic_confidence": F.when(none, F.create_map(F.lit(rules.other), F.lit(0.5))).otherwise(confidences),
            "rule_sentiment_label": F.col("_case.label"),
            "rule_sentiment_confidence": F.col("_case.confidence"),
            "rule_reason_codes": F.col("_case.why"),
        }
    )
    market = F.arrays_overlap("rule_topic_labels", F.array(*map(F.lit, rules.market_topics))) if rules.market_topics else F.lit(False)
    sentiment = F.col("rule_sentiment_label")
    tradeability = (
        F.when(F.col("rule_sentiment_confidence") < 0.5, "ambiguous")
        .when(sentiment == "geopolitical_risk", "volatility_only")
        .when(sentiment.isin("bullish_market", "bearish_market"), F.when(market, "tradeable_directional").otherwise("ambiguous"))
        .when(sentiment == "volatility_only", "volatility_only")
        .when(sentiment == "neutral", "no_impact")
        .otherwise("ambiguous")
    )
    return df.withColumn("rule_tradeability_label", tradeability).drop("_topics", "_case", *lists)
