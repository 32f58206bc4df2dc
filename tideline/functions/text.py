"""Text functions as columns. HTML entities and NFKC have no built-in function: they are the one Arrow UDF here."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

URL = r"https?://[^\s<>\"]+"
TAG = r"<[^>]+>"
SPACE = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def unescape(text: Column) -> Column:
    """HTML entities resolved. Every text goes through the UDF: Spark evaluates one whatever branch it stands in."""
    return _unescaped(F.coalesce(text, F.lit("")))


def clean_text(text: Column) -> Column:
    """Entities resolved, tags to spaces, addresses to ` URL `, NFKC, white space collapsed, in that order."""
    plain = F.regexp_replace(F.regexp_replace(unescape(text), TAG, " "), URL, " URL ")
    return F.trim(F.regexp_replace(_nfkc(plain), SPACE, " "))


def html_to_text(text: Column) -> Column:
    """Feed descriptions: script and style go with their content, tags to spaces."""
    shown = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(shown, TAG, " ")), SPACE, " "))


def urls(text: Column) -> Column:
    """Addresses in the unescaped text, in order."""
    return F.regexp_extract_all(unescape(text), F.lit(URL), F.lit(0))


def url_domains(addresses: Column) -> Column:
    """Distinct lower-cased hosts with port and user, sorted."""
    hosts = F.transform(addresses, lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def punctuation_features(raw: Column, clean: Column) -> dict[str, Column]:
    letters = F.regexp_count(clean, F.lit(r"\p{L}"))
    capitals = F.regexp_count(clean, F.lit(r"\p{Lu}"))
    return {
        "post_length": F.length(clean),
        "token_count": F.regexp_count(clean, F.lit(r"(?U)\S+")),
        "all_caps_ratio": F.when(letters > 0, F.round(capitals / letters, 6)).otherwise(0.0),
        "exclamation_count": F.regexp_count(raw, F.lit("!")),
        "question_mark_count": F.regexp_count(raw, F.lit(r"\?")),
    }


def has_suffix(addresses: Column, suffixes: list[str]) -> Column:
    return F.exists(addresses, lambda u: F.lower(u).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
VIDEO_SUFFIXES = [".mp4", ".mov", ".webm", ".m4v"]
