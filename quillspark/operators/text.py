"""Cleaning of text, rule scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import let, line_blocks  # noqa: F401


def squeeze(text: Column) -> Column:
    """Three and more line ends as two, runs of spaces and tabs as one space, no white space at the ends; null if empty."""
    t = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "[ \t]{2,}", " ")
    return F.nullif(F.regexp_replace(F.regexp_replace(t, r"^[ \t\n\r]+", ""), r"[ \t\n\r]+$", ""), F.lit(""))


# fixed values: characters that aren't garbled, patterns of advertisements (in short blocks), of page headers and footers
VALID = r"[一-鿿\x{3000}-\x{303F}\x{FF00}-\x{FFEF}a-zA-Z0-9 \t\n\r\f\x0B，。！？、；：\"'（）【】《》·…—\-.,!?;:()\[\]<>/\\+=*#@%&^~|]"
#: what VALID leaves out, with its one-byte characters one by one: the engine looks those up in a table, and tests ranges in turn
_BYTES = "".join(rf"\x{{{c:X}}}" for c in (*range(9, 14), 32, *range(33, 127), 0xB7) if re.match(r"[a-zA-Z0-9 \t\n\r\f\x0B\"'·\-.,!?;:()\[\]<>/\\+=*#@%&^~|]", chr(c)))
GARBLED = rf"[^{_BYTES}一-鿿\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}…—]+"
ADVERTS = (
    "(?i)(扫码|关注|公众号|微信号|抖音号|小红书)",
    "(?i)(版权所有|copyright|all rights reserved)",
    r"(?i)(www\.\S+\.(com|cn|net|org))",
    "(?i)(免费领取|限时优惠|点击购买|立即下单)",
    "(转载请注明|禁止转载|侵权必究)",
)
HEADERS_FOOTERS = (r"^第?\s*\d+\s*页$", r"(?i)^Page\s*\d+", r"^\d+\s*/\s*\d+$", r"^[-—]+\s*\d+\s*[-—]+$")


def is_advert(text: Column, below: int = 100) -> Column:
    return (F.length(text) < below) & text.rlike("|".join(f"(?:{p})" for p in ADVERTS))


def is_header_footer(text: Column, most: int = 50) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return (F.length(t) <= most) & t.rlike("|".join(f"(?:{p})" for p in HEADERS_FOOTERS))


def meaningful(text: Column, least: int = 3) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) >= least


def degarble(text: Column, most: float = 0.3, garbled: str = GARBLED) -> Column:
    """Text without garbled characters; empty if their share is above most."""

    def judged(clean: Column) -> Column:
        bad = (F.length(text) - F.length(clean)) / F.nullif(F.length(text), F.lit(0))
        return F.when(bad > most, "").otherwise(clean)

    return let(F.regexp_replace(text, garbled, ""), judged)


def token_count(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) * F.lit(0.7)).cast("int")


def retrieval_chunks(chunks: DataFrame, doc: str, text: str, least: int = 50) -> DataFrame:
    """Adds token_count and kept_short: chunks of at least `least` tokens; all those of a document that has none."""
    top = F.max("token_count").over(Window.partitionBy(doc))
    c = chunks.withColumn("token_count", token_count(F.col(text))).withColumn("kept_short", top < least)
    return c.where((F.col("token_count") >= least) | F.col("kept_short"))


def occurrences(text: Column, term: str) -> Column:
    # bytes, which a string knows, not characters, which are counted anew for each term; looking a term up is cheaper than
    # replacing it, and most texts lack most terms
    return F.when(~F.contains(text, F.lit(term)), F.lit(0).cast("long")).otherwise(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))) / len(term.encode())).cast("long"))


def classify(docs: DataFrame, key: str, text: str, rules: dict[str, list[str]], least: float = 0.3) -> DataFrame:
    """key, category, score, confidence: the category with most occurrences of its terms, the first among equals, its
    share of all; `unknown` below `least`. Rules are literals of the plan: one pass, no join."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = docs.select(key, *(sum((occurrences(t, x.lower()) for x in terms), F.lit(0).cast("long")).alias(f"_s{i}") for i, (_, terms) in enumerate(rules.items())))
    cols = [F.col(f"_s{i}") for i in range(len(rules))]
    total, best = sum(cols[1:], cols[0]), F.greatest(*cols) if len(cols) > 1 else cols[0]
    name = F.coalesce(*(F.when(c == best, k) for c, k in zip(cols, rules, strict=True)))
    confidence = F.round(F.coalesce(best / F.nullif(total, F.lit(0)), F.lit(0.0)), 4)
    return scored.select(key, F.when(confidence < least, "unknown").otherwise(name).alias("category"), best.alias("score"), confidence.alias("confidence"))
