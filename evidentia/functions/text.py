"""Text functions, Column to Column.  All stay in the JVM."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia import lexicons as L


def any_of(tests: Sequence[Column]) -> Column:
    """Whether one of the tests holds; false for none."""
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def holds(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the literal ``words`` stands anywhere in the text."""
    return any_of([F.contains(text, F.lit(w)) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Unicode's white space, as text methods strip it.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[{SPACES}]"
#: Runs of white space other than one space.  Most characters are settled by one range and one table lookup.
_OTHER = r"\t-\r\x1c-\x1f\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_UNEVEN = f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; looks at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, _UNEVEN, " "))


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def payload_value(value: Column) -> Column:
    """A payload's string: stripped, null as empty."""
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def noise_text(text: Column) -> Column:
    """Empty text, or one of the texts that say nothing, in any case and spacing."""
    said = "|".join(f"{_SPACE}+".join(re.escape(w) for w in t.split()) for t in L.NOISE_TEXTS)
    return F.lower(F.coalesce(text, F.lit(""))).rlike(f"^{_SPACE}*(?:{said})?{_SPACE}*$")


def chunks(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Windows of ``size`` characters that overlap, up to the one that reaches the end; none of an empty text."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap

    def windows(body: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(body) - size) / step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.substring(body, p * step + 1, F.lit(size)))

    return F.when(F.length(strip(text)) > 0, let(strip(text), windows)).otherwise(F.array().cast("array<string>"))


def chunk_count(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """How many ``chunks`` a text has, without cutting it."""
    length = F.length(strip(text))
    return F.when(length > 0, F.greatest(F.lit(0), F.ceil((length - size) / (size - overlap))).cast("int") + 1).otherwise(F.lit(0))


def sentences(text: Column, least: int = 80, most: int = 900) -> Column:
    """Sentences of ``least`` to ``most`` characters.  One ends at . ? or ! before white space and a capital letter."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])\s+(?=[A-Z])")
    return F.filter(F.transform(parts, collapse), lambda s: F.length(s).between(least, most))


def noise_sentence(text: Column, forms: Sequence[str] = ("form 10-k",), least: int = 100, bars: int = 2, digits: int = 80) -> Column:
    """What is left of tables and headers: short, of a form's name, with many bars or digits."""
    low = F.lower(text)
    return (F.length(text) < least) | holds(low, (*forms, "table shows", "(dollars in millions)")) | (F.regexp_count(text, F.lit(r"\|")) > bars) | (F.regexp_count(text, F.lit(r"(?U)\d")) > digits)


def matches(text: Column, patterns: Sequence[str]) -> Column:
    return any_of([text.rlike(f"(?i){p}") for p in patterns])


def pricing(text: Column) -> Column:
    return matches(text, L.PRICING_PATTERNS)


def margin_driver(text: Column) -> Column:
    low = F.lower(text)
    return (F.contains(low, F.lit("margin")) & holds(low, ("due to", "primarily", "driven by", "attributable to"))) | (F.contains(low, F.lit("gross margin")) & holds(low, ("increase", "decrease", "improve", "decline")))


def demand(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit("demand")) | (holds(low, ("orders", "bookings")) & ~holds(low, ("currency", "foreign exchange", "fx")))


def strategic(text: Column) -> Column:
    return matches(text, L.STRATEGY_PATTERNS)


FACT_RULES = {"STRATEGIC_INVESTMENT_FOCUS": strategic, "MARGIN_DRIVER": margin_driver, "PRICING_PRESSURE": pricing, "DEMAND_TREND": demand}


def fact_type(text: Column, rules: dict | None = None) -> Column:
    """The first rule's name that holds; null if none does."""
    out = F
    for name, rule in (rules or FACT_RULES).items():
        out = out.when(rule(text), name)
    return out


def direction(text: Column, negative: Sequence[str] = L.NEGATIVE_CUES, positive: Sequence[str] = L.POSITIVE_CUES) -> Column:
    """negative or positive, by whose cue words are more; neutral at a tie."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n, p = (F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])")) for words in (negative, positive))
    return F.when(n > p, "negative").when(p > n, "positive").otherwise("neutral")


def web_domain(url: Column) -> Column:
    """Lower-case authority without a leading www.; empty if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.regexp_replace(found, r"^www\.", "")


def news_domain(url: Column) -> Column:
    """Authority without any www.; null if there is no url."""
    return F.when(F.length(url) > 0, F.replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit("www."), F.lit("")))


def source_class(url: Column, text: Column | None = None, rules=L.SOURCE_RULES) -> Column:
    """The class of the first rule that holds: of the domain, words in the url, words in the text; else unknown."""
    seen = {"domain": web_domain(url), "url": F.lower(F.coalesce(url, F.lit(""))), "text": F.lower(F.coalesce(text, F.lit(""))) if text is not None else F.lit("")}
    out = F
    for what, words, name in rules:
        out = out.when(seen["domain"].isin(*words) if what == "domain" else holds(seen[what], words), name)
    return out.otherwise("unknown")


def form_class(form: Column) -> Column:
    """financial_filing or news_article for what names one; else null."""
    low = F.lower(strip(F.coalesce(form, F.lit(""))))
    return F.when(low.isin("10-k", "10k", "10-q", "10q"), "financial_filing").when(low.isin("news", "news_article"), "news_article")


def html_flat(page: Column) -> Column:
    """Text of a page on one line, without scripts, styles, tables, comments and tags."""
    out = F.coalesce(page, F.lit(""))
    for tag in ("script", "style", "noscript", "table"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return collapse(entities(out))


def entities(text: Column) -> Column:
    """All character references of HTML decoded, by name and by number.

    A table of two thousand names has no place in an expression, so texts go through Python in Arrow batches.  All of
    them do: a condition would have Spark work out the text twice, which costs more than the way there and back.
    """
    return _unescape()(text)


@cache
def _unescape() -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return unescape


def html_lines(page: Column) -> Column:
    """Text of a page with line ends at breaks and around blocks, at most one empty line in a row."""
    out = F.coalesce(page, F.lit(""))
    for tag in ("script", "style", "noscript", "table"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), r"(?i)<br\b[^>]*>|</?(?:p|div|li|h[1-4])\b[^>]*>", "\n")
    out = entities(F.regexp_replace(out, r"(?s)<[^>]*>", ""))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def section(text: Column, form: str = "10-K", cutoff: int = 250_000, least: int = 2000) -> Column:
    """The discussion section of a filing: from the first start pattern, in order, that is found, to the first end
    pattern, in order, that is found after it, or ``cutoff`` characters.  Null if none starts or it is short."""

    def first(body: Column, patterns: Sequence[str]) -> Column:
        return F.coalesce(*(F.nullif(F.regexp_instr(body, F.lit(f"(?i){p}")), F.lit(0)) for p in patterns))

    cut = lambda tail: strip(F.substring(tail, F.lit(1), F.coalesce(first(tail, L.SECTION_ENDS[form]) - 1, F.lit(cutoff))))
    tail = F.substring(text, first(text, L.SECTION_STARTS[form]), F.length(text))
    return let(let(tail, cut), lambda found: F.when(F.length(found) >= least, found))


def english_enough(text: Column, share: float = 0.75) -> Column:
    """Whether this share of the letters is ASCII; false without letters."""
    letters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^a-zA-Z]", ""))
    return F.when(letters > 0, latin / F.greatest(letters, F.lit(1)) >= share).otherwise(F.lit(False))


def blocked(text: Column, markers: Sequence[str] = L.BLOCKED_MARKERS) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) == 0) | holds(F.lower(F.coalesce(text, F.lit(""))), markers)


def like_article(text: Column, least: int = 120, markers: Sequence[str] = L.BLOCKED_MARKERS) -> Column:
    """Long enough, not a blocking page, few replacement and few unprintable characters."""
    body = strip(F.coalesce(text, F.lit("")))
    n = F.greatest(F.length(body), F.lit(1))
    odd = F.length(F.regexp_replace(body, r"[^�]", ""))
    hidden = F.length(F.regexp_replace(body, r"[^\p{C}\p{Z}]|[ \n\r\t]", ""))
    return (F.length(body) >= least) & ~blocked(body, markers) & (odd / n <= 0.02) & (hidden / n <= 0.01)


def reader_text(text: Column) -> Column:
    """A reader proxy's text: after its last header, without empty lines; null if it is no article."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    marker = "Markdown Content:"
    out = F.when(F.contains(out, F.lit(marker)), F.substring(out, F.locate(marker, out) + len(marker), F.length(out))).otherwise(F.regexp_replace(out, r"(URL Source:|Title:|Published Time:)", "\n$1"))
    out = F.array_join(F.filter(F.transform(F.split(out, "\n"), strip), lambda x: x != ""), "\n")
    return F.when(like_article(out), out)


def company_norm(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9 ]+", " "), r"\s+", " "))


def company_aliases(name: Column, rounds: int = 6) -> Column:
    """The normalized name and what stays as legal suffixes fall off its end, of three characters or more."""
    suffix = rf"\b({'|'.join(L.LEGAL_SUFFIXES)})\.?$"

    def shorter(forms: Column, _: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.element_at(forms, -1), suffix, ""))
        return F.when(F.length(bare) > 0, F.concat(forms, F.array(bare))).otherwise(forms)

    forms = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(company_norm(name)), shorter)
    return F.filter(F.array_distinct(forms), lambda a: F.length(a) >= 3)


def entity_norm(name: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""))


def in_text(word: Column, text: Column) -> Column:
    """Whether the literal word stands in the text between characters that are no letters, digits or underscores."""
    quoted = F.regexp_replace(F.lower(word), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), quoted, F.lit(r"([^\p{L}\p{N}_]|$)")))


def needs_model(claim: Column, entities: Column, vague: Sequence[str] = L.VAGUE_WORDS, words: int = 18) -> Column:
    """Whether a claim's entities are few or its words vague or many."""
    tokens = F.split(strip(F.lower(claim)), r"\s+")
    return (F.size(entities) <= 1) | F.arrays_overlap(tokens, F.array(*map(F.lit, vague))) | (F.size(tokens) > words)


def valid_claim(claim: Column) -> Column:
    low = F.lower(claim)
    n = F.length(claim)
    return F.coalesce((n > 20) & (n < 300) & ~F.startswith(low, F.lit("the evidence")) & ~F.contains(low, F.lit("not mentioned")), F.lit(False))


def question_class(question: Column) -> Column:
    low, out = F.lower(question), F
    for words, name in ((("why",), "why"), (("improve", "better"), "improve"), (("evidence", "source"), "evidence"), (("score", "metric"), "metrics")):
        out = out.when(holds(low, words), name)
    return out.otherwise("general")


def evidence_parts(text: Column) -> Column:
    """section, topic and sentiment: the 4th, 3rd and 2nd part from the end between commas; clean_text: what the last quotes hold."""
    parts, quoted = F.split(text, ","), F.split(text, '"')
    at = lambda a, i: F.when(F.size(a) >= i, F.element_at(a, -i))
    full = F.length(text) > 0
    return F.struct(*(F.when(full, at(parts, i)).alias(n) for n, i in (("section", 4), ("topic", 3), ("sentiment", 2))), F.when(full, strip(at(quoted, 2))).alias("clean_text"))


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Distinct lower-case tokens: words with inner apostrophes, and single signs."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])"), 1))
    return F.array_except(found, F.array(*map(F.lit, stop_words))) if stop_words else found


def entities_of(text: Column) -> Column:
    """Distinct lower-case runs of capitalised words and numbers: an extractor that needs no model."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:\p{Lu}[\p{L}\p{N}]*|\p{N}[\p{N}.,%]*)(?: (?:\p{Lu}[\p{L}\p{N}]*|\p{N}[\p{N}.,%]*))*)"), 1)
    return F.array_distinct(F.transform(found, F.lower))


def cik10(value: Column) -> Column:
    return F.lpad(value.cast("bigint").cast("string"), 10, "0")


def label_name(value: Column) -> Column:
    return F.replace(value, F.lit("."), F.lit("_"))


def word_count(text: Column, words: Sequence[str]) -> Column:
    """Places where one of the literal words stands, as substrings of the lower-case text."""
    return sum((F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(re.escape(w))) for w in words), F.lit(0))
