"""Text functions as columns: normalisation, words, English classification, privacy codes, formatting."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from . import fixed
from .similarity import ratio

_WS = fixed.white_space_class()


def _sql(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _without_format(text: str) -> str:
    for c in {c for c in set(text) if unicodedata.category(c) == "Cf"}:
        text = text.replace(c, "")
    return text


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _without_format(unicodedata.normalize("NFKC", t)), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(t.split()).casefold(), na_action="ignore")


def similarity(least: float):
    """A function of two columns: their matching-blocks ratio, which may depend on their order; 0 where a bound shows less than ``least``."""

    @F.pandas_udf(DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y, least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return similarity


def _only_beyond_ascii(text: Column, udf) -> Column:
    """``udf`` for texts with a character beyond ASCII; others are left alone and don't go to Python."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, udf(F.when(beyond, text))).otherwise(text)


def nfc(text: Column) -> Column:
    return _only_beyond_ascii(text, _nfc)


def canonical(text: Column) -> Column:
    """NFKC without format characters."""
    return _only_beyond_ascii(text, _canonical)


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, "".join(a for a, _ in fixed.LOOKALIKES), "".join(b for _, b in fixed.LOOKALIKES))


def dedup_key(text: Column) -> Column:
    """White space collapsed, case folded. ASCII texts stay in the JVM."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x1C-\x20]+", " ")))
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, _folded(F.when(beyond, text))).otherwise(plain)


def split_words(text: Column) -> Column:
    """Texts between white space."""
    return F.filter(F.split(text, f"{_WS}+"), lambda t: t != "")


def words(text: Column) -> Column:
    """The counted words of a text, in order."""
    tokens = F.transform(split_words(nfc(text)), lambda t: F.btrim(t, F.lit(fixed.STRIP_CHARS)))
    kept = F.filter(tokens, lambda t: (t != "") & ~t.rlike(fixed.EXCLUDED_TOKEN))
    return F.flatten(F.transform(kept, lambda t: F.regexp_extract_all(t, F.lit(fixed.WORD), F.lit(0))))


def count_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def _counted(text: Column, kind: str) -> Column:
    """How many characters of a kind a text holds: runs of them are taken out at once, and none becomes a string of its own."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{kind})++", ""))


def classify_english(text: Column) -> Column:
    """struct(reason, english_text): the English share of a text, or null where it is quarantined."""
    # The classes have hundreds of ranges: an ASCII character is settled before they are tried.
    latin = "[A-Za-z]|(?=[^\\x00-\\x7F])" + fixed.latin_class()
    # A letter that isn't Latin; from Greek to Vedic signs none is, so most are settled at once.
    other = r"(?=[^\x00-\x7F])(?:(?=[\x{370}-\x{1CFF}])\p{L}|[\p{L}&&[^" + fixed.latin_class()[1:] + "])"
    odd = text.rlike(other)  # texts without one need no counting
    letters, foreign = _counted(text, r"\p{L}"), _counted(text, other)
    tokens = split_words(text)
    has_foreign = lambda t: t.rlike(other)
    mixes = F.exists(tokens, lambda t: has_foreign(t) & t.rlike(latin))
    rest = F.array_join(F.filter(tokens, lambda t: ~has_foreign(t)), " ")
    no_letters, no_ascii, plain, share, mixed, short, stripped = (F.lit(x) for x in fixed.REASONS)
    reason = (
        F.when(~odd & text.rlike("[A-Za-z]"), plain)
        .when(~odd & text.rlike(r"\p{L}"), no_ascii)
        .when(~odd, no_letters)
        .when(foreign * 100 > letters * fixed.NON_LATIN_LETTER_PERCENT_LIMIT, share)
        .when(mixes, mixed)
        .when(count_words(rest) < fixed.MIN_REMAINDER_WORDS, short)
        .when(~rest.rlike("[A-Za-z]"), no_ascii)
        .otherwise(stripped)
    )
    english = F.when(reason == plain, text).when(reason == stripped, rest)
    return F.struct(reason.alias("reason"), english.alias("english_text"))


def english_words(text: Column) -> Column:
    return count_words(F.coalesce(classify_english(text)["english_text"], F.lit("")))


def _has_part(text: Column, part: fixed.Part, ascii_only: bool) -> Column:
    """Whether a part of a privacy check matches. In ASCII texts, Unicode's classes are those of ASCII, which Java tells faster: (?U) goes."""
    plain = lambda p: p.replace("(?U)", "").replace("(?U", "(?") if ascii_only else p
    needs = [reduce(or_, (F.contains(text, F.lit(x)) for x in group)) for group in part.literals]
    if part.sketch:
        needs.append(F.concat(F.lit("\n"), text).rlike(ascii_only and part.ascii_sketch or plain(part.sketch)))
    if part.pattern == fixed.URL:  # abbreviations written like domains don't count
        allowed = F.array(*map(F.lit, fixed.ABBREVIATIONS_NOT_DOMAINS))
        needs.append(F.exists(F.regexp_extract_all(text, F.lit(plain(part.pattern)), F.lit(0)), lambda x: ~F.array_contains(allowed, F.lower(x))))
    else:
        needs.append(text.rlike(plain(part.pattern)))
    return reduce(and_, needs)


def _by_letters(text: Column, column) -> Column:
    """``column`` of whether the text is ASCII."""
    return F.when(F.octet_length(text) > F.char_length(text), column(False)).otherwise(column(True))


def _has_pattern(text: Column, code: str, ascii_only: bool) -> Column:
    return reduce(or_, (_has_part(text, part, ascii_only) for part in fixed.PRIVACY_PARTS[code]))


def has_pattern(text: Column, code: str) -> Column:
    """Whether a privacy pattern matches; abbreviations written like domains don't count."""
    return _by_letters(text, lambda ascii_only: _has_pattern(text, code, ascii_only))


def privacy_codes(text: Column) -> Column:
    """The codes of everything a text must not share, in the order of the checks."""
    plain = canonical(text)
    folded = F.when(plain.rlike(fixed.LOOKALIKE_RANGE), F.nullif(fold_lookalikes(plain), plain))  # most texts hold no look-alike: their patterns run once
    variants = F.array_compact(F.array(plain, folded))
    codes = [code for code, _ in fixed.PRIVACY_CHECKS]
    of = lambda t, ascii_only: F.array_compact(F.array(*(F.when(_has_pattern(t, code, ascii_only), F.lit(code)) for code in codes)))
    # Within a function of arrays, a variant is made once and not for each of its patterns.
    hits = F.transform(variants, lambda t: _by_letters(t, lambda ascii_only: of(t, ascii_only)))
    found = F.array_intersect(F.array(*map(F.lit, codes)), F.flatten(hits))
    return F.concat(F.array_compact(F.array(F.when(plain != text, F.lit(fixed.INVISIBLE)))), found)


def version_codes(text: Column) -> Column:
    """As ``privacy_codes``, without the code that any version number would get."""
    return F.array_remove(privacy_codes(text), "PRIVACY_SUSPICIOUS_NUMBER")


def record_codes(rule: Column, mistake: Column, example: Column, source_type: Column, other_types: tuple[str, ...] = ()) -> Column:
    """Codes of a shareable record: of its texts, its source type, its rule and the length of its example. ``other_types``: source types besides the readers' own."""
    texts = F.concat(privacy_codes(mistake), privacy_codes(rule), privacy_codes(example), privacy_codes(source_type))
    own = F.array(
        F.when(~source_type.isin(*fixed.SOURCE_TYPES, *other_types), F.lit("SCHEMA_INVALID_VALUE")),
        F.when(fold_lookalikes(canonical(rule)).rlike(fixed.CONTEXT_DEPENDENT), F.lit("PRIVACY_CONTEXT_DEPENDENT_RULE")),
        F.when(F.size(split_words(example)) > fixed.MAX_EXAMPLE_WORDS, F.lit("PRIVACY_LONG_SOURCE_PHRASE")),
    )
    return F.concat(texts, F.array_compact(own))


def is_pasted_document(text: Column, low: int = fixed.PASTED_MIN_LINES, high: int = fixed.PASTED_MAX_LINES) -> Column:
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return (lines >= low) & (lines < high) & text.rlike(fixed.PASTED_STRUCTURE)


def safe_id_part(value: Column) -> Column:
    """A value fit for an id, or ``h`` and the first 16 hex digits of its SHA-256."""
    return F.when(value.rlike(r"^[A-Za-z0-9_.:-]{1,128}$"), value).otherwise(F.concat(F.lit("h"), F.substring(F.sha2(value, 256), 1, 16)))


def format_tokens(tokens: Column) -> Column:
    """Like 12K, 1.6M, 2B."""
    scaled = lambda d: F.regexp_replace(F.format_string("%.1f", tokens / d), r"\.0$", "")
    return (
        F.when(tokens >= 1_000_000_000, F.concat(scaled(1e9), F.lit("B")))
        .when(tokens >= 1_000_000, F.concat(scaled(1e6), F.lit("M")))
        .when(tokens >= 1_000, F.concat(F.rint(tokens / 1000).cast("long").cast("string"), F.lit("K")))
        .otherwise(tokens.cast("string"))
    )


def describe_age(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(seconds.isNull(), F.lit(None))
        .when(minutes < 1, "just now")
        .when(minutes < 60, unit(minutes, "minute"))
        .when(minutes < 24 * 60, unit(F.floor(minutes / 60), "hour"))
        .otherwise(unit(F.floor(minutes / 1440), "day"))
    )


def epoch_ms(value: Column, low: str = "2015-01-01", high: str = "2100-01-01") -> Column:
    """A timestamp from milliseconds, null outside the window."""
    at = F.timestamp_millis(value.cast("long"))
    return F.when(at.between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")), at)


def iso_timestamp(text: Column) -> Column:
    """An ISO timestamp, in the session's zone (UTC) where it names none; null if it is none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.regexp_replace(text, r" ([+-]\d\d:?\d\d)$", "$1").try_cast("timestamp"))


def plural(count: Column, singular: str, plural_form: str | None = None) -> Column:
    """The noun that agrees with a count."""
    return F.when(count == 1, singular).otherwise(plural_form or f"{singular}s")


def and_list(items: Column) -> Column:
    """An array for running prose: A; A and B; A, B, and C."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))
