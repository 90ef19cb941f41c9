"""Words, English, privacy codes, formatting."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text


def values(spark, column, *inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_words(spark):
    cases = {
        "don't stop": ["don't", "stop"], "it’s photo-generator": ["it’s", "photo-generator"], "café now": ["café", "now"], "(really) time.": ["really", "time"],
        "see https://x.y/z ok": ["see", "ok"], "me@site.org wrote": ["wrote"], "/usr/bin/x ran": ["ran"], "open file.txt now": ["open", "now"], "myVarName is": ["is"],
        "a½b 12 go": ["a½b", "go"], "да нет": ["да", "нет"], "": [], "-- ... 42": [], "x_y {a} b": ["a", "b"],
    }
    assert values(spark, text.words, *cases) == list(cases.values())


def test_english(spark):
    seven = "abcdefg"
    cases = {
        "123 !": "no_letters", "éà": "no_ascii_letters", "plain words": "latin_script", seven + "ддд": "token_mixes_scripts", seven + " дддд": "non_latin_share_exceeded",
        "one two three слово": "non_latin_share_exceeded", "one two three four five да": "non_latin_tokens_stripped", "somewhat longer да": "remainder_below_minimum", "ｆｕｌｌ": "non_latin_share_exceeded",
    }
    got = values(spark, text.classify_english, *cases)
    assert [r.reason for r in got] == list(cases.values())
    assert [r.english_text for r in got if r.reason == "non_latin_tokens_stripped"] == ["one two three four five"]


@pytest.mark.parametrize("sample,code", [
    ("go to www.site.test/x", "PRIVACY_URL_PRESENT"), ("the Acme.io page", "PRIVACY_URL_PRESENT"), ("mail me.fake@example.org", "PRIVACY_EMAIL_PRESENT"), ("key sk-EXAMPLEEXAMPLE1", "PRIVACY_CREDENTIAL_PATTERN"),
    ("id deadbeef12", "PRIVACY_IDENTIFIER_PRESENT"), ("see /home/user/notes", "PRIVACY_PATH_PRESENT"), ("call +1 (555) 010-9999", "PRIVACY_PHONE_PRESENT"), ("x => y", "PRIVACY_CODE_PRESENT"),
    ("it cost 1500 in all", "PRIVACY_SUSPICIOUS_NUMBER"), ("zero​width", "PRIVACY_INVISIBLE_CHARACTER"), ("the аcme.iо page", "PRIVACY_URL_PRESENT"),
])
def test_privacy_hits(spark, sample, code):
    assert code in values(spark, text.privacy_codes, sample)[0]


def test_privacy_misses(spark):
    for sample in ("Put a comma before a quotation.", "as in et.al and so on", "The class is open to people; we waited 45 minutes.", "the import duties rose", "I will return the book"):
        assert values(spark, text.privacy_codes, sample)[0] == []


def test_record_codes(spark):
    rows = spark.createDataFrame([("Use it as in this example above.", "Word order.", "w " * 16, "nowhere")], "rule string, mistake string, example string, source string")
    got = rows.select(text.record_codes(F.col("rule"), F.col("mistake"), F.col("example"), F.col("source")).alias("c")).first().c
    assert got == ["SCHEMA_INVALID_VALUE", "PRIVACY_CONTEXT_DEPENDENT_RULE", "PRIVACY_LONG_SOURCE_PHRASE"]


def test_formats(spark):
    assert values(spark, lambda t: text.format_tokens(t.cast("long")), "999", "1500", "2500", "1600000", "2000000", "3000000000") == ["999", "2K", "2K", "1.6M", "2M", "3B"]
    assert values(spark, lambda t: text.describe_age(t.cast("long")), "59", "60", "7200", "90000", None) == ["just now", "1 minute ago", "2 hours ago", "1 day ago", None]
    assert values(spark, text.safe_id_part, "a:b-1", "a b")[0] == "a:b-1"
    assert values(spark, text.dedup_key, "Straße  X", "  A\tb ") == ["strasse x", "a b"]


def test_letters_are_counted_in_runs_of_any_length(spark):
    """A run of 200,000 letters of another script is one match (and no deep recursion); no letter becomes a string of its own. No Latin letter lies in the range that is settled first."""
    import re

    from corpusloom.functions import fixed

    ranges = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{([0-9A-F]+)\}-\\x\{([0-9A-F]+)\}", fixed.latin_class())]
    assert ranges and not any(a <= 0x1CFF and b >= 0x370 for a, b in ranges)
    cases = ["ж" * 200_000, "漢" * 200_000, "é" * 300_000 + " ж", "one two three four five six seven eight nine ten eleven twelve да", "да" * 30 + " one"]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string").select("i", text.classify_english(F.col("x"))["reason"].alias("r"))
    got = {r.i: r.r for r in found.collect()}
    assert got[0] == got[1] == got[4] == "non_latin_share_exceeded" and got[3] == "non_latin_tokens_stripped" and got[2] != "non_latin_share_exceeded"
    assert "regexp_count" not in found._jdf.queryExecution().analyzed().toString().lower()


def _plain_hit(column, code):
    """A privacy check by its whole pattern alone."""
    pattern = dict(fixed.PRIVACY_CHECKS)[code]
    if code == "PRIVACY_URL_PRESENT":
        allowed = F.array(*map(F.lit, fixed.ABBREVIATIONS_NOT_DOMAINS))
        return F.exists(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda x: ~F.array_contains(allowed, F.lower(x)))
    return column.rlike(pattern)


def _plain_codes(column):
    """``privacy_codes`` by whole patterns alone."""
    plain = text.canonical(column)
    folded = text.fold_lookalikes(plain)
    other = F.when(folded != plain, folded)
    hits = [F.when(_plain_hit(plain, code) | F.coalesce(_plain_hit(other, code), F.lit(False)), F.lit(code)) for code, _ in fixed.PRIVACY_CHECKS]
    return F.array_compact(F.array(F.when(plain != column, F.lit(fixed.INVISIBLE)), *hits))


def test_privacy_parts_find_what_whole_patterns_find(spark):
    """Random texts of pieces that the patterns are made of, half of them with characters beyond ASCII; every check alone and the scan."""
    rng = random.Random(6)
    plain = [
        *"aZk09_-+./\\:;=@~%$(){}[]<>`'\",!# \n\t\r\x1c", " ", " ", "\n", "www.", "http", "://", ".io", "et.al", "sk-", "ghp_", "xoxb-", "AKIA", "eyJ", "BEGIN ", "RSA PRIVATE KEY", "deadbeef", "0a1b2c3d", "-1234", "ABCDEFGH12",
        "def ", "const", "class ", "import ", "from", "return ", "let ", "the import x", "function f", "src/", "tmp/", "C:\\", "\\\\a", "./", "../", "12", "1,5", "7 %", "USD", " EUR", "+1 (555) 010-99", "```", "=>", "::", "word", "x.y(", "a_b(", ") ;", "x@y", "me@b.c", "@z.", "sk-abcdefgh", "gho_ABCDEFGH", "AIza01234567", "return x",
    ]
    beyond = [*"éßжоса漢İıſ\u212A\u0301\u0345\u200d\u200b\u00ad\u0085\u2028\u2029\u00a0\u3000€£¥４٣ªⅧ＠．／😀\ufffd", "а.iо", "кey", "１２３", "٣٣٣", "www．", "İABCDEFGHIJKLMNOPQRSTUVWX", "abcdefghſjklmnopqrstuvwxyz", "éabcdef012", "abcdefabcdé1"]
    cases = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for pieces in (plain, plain + beyond * 2) for _ in range(6000)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*cases, None])], "i int, t string").repartition(4)
    for code, _ in fixed.PRIVACY_CHECKS:
        mine, whole = F.coalesce(text.has_pattern(F.col("t"), code), F.lit(False)), F.coalesce(_plain_hit(F.col("t"), code), F.lit(False))
        differ = rows.select("i", mine.alias("mine"), whole.alias("whole")).where("mine != whole").limit(5).collect()
        assert not differ, (code, [(r.mine, r.whole, cases[r.i]) for r in differ])
        assert rows.where(whole).limit(20).count() == 20
    differ = rows.select("i", text.privacy_codes(F.col("t")).alias("mine"), _plain_codes(F.col("t")).alias("whole")).where("mine != whole").limit(5).collect()
    assert not differ, [(r.mine, r.whole, cases[r.i]) for r in differ]


def test_odd_cases_and_lookalikes_are_all_known(spark):
    """Characters beyond ASCII that match a class of ASCII letters without regard to case are those stated; the range holds every look-alike."""
    chars = spark.range(128, 0x30000).where("id not between 55296 and 57343").select(F.col("id"), F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c"))
    assert {chr(r.id) for r in chars.where(F.col("c").rlike("(?Ui)[A-Za-z0-9+/]")).collect()} == set(fixed._ODD_CASES)
    assert chars.where(F.col("c").rlike("(?Ui)[0-9a-f]")).count() == 0
    low, high = (int(x, 16) for x in re.findall(r"u([0-9A-F]{4})", fixed.LOOKALIKE_RANGE))
    assert all(low <= ord(c) <= high for a, _ in fixed.LOOKALIKES for c in a)


def test_privacy_scan_of_texts_without_finds_is_fast(spark):
    """Texts without anything private cost a small part of what the whole patterns cost."""
    rng = random.Random(7)
    prose = ["So " + " ".join(rng.choices(["the", "class", "of", "people", "said", "about", "été", "déjà", "when", "completely", "return"][: 6 + 5 * (i % 2)], k=2500)) + "." for i in range(320)]
    rows = spark.createDataFrame([(x,) for x in prose], "t string").repartition(4).cache()
    rows.count()

    def seconds(column):
        began = time.monotonic()
        assert rows.select(F.sum(F.size(column))).first()[0] == 0
        return time.monotonic() - began

    seconds(text.privacy_codes(F.col("t"))), seconds(_plain_codes(F.col("t")))
    mine, whole = min(seconds(text.privacy_codes(F.col("t"))) for _ in range(2)), seconds(_plain_codes(F.col("t")))
    assert 2 * mine < whole, (mine, whole)
    rows.unpersist()
