"""Patterns that are quick to try find what the plain ones find."""

from pyspark.sql import functions as F

from wardlight import domain
from wardlight.functions import text as tx

_WORD = r"[\p{L}\p{N}]"
#: Code points but for surrogates, which no string holds.
_POINTS = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


def _plain_script(text):
    found = F
    for script, code in domain.SCRIPT_ORDER:
        found = found.when(text.rlike(rf"\p{{{script}}}"), code)
    return found.otherwise("en")


def test_scripts_and_letters_of_every_code_point(spark):
    every = spark.createDataFrame([(chr(c),) for c in _POINTS if c < 0x30000 or c >= 0xE0000 and c < 0xE0200], "text string")
    text = F.col("text")
    accented = (tx.guess_form_language(text) == "pt") != text.rlike("(?iu)[ãõáâàéêíóôúç]")
    assert every.filter((tx.first_script(text) != _plain_script(text)) | accented).count() == 0


def test_words_of_the_form_language_in_any_case(spark):
    words = "rua água buraco lixo saúde energia".split()
    cases = [f(w) for w in words for f in (str.lower, str.upper, str.title)]
    cases += ["ſaude", "energıa", "ENERGİA", "LİXO", "KRua", "xrua", "rua1", "ruaK", "_lixo", "-lixo-"]
    rows = spark.createDataFrame([(f"a {c} b",) for c in cases] + [(c,) for c in cases], "text string")
    text = F.col("text")
    plain = text.rlike("(?iu)[ãõáâàéêíóôúç]") | text.rlike(
        r"(?iu)(?<![A-Za-z0-9_])(rua|água|buraco|lixo|saúde|energia)(?![A-Za-z0-9_])"
    )
    assert rows.filter((tx.guess_form_language(text) == "pt") != plain).count() == 0


def test_keywords_as_by_trying_each(spark):
    phrases = [*tx._KEYWORDS]
    plain = rf"(?<!{_WORD})(?=({'|'.join(sorted(phrases, key=len, reverse=True))})(?!{_WORD}))"
    texts = [f"{a}{b}{p}{c}" for a in ("", "x", "é", "7", "़") for b in ("", " ", "-") for p in phrases for c in ("", "s", " s", "7", "़", "़क", "-" + p)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (plain, tx.KEYWORD_PATTERN)]
    assert rows.filter(found[0] != found[1]).count() == 0


def test_dear_tests_come_last():
    # Keywords that begin alike share their beginning; scripts are looked up for few characters.
    assert "roads" in tx._KEYWORDS and "roads" not in tx.KEYWORD_PATTERN
    assert tx._of_scripts("IsTamil").startswith(r"[[\x{900}-") and tx._of_scripts("IsTamil", "IsCyrillic").startswith(r"[[\x{400}-")


def test_confidence_of_latin_texts(spark):
    rows = spark.createDataFrame([("the road 7",), ("A",), ("7 -",), ("",), ("hai nahi ka",), (None,)], "text string")
    got = [r.s and (r.s.code, r.s.confidence) for r in rows.select(tx.detect_script(F.col("text")).alias("s")).collect()]
    assert got[:5] == [("en", 1.0), ("en", 1.0), ("en", 0.0), ("en", 0.0), ("hi-Latn", 1.0)]


def test_most_frequent_keyword_of_many(spark):
    # Two water, two road words: of equal counts the first seen wins; counts are made for what occurs only.
    texts = ["water road tap road", "road water road tap", "internet", "nothing", "дорога road дорога"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.keyword for r in tx.keyword_classify(rows).collect()}
    assert [got[i] and (got[i].category, got[i].language) for i in range(5)] == [
        ("water", "en"), ("roads", "en"), ("internet", "en"), None, ("roads", "ru")
    ]
    parts = tx.keyword_summary_parts(F.col("hits"))._jc.toString()
    assert not any(f"'{c}'" in parts or f" {c})" in parts for c in ("sanitation", "electricity"))
