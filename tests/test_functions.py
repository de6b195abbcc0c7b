"""Text, scoring and display expressions against fixed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardlight import domain
from wardlight.functions import display, scoring, text as tx
from wardlight.plans import classify


def values(spark, rows, shape, **columns):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"_i int, {shape}")
    out = df.withColumns(columns).orderBy("_i").collect()
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[next(iter(columns))] for r in out]


def test_script_examples(spark):
    # Sentences with known languages.
    cases = [
        ("in my area's govt hospitals doctor's are not available properly", "en", "English"),
        ("गली में कचरा कई दिनों से नहीं उठा", "hi", "Hindi"),
        ("রাস্তায় বড় গর্ত আছে", "bn", "Bengali"),
        ("தெருவில் தண்ணீர் வரவில்லை", "ta", "Tamil"),
        ("Road par bade gadhe hain, gaadi nikalna mushkil hai", "hi-Latn", "Hinglish"),
        ("", "en", "English"),
        ("abक", "en", "English"),  # majority
        ("कa", "hi", "Hindi"),  # tie: first seen
        ("aक", "en", "English"),
        ("12 ё!", "en", "English"),
    ]
    got = values(spark, [c[0] for c in cases], "t string", s=tx.detect_script(F.col("t")))
    assert [(s["code"], s["label"]) for s in got] == [c[1:] for c in cases]
    assert all(0 <= s["confidence"] <= 1 for s in got)
    assert got[5]["confidence"] == 0 and got[9]["confidence"] == 0 and got[8]["confidence"] == 0.5


def test_keywords_indic_nested_and_ties(spark):
    texts = [
        "सड़कों पर पानी",  # the shorter term hits inside the longer one, before a vowel sign
        "street lights and streetlight is not working",
        "water road",  # tie: first hit wins
        "internet",  # homonym is English
        "ＷＡＴＥＲ",  # compatibility forms
        "roadside",
        "தண்ணீர் வரவில்லை",
        "road " * 5,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = tx.keyword_classify(df).orderBy("i").collect()
    k = [r.keyword for r in rows]
    assert (k[0].category, k[0].language) == ("roads", "hi")
    assert k[0].confidence == pytest.approx(0.92) and k[0].summary == "Citizen reported a roads issue (सड़कों)."
    assert k[1].category == "electricity" and k[1].confidence == pytest.approx(0.96)
    assert k[1].summary == "Citizen reported a electricity issue (streetlight is not working)."
    assert k[2].category == "water" and k[3].language == "en" and k[4].category == "water"
    assert k[5] is None and (k[6].category, k[6].language) == ("water", "ta")
    assert k[7].confidence == pytest.approx(0.99)


def test_severity_rounds_in_doubles(spark):
    rows = [
        (2, "emergency", "neighbourhood", "1_to_6_months"), (5, None, "neighbourhood", "1_to_6_months"),
        (4, None, None, None), (5, "emergency", "wide_area", "over_6_months"), (1, "low", None, None), (4, "", "", ""),
    ]
    got = values(
        spark, rows, "ai int, u string, a string, d string",
        s=scoring.effective_severity(F.col("ai"), F.col("u"), F.col("a"), F.col("d")),
    )
    assert got == [3, 3, 4, 5, 1, 4]


def test_display(spark):
    got = values(
        spark, ["in-east_end-new-delhi", "mumbai", "x-1st"], "d string", p=display.pretty_district(F.col("d"))
    )
    assert got == ["East_end New Delhi", "Mumbai", "X 1st"]
    long = "a  b " * 100
    [(queue, own)] = values(
        spark, [long], "t string", q=display.summarize_text(F.col("t"), 150), o=display.summarize_text(F.col("t"), 140)
    )
    assert len(queue) == 148 and queue.endswith("…") and len(own) == 138
    decimals = values(spark, [0.25, 1.45, 2.75, 0.05, 9.95, 3.0, 12.349999], "x double", s=display.one_decimal(F.col("x")))
    assert decimals == ["0.3", "1.4", "2.8", "0.1", "9.9", "3.0", "12.3"]


def test_cursor_round_trip(spark):
    ids = ["a", "c100", "id/with+chars?>~", "ünï", "x" * 200]
    got = values(
        spark, ids, "t string", e=display.encode_cursor(F.col("t")), d=display.decode_cursor(display.encode_cursor(F.col("t")))
    )
    assert [d for _, d in got] == ids and not any(set("+/=") & set(e) for e, _ in got)
    bad = values(spark, ["", "a", "YQ==", "!!", "YR"], "t string", d=display.decode_cursor(F.col("t")))
    assert bad == [None] * 5


def test_languages(spark):
    rows = [("hi", "mr", "x"), ("hi-Latn", "hi", "x"), ("hi-Latn", "en", "x"), ("en", None, "вода"), ("en", "pt", "x"), ("ta", "hi", "x")]
    got = values(spark, rows, "s string, h string, t string", r=tx.resolve_language(F.col("s"), F.col("h"), F.col("t")))
    assert got == ["mr", "hi", "hi-Latn", "ru", "pt", "ta"]
    forms = values(spark, ["नमस्ते", "вода", "水", "a rua", "Ação", "street"], "t string", f=tx.guess_form_language(F.col("t")))
    assert forms == ["hi", "ru", "zh", "pt", "pt", "en"]


def test_fingerprint_ignores_case_width_and_spaces(spark):
    a, b, c, d = values(
        spark, [("Road  Water ", None, None), ("ｒoad water", None, None), ("road water", "hi", None), ("road water", None, "roads")],
        "t string, h string, c string", f=tx.text_fingerprint(F.col("t"), F.col("h"), F.col("c")),
    )
    assert a == b and a != c and d == a + "_roads"


def test_classify_branches(spark):
    model = "struct<category:string,severity:int,summary:string,tags:array<string>,detectedLanguage:string,translatedText:string>"
    given = ("water", 5, "Dry taps", ["tap"], "bn", "Taps are dry")
    rows = [
        (0, "some text here", None, "safety", given), (1, "road", None, None, given), (2, "nothing known", None, None, given),
        (3, "nothing known", None, None, None), (4, "  ", "pt", None, None), (5, "यह क्या", "mr", None, given),
    ]
    df = spark.createDataFrame(rows, f"i int, text string, language string, userCategory string, enrichment {model}")
    got = [r.classification for r in classify.classify_reports(df).orderBy("i").collect()]
    assert [(c.classifiedBy, c.category, c.severity, c.detectedLanguage) for c in got] == [
        ("user", "safety", 5, "bn"), ("trie", "roads", 3, "en"), ("model", "water", 5, "bn"),
        ("fallback", "roads", 3, "en"), ("fallback", "roads", 3, "pt"), ("model", "water", 5, "mr"),
    ]
    assert got[4].summary == "Infrastructure issue reported." and got[1].summary == "Citizen reported a roads issue (road)."
    assert got[0].tags == ["tap"] and got[3].translatedText == "nothing known"
    preview = classify.preview_category(spark.createDataFrame([("the road is bad",), ("short road",), ("nothing of that kind",)], "text string")).collect()
    assert sorted((r.text, r.category) for r in preview) == [("nothing of that kind", None), ("the road is bad", "roads")]


def test_vocabulary_is_whole():
    assert len(domain.KEYWORDS) == 92 and len(domain.COMPLAINT) == 25
