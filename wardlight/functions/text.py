"""Text expressions: normalisation, keywords, scripts and languages.

Lengths, positions and slices count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from wardlight import domain

_WORD = r"[\p{L}\p{N}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times.

    A Column used twice is an expression evaluated twice; the one-element array holds
    the value instead.
    """
    return F.transform(F.array(value), use)[0]


#: Shorter ranges of settled characters are left out of the pattern, which only sends more texts to Python.
_LEAST_RANGE = 24


@cache
def unsettled() -> str:
    """Pattern of a character that NFKC may change.

    All others are their own NFKC, are no combining marks and never join one before them, so
    a text of them alone stays as it is.
    """
    # No character beyond has a decomposition.
    second = {ord(d[-1]) for c in range(0x30000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1}
    ranges, first = [], None
    for c in range(0x10001):
        ch = chr(c)
        # Unassigned characters may get a meaning in Java's or Python's next Unicode version.
        settled = (
            c < 0x10000 and unicodedata.category(ch) not in ("Cn", "Cs", "Co", "Mn", "Mc", "Me")
            and not unicodedata.combining(ch) and c not in second and unicodedata.normalize("NFKC", ch) == ch
        )
        if settled and first is None:
            first = c
        elif not settled and first is not None:
            if c - first >= _LEAST_RANGE:
                ranges.append(f"\\x{{{first:X}}}-\\x{{{c - 1:X}}}")
            first = None
    # Each look back tests one small class; one class of all ranges costs a call per range and character.
    groups = ["".join(ranges[i : i + 8]) for i in range(0, len(ranges), 8)]
    return r"[^\x00-\x7F]" + "".join(f"(?<![{g}])" for g in groups)


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC.  Only rows with characters that it may change are sent to Python."""
    foreign = F.when(text.rlike(unsettled()), text)
    return F.coalesce(_nfkc(foreign), text)


def normalize_text(text: Column) -> Column:
    """NFKC and lower case."""
    return F.lower(nfkc(text))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(trim_spaces(text), r"(?U)\s+", " ")


def trim_spaces(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def text_fingerprint(text: Column, hint: Column, category: Column) -> Column:
    """Hash of language hint and normalised text, with the user's category as suffix."""
    words = F.coalesce(collapse_spaces(normalize_text(text)), F.lit("\0"))
    digest = F.sha2(F.concat(F.coalesce(hint, F.lit("auto")), F.lit("\0"), words), 256)
    # Never null, and known not to be: otherwise a join on it filters for null, and
    # that filter computes the whole fingerprint a second time.
    return F.coalesce(F.concat(digest, F.coalesce(F.concat(F.lit("_"), category), F.lit(""))), F.lit(""))


# -- keywords ------------------------------------------------------------------------


def _fold(phrase: str) -> str:
    return unicodedata.normalize("NFKC", phrase).lower()


def _is_word(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LN"


def _keyword_table() -> dict[str, list[tuple[str, str, str]]]:
    """For each folded phrase, the entries that hit where it hits: shorter ones that end inside it, then itself."""
    first: dict[str, tuple[str, str, str]] = {}
    for phrase, category, language in domain.KEYWORDS:
        first.setdefault(_fold(phrase), (phrase, category, language))
    inside = {
        folded: sorted(
            (p for p in first if folded.startswith(p) and p != folded and not _is_word(folded[len(p)])), key=len
        )
        for folded in first
    }
    return {folded: [first[p] for p in (*inside[folded], folded)] for folded in first}


def _any_of(phrases: list[str]) -> str:
    """Pattern of any of the phrases, longer ones first, in which common beginnings are tried once."""
    rest: dict[str, list[str]] = {}
    for phrase in phrases:
        if phrase:
            rest.setdefault(phrase[0], []).append(phrase[1:])
    branches = [re.escape(first) + _any_of(some) for first, some in rest.items()]
    if "" in phrases:
        branches.append("")
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _first_of(phrases: list[str]) -> str:
    """Class of two ranges with all first characters: a cheap test that comes before dear ones."""
    ascii, others = (sorted(p[0] for p in phrases if p[0].isascii() == wanted) for wanted in (True, False))
    return f"[{ascii[0]}-{ascii[-1]}{others[0]}-{others[-1]}]"


_KEYWORDS = _keyword_table()
#: One zero-width match per word start; the longest phrase that ends at a word end is captured.
KEYWORD_PATTERN = (
    rf"(?<![a-z])(?={_first_of([*_KEYWORDS])})(?<!{_WORD})(?=({_any_of([*_KEYWORDS])})(?!{_WORD}))"
)


#: The table as one SQL map: a few hundred literals are slow to build one Column at a time.
_KEYWORD_MAP = "map({})".format(
    ", ".join(
        f"'{folded}', array({', '.join(f"struct('{p}' AS phrase, '{c}' AS category, '{g}' AS language)" for p, c, g in hits)})"
        for folded, hits in _KEYWORDS.items()
    )
)


def keyword_hits(text: Column) -> Column:
    """All dictionary hits in text order, as array<struct<phrase, category, language>>."""
    entry = F.expr(_KEYWORD_MAP)
    found = F.regexp_extract_all(normalize_text(text), F.lit(KEYWORD_PATTERN), F.lit(1))
    return F.flatten(F.transform(found, lambda phrase: entry[phrase]))


def _most_frequent(values: Column) -> Column:
    """Most frequent value; of equals, the one seen first.  Only values that occur are counted."""

    def rank(value: Column) -> Column:
        return F.struct(
            F.size(F.filter(values, lambda v: v == value)).alias("n"),
            (-F.array_position(values, value)).alias("at"),
            value.alias("value"),
        )

    return F.array_max(F.transform(F.array_distinct(values), rank))["value"]


def keyword_summary_parts(hits: Column) -> Column:
    """struct<category, language, confidence, summary> of a hit array, or null without hits."""
    category = let(F.transform(hits, lambda h: h["category"]), _most_frequent)
    language = let(F.transform(hits, lambda h: h["language"]), _most_frequent)

    def describe(winner: Column) -> Column:
        own = F.filter(hits, lambda h: h["category"] == winner["category"])
        return let(
            own,
            lambda mine: F.struct(
                winner["category"].alias("category"), winner["language"].alias("language"),
                F.least(F.lit(0.99), F.lit(0.88) + (F.size(mine) - 1) * F.lit(0.04)).alias("confidence"),
                F.concat(
                    F.lit("Citizen reported a "), winner["category"], F.lit(" issue ("),
                    F.element_at(mine, -1)["phrase"], F.lit(")."),
                ).alias("summary"),
            ),
        )

    winners = F.struct(category.alias("category"), language.alias("language"))
    return F.when(F.size(hits) > 0, let(winners, describe))


def keyword_classify(df, text: str = "text", into: str = "keyword"):
    """Add ``into`` = struct<category, language, confidence, summary> (null without a hit)."""
    return (
        df.withColumn("_hits", keyword_hits(F.col(text)))
        .withColumn(into, keyword_summary_parts(F.col("_hits")))
        .drop("_hits")
    )


# -- scripts -------------------------------------------------------------------------


def count_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def detect_script(text: Column) -> Column:
    """struct<code, label, confidence>: the majority script, or Hindi in Latin letters."""
    # Most texts hold no Indic character and need one scan for letters instead of ten.
    indic = let(F.array(*[_script_count(text, block, code) for block, code, _ in domain.SCRIPT_BLOCKS]), _majority)
    # All their letters are Latin then, and their share is one, however many there are.
    latin = text.rlike("[A-Za-z]").cast("int")
    plain = F.struct(latin.alias("n"), F.lit("en").alias("code"), latin.alias("letters"))
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))

    def romanised(words: Column) -> Column:
        hits = F.filter(words, lambda w: w.isin(domain.ROMANISED_HINDI))
        return F.struct(F.size(words).alias("tokens"), F.size(hits).alias("hits"))

    def decide(best: Column) -> Column:
        return F.when(best["letters"] == 0, _detected(F.lit("en"), F.lit(0.0))).when(
            best["code"] == "en", let(let(tokens, romanised), lambda t: _latin_or_hindi(best, t))
        ).otherwise(_detected(best["code"], best["n"] / best["letters"]))

    return let(F.when(text.rlike(r"[ऀ-ൿ]"), indic).otherwise(plain), decide)


def _script_count(text: Column, block: str, code: str) -> Column:
    letter = F.lit(rf"[\p{{L}}&&[{block}]]")
    # Of equal counts the script seen first wins.
    return F.struct(
        F.regexp_count(text, letter).alias("n"), (-F.regexp_instr(text, letter)).alias("at"), F.lit(code).alias("code")
    )


def _majority(counts: Column) -> Column:
    return let(
        F.array_max(counts),
        lambda top: F.struct(
            top["n"].alias("n"), top["code"].alias("code"),
            F.aggregate(counts, F.lit(0), lambda total, c: total + c["n"]).alias("letters"),
        ),
    )


def _latin_or_hindi(best: Column, tokens: Column) -> Column:
    needed = F.greatest(F.lit(2), F.ceil(tokens["tokens"] * F.lit(0.25)))
    return F.when(tokens["hits"] >= needed, _detected(F.lit("hi-Latn"), tokens["hits"] / tokens["tokens"])).otherwise(
        _detected(F.lit("en"), best["n"] / best["letters"])
    )


def _detected(code: Column, confidence: Column) -> Column:
    return F.struct(code.alias("code"), label(code, domain.SCRIPT_LABELS).alias("label"), confidence.alias("confidence"))


def _of_scripts(*scripts: str) -> str:
    """Pattern of a character of the scripts; looking up a character's script costs far more than comparing it."""
    # Cyrillic begins at U+0400, the other known scripts at U+0900.
    first = 0x400 if "IsCyrillic" in scripts else 0x900
    return rf"[[\x{{{first:X}}}-\x{{10FFFF}}]&&[{''.join(rf'\p{{{s}}}' for s in scripts)}]]"


def first_script(text: Column, hint: Column | None = None) -> Column:
    """The hint if given, else the language of the first known script present, else English."""
    found = F
    for script, code in domain.SCRIPT_ORDER:
        found = found.when(text.rlike(_of_scripts(script)), code)
    # Most texts have none of them and need one scan.
    found = F.when(text.rlike(_of_scripts(*[s for s, _ in domain.SCRIPT_ORDER])), found).otherwise("en")
    return found if hint is None else F.coalesce(hint, found)


def guess_language(text: Column, keyword_language: Column, hint: Column | None = None) -> Column:
    """Bengali, Tamil, Devanagari or Cyrillic by block, else the keyword language, else English."""
    guess = (
        F.when(text.rlike(r"[ঀ-৿]"), "bn")
        .when(text.rlike(r"[஀-௿]"), "ta")
        .when(text.rlike(r"[ऀ-ॿ]"), "hi")
        .when(text.rlike(r"[Ѐ-ӿ]"), "ru")
        .otherwise(F.coalesce(keyword_language, F.lit("en")))
    )
    return guess if hint is None else F.coalesce(hint, guess)


def guess_form_language(text: Column) -> Column:
    """Language shown while a report is typed: hi, ru, zh, pt or en."""
    # The words' first characters in both cases come first: a test without case folding.
    portuguese = text.rlike("[ãõáâàéêíóôúçÃÕÁÂÀÉÊÍÓÔÚÇ]") | text.rlike(
        r"(?=[RrÁáBbLlSsſEe])(?iu)(?<![A-Za-z0-9_])(rua|água|buraco|lixo|saúde|energia)(?![A-Za-z0-9_])"
    )
    return (
        F.when(text.rlike(r"[ऀ-ॿ]"), "hi")
        .when(text.rlike(r"[Ѐ-ӿ]"), "ru")
        .when(text.rlike(r"[㐀-鿿]"), "zh")
        .when(portuguese, "pt")
        .otherwise("en")
    )


def resolve_language(script: Column, hint: Column, text: Column) -> Column:
    """Combine the detected script with the reporter's hint."""
    return (
        F.when((script == "hi") & (hint == "mr"), "mr")
        .when((script == "hi-Latn") & hint.isin("hi", "mr"), hint)
        .when(script == "en", first_script(text, hint))
        .otherwise(script)
    )


def normalize_admin_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def strip_district_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"\s+district$", "")


def label(value: Column, labels: dict[str, str]) -> Column:
    """Map a value to its display label; unknown values give null."""
    pairs = ", ".join(f"'{key}', '{text}'" for key, text in labels.items())
    return F.element_at(F.expr(f"map({pairs})"), value)
