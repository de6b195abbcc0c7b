"""Unicode NFKC: which texts need Python, and that all come out as Python gives them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from wardlight.functions import text as tx


def test_nfkc_of_every_character(spark):
    """Each character alone, between letters and before a mark or letter that it may join."""
    chars = [chr(c) for c in [*range(0x20, 0xD800), *range(0xE000, 0x10000), 0x1D15E, 0x1F600, 0x2F800]]
    texts = [t for c in chars for t in (f"a{c}b", f"{c}́", f"ᄀ{c}")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.nfkc(F.col("t")).alias("n")).collect()
    assert [r.t for r in rows if r.n != unicodedata.normalize("NFKC", r.t)] == []


def test_settled_texts_stay_in_the_jvm(spark, monkeypatch):
    """Composed letters of any script are not sent to Python."""

    @F.pandas_udf("string")
    def fail(texts: pd.Series) -> pd.Series:
        assert texts.isna().all()
        return texts

    monkeypatch.setattr(tx, "_nfkc", fail)
    texts = ["Água suja na estrada", "Вода и свет: дорога, яма й", "水 道路", "plain", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(tx.nfkc(F.col("t")).alias("n")).collect()] == texts
