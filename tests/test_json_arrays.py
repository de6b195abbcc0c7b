"""Splittable JSON arrays: the same elements whatever the splits."""

from __future__ import annotations

import json
import random

import pytest

from wardlight.sources import tables
from wardlight.sources.json_arrays import read_elements


@pytest.fixture
def splits(spark):
    """Files are read in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def objects(n, seed=1):
    rng = random.Random(seed)
    texts = ["plain", 'a "quoted" } brace', "back\\slash\\", "{[}]", 'ends with \\"', "日本 } ü", "", "line\nbreak"]
    return [
        {"id": i, "text": rng.choice(texts) * rng.randrange(4), "in": {"list": [{"x": rng.choice(texts)}, [1, {}]], "e": {}}} for i in range(n)
    ]


def read(spark, path):
    return sorted((json.loads(r.element) for r in read_elements(spark, str(path)).collect()), key=lambda o: o["id"])


@pytest.mark.parametrize("size", [150, 10**7])
@pytest.mark.parametrize("indent", [None, 2])
def test_any_splits(spark, tmp_path, splits, size, indent):
    rows = objects(60)
    (tmp_path / "a.json").write_text(json.dumps(rows[:50], indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(" \n" + json.dumps(rows[50:]) + "\n")
    (tmp_path / "empty.json").write_text("[]")
    splits(size)
    assert read(spark, tmp_path) == rows


def test_one_array_is_read_by_many_tasks(spark, tmp_path, splits):
    rows = objects(4000)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows))
    splits(path.stat().st_size // 12)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 8
    assert read(spark, path) == rows


@pytest.mark.parametrize("cut", [1, 2, 5, 30])
@pytest.mark.parametrize("size", [60, 10**6])
def test_broken_arrays_keep_the_rows_before(spark, tmp_path, splits, cut, size):
    rows = [{"id": f"r{i}", "lat": 1.5, "lng": 2.25, "severity": 3, "tags": ["a}", "b"]} for i in range(12)]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(rows)[:-cut])
    splits(size)
    good, bad = tables.split_complaints(spark, str(path))
    kept = 12 if cut == 1 else 11
    assert sorted(r.id for r in good.collect()) == sorted(f"r{i}" for i in range(kept))
    assert [r.reason for r in bad.collect()] == ["malformed"] * (12 - kept)


def test_other_elements_are_rejected(spark, tmp_path, splits):
    splits(30)
    path = tmp_path / "d.json"
    path.write_text('[1, {"id": "a", "lat": 1, "lng": 2, "severity": 3}, "x", {"id": "b", "lat": 1, "lng": 2, "severity": 3}, null]')
    good, bad = tables.split_complaints(spark, str(path))
    assert sorted(r.id for r in good.collect()) == ["a", "b"]
    assert sorted(r.record for r in bad.collect()) == ['"x"', "1", "null"]
