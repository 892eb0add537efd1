"""One JSON object split over many tasks, against the whole-text path at every cut."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.sources import bigjson, files

TRICKY = {
    "plain": {"a": "1", "b": "two"}, "quotes": {"q": 'say "hi", {x} [y]', "back\\slash": "\\\\\" } , {"},
    "": {"empty": ""}, "nested }{,": {"k,": "}],", "é漢字 😀": "ü\n\t\"\\"}, "ends in \\": {"x": "\\", "y": "\\\\"},
    "last": {"deep": "a" * 90 + "}" * 20 + "\"" * 5}}
KIND = T.MapType(T.StringType(), T.StringType())


def _file(text):
    path = os.path.join(tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp"), "x.json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _rows(df):
    return [(r["file_pos"], r["name"], r["value"]) for r in df.orderBy("file_pos").collect()]


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def at(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return spark
    yield at
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_equals_the_whole_text_path_at_many_cuts(small_splits, indent):
    text = json.dumps(TRICKY, ensure_ascii=False, indent=indent) + ("\n" if indent else "")
    path = _file(text)
    for size in (len(text) * 2, 97, 41, 23, 7):
        spark = small_splits(size)
        want = _rows(files._keyed_object(spark, path, KIND))
        got = bigjson.read_keyed(spark, path, KIND)
        assert _rows(got) == want and [n for _, n, _ in want] == list(TRICKY)
    assert {n: v for _, n, v in want} == TRICKY


def test_every_cut_of_the_bytes_settles():
    """The summaries under both assumptions, joined at any byte that follows a "}", give the state of the whole."""
    import numpy as np
    raw = json.dumps(TRICKY, ensure_ascii=False).encode()
    data = np.frombuffer(raw, np.uint8)
    _, step, ends = bigjson._structure(data, False)
    assert step.sum() == 0 and not ends
    for cut in [i + 1 for i, b in enumerate(raw) if b == ord("}")]:
        _, first, open_ = bigjson._structure(data[:cut], False)
        _, second, end = bigjson._structure(data[cut:], open_)
        assert np.array_equal(np.concatenate([first, second]), step) and end == ends


def test_many_tasks_read_one_file(small_splits):
    spark = small_splits(2000)
    big = {f"d{i}": {"text": f"value {i}, " + "}" * (i % 4), "n": str(i)} for i in range(800)}
    path = _file(json.dumps(big))
    lines = spark.read.option("lineSep", "}").text(path)
    assert lines.rdd.getNumPartitions() > 15
    got = bigjson.read_keyed(spark, path, KIND)
    assert {n: v for _, n, v in _rows(got)} == big and [p for p, _, _ in _rows(got)] == list(range(800))


@pytest.mark.parametrize("text", ["{}", " { } \n", '{"a": {}}'])
def test_small_objects(spark, text):
    got = _rows(bigjson.read_keyed(spark, _file(text), KIND))
    assert got == ([(0, "a", {})] if "a" in text else [])


def test_positions_do_not_depend_on_packing(small_splits):
    folder = tempfile.mkdtemp(prefix="turnwise-test-", dir="/tmp")
    n = 0
    for name, rows in (("b", 300), ("a", 5), ("c", 40)):
        os.makedirs(f"{folder}/x.jsonl", exist_ok=True)
        with open(f"{folder}/x.jsonl/{name}.jsonl", "w") as f:
            for i in range(rows):
                f.write(json.dumps({"dialogue_name": f"{name}{i}", "turns": []}) + "\n")
                n += 1
    want = [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(300)] + [f"c{i}" for i in range(40)]
    for size in (100_000, 3000, 500):
        d = files.read_dialogues(small_splits(size), f"{folder}/x.jsonl")
        got = d.select("file_pos", "dialogue_name").orderBy("file_pos").collect()
        assert [r["dialogue_name"] for r in got] == want and [r["file_pos"] for r in got] == list(range(n))
    assert d.agg(F.countDistinct("file_pos")).head()[0] == n
