"""Elements of JSON documents against Python's parser, with splits of a few bytes and files larger than a VARIANT."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.sources import glh, json_elements

rng = random.Random(6)


def value(depth=0):
    kind = rng.choice(["s", "s", "n", "l", "o"] if depth < 3 else ["s", "n"])
    if kind == "s":
        return rng.choice(["", "a}b", '"', "\\", "\\\\\"}", "[x]{,", "é}\n", ", \"k\": [", "}" * 9])
    if kind == "n":
        return rng.choice([1, -2.5, True, None])
    if kind == "l":
        return [value(depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abc}"): value(depth + 1) for _ in range(rng.randint(0, 3))}


def made(kind):
    if kind == "list":
        return [value() for _ in range(30)]
    doc = {"deviceId": "x[{", "rawSignals": [value() for _ in range(20)], "profile": {"places": [{"a": [1, {"b": 2}]}, {}], "y": {"z": []}}, "n": 5, "semanticSegments": [value() for _ in range(15)], "empty": [], "odd \\ \"key\"": [1, [2], {"x": 3}], "last": None}
    return dict(rng.sample(sorted(doc.items()), len(doc)))


@pytest.mark.parametrize("small", [True, False])
def test_against_a_parser(spark, tmp_path, monkeypatch, small):
    docs = {}
    for i in range(4):
        docs[f"f{i}.json"] = made("list" if i % 2 else "object")
        (tmp_path / f"f{i}.json").write_text(json.dumps(docs[f"f{i}.json"], indent=[None, 1, 4][i % 3], ensure_ascii=bool(i % 4)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301" if small else str(128 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    if small:
        monkeypatch.setattr(json_elements, "CHUNK", 50)
        monkeypatch.setattr(json_elements, "BROADCAST_SPLITS", 3)  # states and pieces meet by a shuffle
    try:
        elements, files = json_elements.read_elements(spark, "file://" + str(tmp_path))
        rows = elements.collect()
        known = {r.file.rsplit("/", 1)[-1]: r for r in files.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted((r.file.rsplit("/", 1)[-1], r.key, r.pos, json.dumps(json.loads(r.text))) for r in rows)
    lists = [(f, "", d) if isinstance(d, list) else (f, k, v) for f, d in docs.items() for k, v in (d.items() if isinstance(d, dict) else [("", d)]) if isinstance(d, list) or isinstance(v, list)]
    assert got == sorted((f, k, i, json.dumps(v)) for f, k, own in lists for i, v in enumerate(own))
    for f, d in docs.items():
        assert known[f].root == ("[" if isinstance(d, list) else "{") and known[f].final <= 0
        if isinstance(d, dict):
            assert {k for k in d if "\\" not in k} <= set(known[f]["keys"])


def test_bytes_are_handed_on_as_they_lie():
    """A split's rows become a few arrays of bytes, not a value each."""
    rows = [("f", 0, b'[{"a":1}'), ("f", 0, b',{"b":2}'), ("g", 0, b"[{}"), ("g", 9, b"]}")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["file", "split", "piece"]) for part in (rows[:1], rows[1:])]
    got = [(key, [x.tobytes() for x in own]) for key, own in json_elements._by_split(iter(batches), 2)]
    assert got == [(("f", 0), [b'[{"a":1}', b',{"b":2}']), (("g", 0), [b"[{}"]), (("g", 9), [b"]}"])]
    sliced = batches[1].slice(1)
    assert [(key, [x.tobytes() for x in own]) for key, own in json_elements._by_split(iter([sliced]), 2)] == got[1:]


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "odd.json").write_bytes(b'[{"a":"\xff"},"\xc3\xa9", 1]')
    elements, _ = json_elements.read_elements(spark, "file://" + str(tmp_path / "odd.json"))
    assert sorted((r.pos, r.text.strip()) for r in elements.collect()) == [(0, '{"a":"\ufffd"}'), (1, '"é"'), (2, "1")]


@pytest.mark.parametrize("text", ['[{"a": 1}, {"b": ', '{"rawSignals": [{"position": {', '{"other": [1]}', "3"])
def test_bad_files(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(ValueError, match="not a location-history export"):
        glh.parse_glh(spark, "file://" + str(tmp_path / "bad.json"))


def test_larger_than_a_variant(spark, tmp_path):
    """An export of one line of 150 MB, beyond what one VARIANT holds: many tasks read it, ordinals are those of the file."""
    path, n, note = tmp_path / "big.json", 1500, "x}" + "y" * 100_000
    with path.open("w") as out:
        out.write('{"semanticSegments":[')
        for i in range(n):
            out.write(("," if i else "") + f'{{"startTime":"2024-01-01T00:00:00Z","note":"{note}","timelinePath":[{{"point":"55.{i:04d},-3.1"}}]}}')
        out.write("]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 << 20))
    try:
        with pytest.raises(Exception, match="(?i)variant"):
            glh.read_exports(spark, "file://" + str(path)).select(F.schema_of_variant("doc")).collect()
        assert json_elements.splits(spark, "file://" + str(path)).select("split").distinct().count() >= 9
        found = glh.parse_glh(spark, "file://" + str(path)).timeline_paths.select("segment_id", "lat").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.segment_id, r.lat) for r in found) == [(i, float(f"55.{i:04d}")) for i in range(n)]
