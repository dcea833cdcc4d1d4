import json
import random

import pytest
from pyspark.sql import functions as F

from chronofold.sources import files, json_records as R

STRINGS = ["", "a}b", "]", '"', "\\", "\\\\", "{[,", "x\ny", " } , ] ", "é漢𝔸", '\\"}', ": \"}"]


def value(rnd, deep=3):
    k = rnd.randrange(6 if deep else 4)
    if k == 0:
        return rnd.choice(STRINGS)
    if k == 1:
        return rnd.choice([1, -2.5, True, None])
    if k == 2:
        return rnd.choice(STRINGS) * rnd.randrange(12)
    if k == 3:
        return {}
    if k == 4:
        return [value(rnd, deep - 1) for _ in range(rnd.randrange(4))]
    return {rnd.choice(STRINGS) + str(i): value(rnd, deep - 1) for i in range(rnd.randrange(4))}


def read(spark, path, size, depth):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        d = R.read_documents(spark, path, depth)
        return [r for r in d.members.collect()], sorted(d.frames.collect(), key=lambda r: (r.file, r.block, r.n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def arrays(members, file):
    out = {}
    for r in sorted(members, key=lambda r: r.pos):
        if r.file.endswith(file):
            out.setdefault(r.array, []).append((r.pos, r.text))
    assert all([p for p, _ in xs] == list(range(len(xs))) for xs in out.values())
    return lambda frame_array: [json.loads(t) for _, t in out.get(frame_array[0], [])]


@pytest.mark.parametrize("size,slab", [(250, 30), (1 << 27, 64)])
def test_members_are_those_of_a_json_parser(spark, tmp_path, monkeypatch, size, slab):
    monkeypatch.setattr(R, "SLAB", slab)
    rnd = random.Random(size)
    docs = {}
    for name in "ab":
        docs[name] = [{"head": {"vars": ["p", "q"], "}": "{["}, "n": 3, "results": {"x": value(rnd), "bindings": [value(rnd) for _ in range(rnd.choice((0, 1, 30)))], "y": "z}"}}
                      for _ in range(3)]
        text = "".join(json.dumps(d, indent=rnd.choice((None, 2)), ensure_ascii=rnd.random() < 0.5) + rnd.choice(["", "\n", " \n"]) for d in docs[name])
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    members, frames = read(spark, str(tmp_path), size, 3)
    for name in "ab":
        mine = [json.loads(f.text) for f in frames if f.file.endswith(f"{name}.json")]
        by_array = arrays(members, f"{name}.json")
        assert len(mine) == 3
        for frame, doc in zip(mine, docs[name]):
            assert frame["n"] == 3 and frame["results"]["y"] == "z}" and frame["head"]["}"] == "{["
            assert by_array(frame["results"]["bindings"]) == doc["results"]["bindings"]
            assert by_array(frame["head"]["vars"]) == ["p", "q"]


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_lists_and_nested_arrays(spark, tmp_path, size):
    rnd = random.Random(7)
    rows = [value(rnd) for _ in range(60)]
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    members, frames = read(spark, str(tmp_path / "list.json"), size, 1)
    assert arrays(members, "list.json")(json.loads(frames[0].text)) == rows
    sets = [{"id": f"s{i}", "lanes": [{"no": j, "t": rnd.choice(STRINGS)} for j in range(i * 3)], "name": rnd.choice(STRINGS)} for i in range(6)]
    (tmp_path / "sets.json").write_text(json.dumps({"lanesets": sets}))
    members, frames = read(spark, str(tmp_path / "sets.json"), size, 4)
    by_array, got = arrays(members, "sets.json"), json.loads(frames[0].text)["lanesets"]
    assert [{**s, "lanes": by_array(s["lanes"])} for s in got] == sets


def test_one_long_document_takes_many_tasks(spark, tmp_path):
    n = 60_000
    features = ({"type": "Feature", "properties": {"CONTINENT": "Asia", "SUBREGION": f"sub {i}"},
                 "geometry": {"type": "Polygon", "coordinates": [[[i % 50, 0], [i % 50 + 1, 0], [i % 50, 1], [i % 50, 0]]]}} for i in range(n))
    path = tmp_path / "countries.json"
    path.write_text('{"type":"FeatureCollection","features":[\n' + ",\n".join(map(json.dumps, features)) + "\n]}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        c = files.read_countries(spark, str(path))
        assert R._pieces(spark, str(path)).select("block").distinct().count() > 8
        assert c.agg(F.count("*"), F.countDistinct("source_order"), F.max("source_order"), F.min(F.size("polygons"))).first()[:] == (n, n, n - 1, 1)
        assert c.filter(F.concat(F.lit("sub "), "source_order") != F.col("subregion")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_files_and_documents(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text('{"features": [ ]}')
    members, frames = read(spark, str(tmp_path), 1 << 20, 2)
    assert members == [] and [json.loads(f.text) for f in frames] == [{"features": ["0:1"]}]
