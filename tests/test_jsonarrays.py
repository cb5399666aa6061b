import json
import random

import pytest

from seriesloom.operators.skew import DEFAULT_LIMITS, Limits
from seriesloom.sources.jsonarrays import read_json_objects

SCHEMA = "id int, name string, `in` struct<x double, l array<struct<q string>>>"
SIGNS = ["{", "}", '"', "\\", "a", "é", ",", "[", "]", "\n", '\\"', "}{"]


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(12)))
        out.append({"id": i, "name": name, "in": {"x": rng.random(), "l": [{"q": "}"}] * rng.randrange(3)}})
    return out


def found(df):
    return sorted((r["id"], r["name"], r["in"]["x"], len(r["in"]["l"])) for r in df.collect())


def wanted(objects):
    return [(o["id"], o["name"], o["in"]["x"], len(o["in"]["l"])) for o in objects]


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, Limits(broadcast_bytes=0)])
@pytest.mark.parametrize("indent", [None, 1])
def test_any_cut_gives_all_objects(spark, tmp_path, indent, limits):
    objects = made(150, 3)
    objects[50]["name"] = '{}"\\' * 800  # one object across many splits
    path = tmp_path / "a.json"
    path.write_text(json.dumps(objects, indent=indent, ensure_ascii=False), encoding="utf-8")
    for size in (311, 1 << 20):
        df = read_json_objects(spark, str(path), SCHEMA, split_bytes=size, limits=limits)
        assert found(df) == wanted(objects)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(made(300, 4)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = read_json_objects(spark, str(tmp_path / "a.json"), SCHEMA, split_bytes=2000)
    folder = df.inputFiles()[0].rsplit("/", 1)[0]
    parts = {r["path"] for r in spark.read.parquet(folder).selectExpr("input_file_name() AS path").distinct().collect()}
    assert len(parts) > 4 and df.count() == 300
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_layouts_and_edges(spark, tmp_path):
    read = lambda name, text: (tmp_path / name).write_text(text) and read_json_objects(spark, str(tmp_path / name), "a int, b string")
    assert read("empty.json", " ").count() == 0 and read("none.json", "[]\n").count() == 0
    lines = read("lines.json", '{"a":1}\n{"a":2,"b":"x","c":[{}]}\n[{"a":3}][{"a":4}, null, 7, {"a":5}]')
    assert sorted(map(tuple, lines.collect())) == [(1, None), (2, "x"), (3, None), (4, None), (5, None)]
    assert [tuple(r) for r in read("bad.json", '[{"a": nothing}]').collect()] == [(None, None)]
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text(json.dumps([{"a": i, "b": "{"}, {"a": i}]))
    got = read_json_objects(spark, str(folder), "a int, b string", split_bytes=9)
    assert sorted((r["a"], r["b"] or "") for r in got.collect()) == [(i, b) for i in range(3) for b in ("", "{")]
