"""JSON lists read in many parts."""

import json
import random

import pytest

from certus.sources import records


def made(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return "".join(rnd.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", "\n", ":"]) for _ in range(rnd.randrange(0, 9)))
    if kind < 5:
        return rnd.choice([1, None, True, -2.5])
    if kind == 5:
        return [made(rnd, depth + 1) for _ in range(rnd.randrange(0, 4))]
    return {rnd.choice(["k", "x}", '"', "{"]) + str(i): made(rnd, depth + 1) for i in range(rnd.randrange(0, 4))}


@pytest.mark.parametrize("part", [400, 10_000_000])
def test_objects_over_many_blocks(spark, tmp_path, part):
    rnd = random.Random(part)
    want = []
    for name, indent in (("a", None), ("b", 2), ("c", None)):
        items = [made(rnd) if rnd.random() < 0.4 else {"id": f"{name}{i}", "v": made(rnd)} for i in range(60)]
        (tmp_path / f"{name}.json").write_text(json.dumps(items, indent=indent, ensure_ascii=name == "a"), encoding="utf-8")
        want += [json.dumps(x, sort_keys=True) for x in items if isinstance(x, dict)]
    one = {"id": "alone", "v": [{"x": "}"}, "]"]}
    (tmp_path / "d.json").write_text(" \n" + json.dumps(one, indent=1) + "\n")
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text("")
    want.append(json.dumps(one, sort_keys=True))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(part))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = [json.dumps(json.loads(r["value"]), sort_keys=True) for r in records.json_items(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("whole", [0, 300, 1 << 18])
def test_small_files_are_read_whole(spark, tmp_path, monkeypatch, whole):
    """Files read whole give what those read in pieces give, broken ones too."""
    monkeypatch.setattr(records, "WHOLE", whole, raising=False)
    rnd = random.Random(17)
    texts = [json.dumps([made(rnd) for _ in range(rnd.randrange(0, 12))] + [{"id": i, "x": 1.50}], indent=rnd.choice([None, 1])) for i in range(30)]
    want = [json.dumps(x, sort_keys=True) for t in texts for x in json.loads(t) if isinstance(x, dict)]
    texts += [" \n", "7", '"{}"', ' {"one": "}"} \n', '[{"a": 1}, {"b": [{}]}]x', '{"c": 1}\n{"d": 2}', '[{"e": "ü"}, 1,, {"f": "\\""}]']
    want += [json.dumps(x, sort_keys=True) for x in ({"one": "}"}, {"a": 1}, {"b": [{}]}, {"c": 1}, {"d": 2}, {"e": "ü"}, {"f": '"'})]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
    got = [json.dumps(json.loads(r["value"]), sort_keys=True) for r in records.json_items(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_objects_of_a_text():
    assert records.objects('[1, {"a": 1.50}, [{"b": 2}], {}] ') == ['{"a": 1.50}', "{}"]
    assert records.objects("") == records.objects("[]") == records.objects('"{}"') == [] and records.objects('{"x": NaN}') == ['{"x": NaN}']
    assert all(records.objects(t) is None for t in ("[", "[1", "[1,]", "{} {}", "[1] 2", "]", "[" * 100_000, "{'a': 1}"))
