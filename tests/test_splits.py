from __future__ import annotations

import json
import random

import pytest

from glosslake.sources import files, json_splits


def hard_text(r):
    return "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "😀", "a", " ", '"items": [', "\n"]) for _ in range(r.randrange(30)))


def batch(r, n):
    items = [r.choice([{"text": hard_text(r)}, {"x": [1, {"text": "no"}], "text": hard_text(r)}, {}, {"text": 5}, {"text": None}, 7, "text", None, []]) for _ in range(n)]
    return items, {"model": hard_text(r), "other": {"items": [1, [2]]}, "list": ["items", [3]], "items": items, "after": hard_text(r), "tail": [4]}


@pytest.mark.parametrize("seed", range(4))
def test_items_are_alike_for_any_splits(spark, tmp_path, seed):
    r = random.Random(seed)
    items, whole = batch(r, 60)
    path = tmp_path / "b.json"
    path.write_text(json.dumps(whole, ensure_ascii=bool(seed % 2), indent=r.choice([None, 1])), encoding="utf-8")
    size = path.stat().st_size
    for n in (1, 7):
        got = json_splits.read_items(spark, str(path), split_bytes=-(-size // n)).orderBy("ordinal").collect()
        assert [x["ordinal"] for x in got] == list(range(60)) and [json.loads(x["value"]) for x in got] == items
    texts = [x["text"] for x in files.read_batch(spark, str(path), -(-size // 7)).orderBy("item").collect()]
    assert texts == [i["text"] if isinstance(i, dict) and isinstance(i.get("text"), str) else None for i in items]


def test_every_cut_of_a_short_batch():
    """The passes in plain Python, at every place where a file can be cut."""
    import io

    r = random.Random(5)
    for _ in range(20):
        items, whole = batch(r, 4)
        raw = json.dumps(whole, ensure_ascii=False).encode()
        for cut in range(1, len(raw)):
            at = json_splits._cut(io.BytesIO(raw), cut, len(raw))
            inside, depth, key, got = False, 0, None, []
            for data, more in ((raw[:at], lambda at=at: iter([raw[at : at + 3], raw[at + 3 :]])), (raw[at:], lambda: iter([]))):
                got += json_splits._elements(data, inside, depth, key, "items", more)
                name, _, _ = json_splits._outline(data, inside, depth, "items", more)
                key = name if name is not None else key
                inside, step = json_splits._effect(data, inside)
                depth += step
            assert [json.loads(x) for x in got] == items and not inside and depth == 0


@pytest.mark.parametrize("text", ['{"items": 3}', '{"items": {"items2": []}}', "[]", "{}", '{"x": {"items": []}}', '{"items": [1', '{"items": "["}', ""])
def test_what_is_no_batch(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    for size in (9, 1000):
        with pytest.raises(Exception, match="batch"):
            json_splits.read_items(spark, str(tmp_path / "b.json"), split_bytes=size)


def test_an_empty_list_and_broken_elements(spark, tmp_path):
    (tmp_path / "b.json").write_text(' { "items" : [ ] } ')
    assert json_splits.read_items(spark, str(tmp_path / "b.json"), split_bytes=4).count() == 0
    (tmp_path / "b.json").write_text('{"items": [{"text": oops}]}')
    with pytest.raises(Exception, match="JSON"):
        json_splits.read_items(spark, str(tmp_path / "b.json")).collect()


def test_lines_are_alike_for_any_splits(spark, tmp_path):
    r = random.Random(3)
    want = []
    for name in ("b.jsonl", "a.jsonl", "c.txt"):
        lines = [r.choice(["", "  ", "# no", "  # no", json.dumps({"pattern": "doi", "text": "é" * r.randrange(40)}, ensure_ascii=False)]) for _ in range(50)]
        (tmp_path / name).write_bytes(r.choice([b"\n", b"\r\n"]).join(x.encode() for x in lines) + (b"" if r.random() < 0.5 else b"\n"))
        want.append((name, [x for x in lines if x.strip() and not x.strip().startswith("#")]))
    expected = [x for name, lines in sorted(want) if name.endswith(".jsonl") for x in lines]
    for size in (150, 10**6):
        got = json_splits.read_lines(spark, str(tmp_path), size).orderBy("ordinal").collect()
        assert [x["value"] for x in got] == expected and [x["ordinal"] for x in got] == list(range(len(expected)))
    gold = files.read_gold(spark, str(tmp_path), 64).orderBy("example").collect()
    assert [x["text"] for x in gold] == [json.loads(x)["text"] for x in expected] and {x["pattern"] for x in gold} == {"doi"}
    (tmp_path / "none").mkdir()
    assert files.read_gold(spark, str(tmp_path / "none")).count() == 0


def test_vectors_in_splits(spark, tmp_path):
    items = [{"keyword": f"k{i}", "vector": [i / 8, -1.5]} for i in range(30)]
    (tmp_path / "i.json").write_text(json.dumps({"model": "m", "dimensions": 2, "items": items}))
    for size in (300, 10**6):
        got = files.read_vectors(spark, str(tmp_path / "i.json"), size).orderBy("ord").collect()
        assert [(x["keyword"], list(x["vector"])) for x in got] == [(x["keyword"], x["vector"]) for x in items]
