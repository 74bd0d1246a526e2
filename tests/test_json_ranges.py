"""JSON arrays of one file cut by many tasks equal the reader of whole files."""

import json
import random

import pytest

from alertweave.sources import json_ranges, readers


@pytest.fixture()
def small_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0",
             "spark.sql.files.minPartitionNum": "1"}
    for key, value in sizes.items():
        spark.conf.set(key, value)
    yield
    for key in sizes:
        spark.conf.unset(key)


def rows(df, exact=True):
    """Rows by file; positions of lines of large files only order them."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.pos)):
        out.setdefault(r.path.rsplit("/", 1)[1], []).append((r.pos if exact else None, r.document, r.error))
    return out


def value(pick, depth=0):
    kinds = ["s", "n", "b"] + ["o", "a"] * (depth < 3)
    kind = pick.choice(kinds)
    if kind == "s":
        return "".join(pick.choices(['"', "\\", ",", "[", "]", "{", "}", "é", "\n", " ", "word", "\\\""], k=pick.randint(0, 9)))
    if kind == "n":
        return pick.randint(-5, 10**9)
    if kind == "b":
        return pick.choice([True, False, None])
    if kind == "o":
        return {f"k{i},": value(pick, depth + 1) for i in range(pick.randint(0, 4))}
    return [value(pick, depth + 1) for _ in range(pick.randint(0, 4))]


def test_arrays_equal_the_whole_file_reader(spark, tmp_path, small_splits):
    for seed in range(5):
        pick = random.Random(seed)
        made = [{"id": i, "v": value(pick)} if seed != 3 else value(pick) for i in range(25)]
        text = json.dumps(made, indent=pick.choice([None, 1]), ensure_ascii=seed % 2 == 0)
        (tmp_path / f"f{seed}.json").write_text(text, encoding="utf-8")
    (tmp_path / "long.json").write_text(json.dumps([{"t": 'x, "y" ]' * 300}, {"t": "z"}, {"t": ",[" * 400}]))
    (tmp_path / "none.json").write_text(" [ \n ] ")
    (tmp_path / "bom.json").write_text('﻿ [{"a": 1}, {"b": [2, 3]}]\n')
    want = rows(readers.read_logs(spark, str(tmp_path)))
    got = readers.read_logs(spark, str(tmp_path), large=0)
    assert rows(got) == want and len(want) == 7
    assert json_ranges.split_pieces(spark, [str(tmp_path)]).rdd.getNumPartitions() > 15


def test_other_files_are_lines_or_objects(spark, tmp_path, small_splits):
    texts = {
        "object.json": json.dumps({"a": [1, {"b": "],"}], "c": "x" * 500}, indent=2),
        "lines.json": "\n".join(json.dumps({"i": i, "t": "a, b] }"}) for i in range(30)),
        "arrays.json": "[1]\n[2, 3]\n",
        "broken.json": '[{"a": 1},\n {"b": }, {"c": 2}]',
        "open.json": '[{"a": 1},\n{"b": 2}',
        "twice.json": '[1, 2]\n, [3]',
        "bad-lines.json": '{broken\n{"a": 1}\n',
        "mixed.json": '[{"a": 1}, {"b": 2}}\n]',
        "after.json": '[{"a": 1}]\n{"b": 2}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    want = rows(readers.read_logs(spark, str(tmp_path)), exact=False)
    assert rows(readers.read_logs(spark, str(tmp_path), large=0), exact=False) == want
    assert set(want) == set(texts)


def test_no_piece_is_larger_than_an_element(spark, tmp_path, small_splits):
    made = [{"id": i, "text": "w" * 90} for i in range(400)]
    (tmp_path / "one-line.json").write_text(json.dumps(made))
    pieces = json_ranges.split_pieces(spark, [str(tmp_path)])
    assert pieces.selectExpr("max(length(value))").first()[0] < 120 and pieces.rdd.getNumPartitions() > 100
    found = rows(readers.read_logs(spark, str(tmp_path), large=1000))["one-line.json"]
    assert [json.loads(d) for _, d, _ in found] == made and [p for p, _, _ in found] == list(range(400))


@pytest.mark.parametrize("cuts", [1, 2, 3, 7])
def test_states_at_any_cut(cuts):
    """Splits of every size fold to the state that one pass over the text has there."""
    pick = random.Random(cuts)
    text = json.dumps([value(pick) for _ in range(40)])
    pieces = text.split(",")
    splits = [(("f", at), pieces[at : at + cuts]) for at in range(0, len(pieces), cuts)]
    found = []
    for (path, block), mine in splits:
        s = json_ranges.Summary()
        for piece in mine:
            s.add(piece)
        found.append((path, block, s))
    starts, shapes = json_ranges.fold(reversed(found))
    assert shapes["f"].single and shapes["f"].first == "[" and shapes["f"].last == 39
    inside = depth = element = 0
    for at, piece in enumerate(pieces):
        if at % cuts == 0:
            assert starts["f", at] == json_ranges.Start(inside, depth, element)
        skip = False
        for c in piece:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside ^= 1
            elif not inside:
                depth += (c in "[{") - (c in "]}")
        element += depth == 1 and not inside
