from __future__ import annotations

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from lumidex.common import decode
from lumidex.operators import nested
from lumidex.plans import training

DDL = "id bigint, info string, exif string, node string, parent string"


def brute(cell: str, root: str):
    """Objects below the top, by plain recursion."""
    try:
        top = json.loads(cell)
        top = json.loads(top) if isinstance(top, str) else top
    except (ValueError, TypeError):
        return []
    out = []

    def visit(value, node, parent):
        if isinstance(value, dict):
            if node != root:
                out.append((node, parent))
            for k, v in value.items():
                visit(v, f"{node}.{k}", node)
        elif isinstance(value, list):
            for n, v in enumerate(value):
                visit(v, f"{node}[{n}]", parent)

    visit(top, root, root)
    return out


CELLS = [
    None, "", "   ", "null", "3", '"text"', "{", '{"a": {"b": [{"c": {}}, 1, null, [{"d": 1}]]}}', json.dumps(json.dumps({"x": [{"y": {}}]})),
    '[{"a": 1}, [{"b": {}}]]', '{"k": {"a": 1}, "k": {"b": {}}}', '{"a": "' + "long " * 50_000 + '", "b": [{}]}', '{"s": "\\ud800", "o": {}}', "[" * 5_000,
]


def test_nodes_match_plain_recursion_and_odd_cells_hold_nothing(spark):
    rows = [(i, c, CELLS[-1 - i], "clash", "clash") for i, c in enumerate(CELLS)]
    found = nested.nodes(spark.createDataFrame(rows, DDL), ["info", "exif"]).collect()
    expected = Counter((i, *x) for i, a, b, *_ in rows for cell, root in ((a, "info"), (b, "exif")) for x in brute(cell or "", root))
    assert Counter(map(tuple, found)) == expected and expected


def test_nodes_match_plain_recursion_on_the_table(spark, small):
    images = spark.read.parquet(f"{small}/images.parquet")
    expected = Counter((r["id"], *x) for r in images.collect() for root in ("info", "exif") for x in brute(r[root] or "", root))
    assert Counter(map(tuple, nested.nodes(images, ["info", "exif"]).collect())) == expected


def test_triples_rebuild_every_value(spark):
    value = {"a": [1, "x", None, True, {"b": 2.5}], "c": {}}
    rows = nested.triples(spark.createDataFrame([(1, json.dumps(value))], "id bigint, info string"), ["info"]).collect()
    flat = {(r["node"], r["kind"]): r["value"] for r in rows}
    assert flat[("info.a[0]", "number")] == "1" and flat[("info.a[1]", "string")] == "x" and flat[("info.a[2]", "null")] is None
    assert flat[("info.a[3]", "bool")] == "true" and flat[("info.a[4].b", "number")] == "2.5" and ("info.c", "object") in flat
    assert [r["ordinals"] for r in rows if r["node"] == "info.a[4].b"] == [[4]]


def test_rows_link_children_to_parents(spark):
    value = {"t": "top", "s": [{"n": "one", "box": {"x": 5}, "p": [{"q": 1}, {"q": 2}]}, {"n": "two", "tags": ["u", "v"]}]}
    rows = nested.rows(spark.createDataFrame([(7, json.dumps(value))], "id bigint, info string"), ["info"]).cache()
    s = nested.pivot(rows, "info.s[]", ["n", "box.x"]).orderBy("row_key").collect()
    assert [tuple(r) for r in s] == [(7, "0", "", "one", "5"), (7, "1", "", "two", None)]
    p = nested.pivot(rows, "info.s[].p[]", ["q"]).orderBy("row_key").collect()
    assert [tuple(r) for r in p] == [(7, "0.0", "0", "1"), (7, "0.1", "0", "2")]
    assert {r["cols"]["value"] for r in rows.filter(F.col("rel") == "info.s[].tags[]").collect()} == {"u", "v"}
    counts = {(r["rel"], r["col"]): r["n_rows"] for r in nested.catalog(rows).collect()}
    assert counts[("info.s[]", None)] == 2 and counts[("info.s[]", "n")] == 2 and counts[("info.s[].p[]", "q")] == 2


def test_empty_table_and_repeated_rows(spark):
    assert nested.nodes(spark.createDataFrame([], DDL), ["info", "exif"]).count() == 0
    twice = spark.createDataFrame([(None, '{"a": {}}', None, "", "")] * 2, DDL)
    assert [tuple(r) for r in nested.nodes(twice, ["info", "exif"]).collect()] == [(None, "info.a", "info")] * 2


def test_every_spelling_of_subjects_parts_and_marks_is_read(spark, tmp_path):
    mark = lambda n: {"kind": f"k{n}", "reading": f"r{n}"}
    part = lambda n, marks: {"name": f"p{n}", "marks": marks}
    cells = [
        {"subjects": ["plain", {"name": "s1", "parts": [part(1, [mark(1), mark(2)]), None]}]}, {"subjects": [{"name": "s2", "parts": part(2, [mark(3)])}]},
        {"subjects": {"name": "s3", "count": 2, "parts": [part(3, mark(4))]}}, {"subjects": {"name": "s4", "box": {"x": 1}, "parts": part(4, mark(5))}},
    ]
    spark.createDataFrame([(i, json.dumps(c), None) for i, c in enumerate(cells)], "id bigint, info string, exif string").write.parquet(f"{tmp_path}/images.parquet")
    marks = training.p1_all_marks(spark, tmp_path).collect()
    assert sorted(map(tuple, marks)) == [(0, "1.0.0", "1.0", "k1", "r1"), (0, "1.0.1", "1.0", "k2", "r2"), (1, "0.0.0", "0.0", "k3", "r3"), (2, "0.0.0", "0.0", "k4", "r4"), (3, "0.0.0", "0.0", "k5", "r5")]
    subjects = training.p1_all_subjects(spark, tmp_path).select("id", "row_key", "value", "name", "count", "box_x").collect()
    assert sorted(map(tuple, subjects)) == [(0, "0", "plain", None, None, None), (0, "1", None, "s1", None, None), (1, "0", None, "s2", None, None), (2, "0", None, "s3", "2", None), (3, "0", None, "s4", None, "1")]
    rows = training.p1_rows(spark, tmp_path).collect()
    parts = [r for r in rows if r["rel"] == "info.subjects[].parts[]"]
    assert {(r["id"], r["row_key"]): r["value"] for r in parts} == {(0, "1.0"): "p1", (0, "1.1"): None, (1, "0.0"): "p2", (2, "0.0"): "p3", (3, "0.0"): "p4"}
    assert {(r["id"], r["parent_key"]) for r in marks} <= {(r["id"], r["row_key"]) for r in parts}


def test_flat_rows_have_every_value_and_every_parent_on_the_table(spark, small):
    def leaves(value):
        inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
        return [value] if inner is None else [x for v in inner for x in leaves(v)]

    texts = Counter()
    for r in spark.read.parquet(f"{small}/images.parquet").collect():
        for root in ("info", "exif"):
            top = decode(r[root])
            if isinstance(top, (dict, list)):
                texts.update((r["id"], root, v if isinstance(v, str) else json.dumps(v)) for v in leaves(top) if v is not None)
    rows = training.p1_rows(spark, small).collect()
    assert Counter((r["id"], r["root"], r["value"]) for r in rows if r["value"] is not None) == texts and texts
    keys = {(r["id"], r["rel"], r["row_key"]) for r in rows}
    assert all(r["parent_rel"] is None or (r["id"], r["parent_rel"], r["parent_key"]) in keys for r in rows)


def test_keys_with_dots_brackets_and_case_stay_apart(spark, tmp_path):
    cells = ['{"a.b": 1, "a": {"b": 2}, "A.B": 5}', '{"x[]": {"y": 1}, "x": [{"y": 2}], "k\\\\": 3}', '{"k": 1, "k": {"m": 2}}', '{"n": NaN}', '{"n": [1, -Infinity]}', '{"n": 1e5, "m": -0, "o": 1.50}']
    df = spark.createDataFrame(list(enumerate(cells)), "id bigint, info string")
    shredded = nested.rows(df, ["info"])
    named = nested.write_tables(shredded, f"{tmp_path}/tables")
    assert set(named) == {"info", "info.x[]"}
    top = {r["id"]: {p: r[n] for n, p in named["info"].items() if r[n] is not None} for r in spark.read.parquet(f"{tmp_path}/tables/info").collect()}
    assert top == {0: {"a\\.b": "1", "a.b": "2", "A\\.B": "5"}, 1: {"x\\[\\].y": "1", "k\\\\": "3"}, 2: {"k.m": "2"}, 5: {"n": "100000.0", "m": "0", "o": "1.5"}}
    rows = spark.read.parquet(f"{tmp_path}/tables/info.x%5B%5D").collect()
    assert [(r["id"], r["row_key"], r["parent_key"], r["c_y"]) for r in rows] == [(1, "0", "", "2")]
    assert {(r["id"], r["node"]) for r in nested.nodes(df, ["info"]).collect()} == {(0, "info.a"), (1, "info.x[]"), (1, "info.x[0]"), (2, "info.k")}
    assert decode('{"n": NaN}') is None and decode('"[-Infinity]"') is None
    assert nested.write_tables(shredded.limit(0), f"{tmp_path}/none") == {}


def test_stream_agrees_with_a_whole_parser_on_spoiled_text():
    r = random.Random(3)

    def value(depth):
        x = r.random()
        if depth <= 0 or x < 0.3:
            return r.choice([None, True, 1, -0.0, 1.5, 'a"b\\c', "", "é ", 12345678901234567890, "x.y"])
        if x < 0.65:
            return {r.choice(["a", "b", "a.b", "x[]", "", '"', "é"]): value(depth - 1) for _ in range(r.randrange(4))}
        return [value(depth - 1) for _ in range(r.randrange(4))]

    def leaves(v, node):
        yield node, json.dumps(v) if isinstance(v, (int, float)) else v if isinstance(v, str) else None
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from leaves(x, f"{node}.{k}" if isinstance(v, dict) else f"{node}[{k}]")

    usable = 0
    for _ in range(4_000):
        cell = json.dumps(value(5), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        cell = json.dumps(cell) if r.random() < 0.2 else cell
        if r.random() < 0.5:
            k = r.randrange(len(cell))
            cell = cell[:k] + r.choice('{}[],:"\\0 1-tnu\n') + cell[k + 1 :]
        top = decode(cell)
        want = Counter(leaves(top, "info")) if isinstance(top, (dict, list)) else Counter()
        got = Counter((x[4], None if x[2] == "null" else x[3]) for x in nested.walk("info", cell))
        assert Counter({k: n for k, n in got.items()}) == Counter({(n, None if v is None else "true" if v == "True" else v): c for (n, v), c in want.items()}), cell
        usable += bool(want)
    assert usable > 1_500
