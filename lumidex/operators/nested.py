"""Shredding of deeply nested JSON columns into related flat tables.

Each record's text is parsed as a stream into path-value-ordinal triples. Paths are grouped
by their nearest repeated ancestor, and each group is pivoted into one table whose rows know
their parent row. A record lies in one row, so grouping happens where it is parsed: no shuffle.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Collection, Iterator

from urllib.parse import quote as url_quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumidex.common import persisted, spread

TRIPLES = "id bigint, root string, path string, ordinals array<int>, kind string, value string, node string, parent string"
#: Paths a task remembers at once.
MOST_PATHS = 65_536
ROWS = "id bigint, root string, rel string, ordinals array<int>, parent_rel string, parent_ordinals array<int>, cols map<string,string>, objects array<struct<node:string,parent:string>>"


_SPACE = r"[ \t\n\r]*+"
_TEXT = r'"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"'
#: A value: text, number or word with the separator after it, or an opening bracket with the closing one of an empty container.
_VALUE = rf"(?:(?:{_TEXT}|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)){_SPACE}([,}}\]]|\Z)|([{{\[]){_SPACE}([}}\]])?)"
_ELEMENT = re.compile(_SPACE + _VALUE)
_MEMBER = re.compile(f"{_SPACE}{_TEXT}{_SPACE}:{_SPACE}{_VALUE}")
_AFTER = re.compile(rf"{_SPACE}([,}}\]]|\Z)")
_CLOSES = {"{": "}", "[": "]"}
_SPECIAL = re.compile(r"[\\.\[\]]")


def _decoded(text: str) -> str:
    return json.loads(f'"{text}"') if "\\" in text else text


def _number(text: str) -> str:
    if text.lstrip("-").isdigit():
        return "0" if text == "-0" else text
    value = float(text)
    return text if math.isinf(value) else repr(value)


@functools.lru_cache(65_536)
def step(key: str) -> str:
    """A key as it stands in a path: with a backslash before what separates there, so that no two keys make one path."""
    return _SPECIAL.sub(r"\\\g<0>", key)


def walk(root: str, cell: str | None, lists: Collection[str] = (), keep: Collection[str] | None = None) -> list[tuple]:
    """(path, ordinals, kind, value, node, parent) of the values of a JSON text, in the order of the text.

    The text is read once from front to back and no value is built. path has '[]' for each
    list level and keys as step() writes them, ordinals the places in those lists; node has
    plain keys and the places filled in; parent is the node of the nearest enclosing object,
    root at the top. Of a repeated key the last value holds. A bare object at one of the
    paths `lists` counts as a list of one. keep restricts the kinds. Text encoded twice
    counts as once; invalid JSON, NaN and Infinity included, and scalars at the top hold nothing.
    """
    m = _ELEMENT.match(cell or "")
    if m and m[1] is not None and m[4] == "":
        cell = _decoded(m[1])
        m = _ELEMENT.match(cell)
    if not m or not m[5]:
        return []
    wanted = (lambda kind: True) if keep is None else keep.__contains__
    scalars = keep is None or not keep <= {"object", "list"}
    out: list = []
    frames: list[list] = []  # closing bracket, path, ordinals, node, owner, number of elements, where each key's values begin and end, open key and where it began
    path, ordinals, node, parent = root, (), root, root
    opens, empty, at = m[5], m[6], m.end()
    while True:
        if opens:
            if opens == "{" and path in lists:
                if wanted("list"):
                    out.append((path, ordinals, "list", None, node, parent))
                path, ordinals, node = f"{path}[]", (*ordinals, 0), f"{node}[0]"
            kind = "object" if opens == "{" else "list"
            if wanted(kind):
                out.append((path, ordinals, kind, None, node, parent))
            frames.append([_CLOSES[opens], path, ordinals, node, node if opens == "{" else parent, 0, {}, None, 0])
            after = empty
        while after and after != ",":  # a closing bracket
            if not frames or after != frames.pop()[0]:
                return []
            m = _AFTER.match(cell, at)
            if not m:
                return []
            after, at = m[1], m.end()
        if after == "" or not frames:
            return [] if frames or after else [x for x in out if x]
        frame = frames[-1]
        own, ordinals, node, parent = frame[1], frame[2], frame[3], frame[4]
        if frame[0] == "}":
            m = _MEMBER.match(cell, at)
            if not m:
                return []
            key, text, number, word, after, opens, empty = m.groups()
            key = _decoded(key)
            if frame[7] is not None:
                frame[6][frame[7]] = frame[8], len(out)
            if key in frame[6]:
                first, last = frame[6][key]
                out[first:last] = [None] * (last - first)
            frame[7], frame[8] = key, len(out)
            if opens or scalars:
                path, node = f"{own}.{step(key)}", f"{node}.{key}"
        else:
            m = _ELEMENT.match(cell, at)
            if not m:
                return []
            text, number, word, after, opens, empty = m.groups()
            if opens or scalars:
                path, ordinals, node = f"{own}[]", (*ordinals, frame[5]), f"{node}[{frame[5]}]"
            frame[5] += 1
        at = m.end()
        if not opens and scalars:
            kind = "string" if text is not None else "number" if number is not None else "null" if word == "null" else "bool"
            if wanted(kind):
                out.append((path, ordinals, kind, _decoded(text) if text is not None else _number(number) if number is not None else None if word == "null" else word, node, parent))


def _text(value: str | None) -> str | None:
    """JSON may hold lone surrogates, which no UTF-8 column can."""
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def _records(batch: pa.RecordBatch, roots: list[str]) -> Iterator[tuple]:
    ids = batch.column(0).to_pylist()
    for k, root in enumerate(roots, 1):
        for i, cell in zip(ids, batch.column(k).to_pylist()):
            if cell:
                yield i, root, cell


def _schema(ddl_like: list[tuple]) -> pa.Schema:
    return pa.schema(ddl_like)


def triples(df: DataFrame, roots: list[str], id_col: str = "id", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per value of the JSON columns `roots`: (id, root, path, ordinals, kind, value, node, parent).

    kinds restricts the rows made ('object', 'list', 'string', 'number', 'bool', 'null').
    Null, blank and invalid cells, and top-level scalars, give no rows; null ids are kept;
    repeated rows give repeated triples; other columns of df are ignored.
    """
    keep = frozenset(kinds) if kinds else None
    schema = _schema([("id", pa.int64()), ("root", pa.string()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string()), ("node", pa.string()), ("parent", pa.string())])

    def kernel(batches):
        for batch in batches:
            out = [(i, root, _text(t[0]), t[1], t[2], _text(t[3]), _text(t[4]), _text(t[5])) for i, root, cell in _records(batch, roots) for t in walk(root, cell, keep=keep)]
            columns = zip(*out) if out else [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    cells = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(r).cast("string").alias(r) for r in roots])
    return spread(cells).mapInArrow(kernel, TRIPLES)


def nodes(df: DataFrame, roots: list[str], id_col: str = "id") -> DataFrame:
    """(id, node, parent): every object below the top level, with the nearest enclosing object."""
    grouped = rows(df, roots, id_col, kinds=("object",), objects=True)
    found = grouped.select("id", "root", F.explode("objects").alias("o")).select("id", "root", "o.*")
    return found.filter(F.col("node") != F.col("root")).select("id", "node", "parent")


def relation(path: str) -> tuple[str, str]:
    """Table and column of a path: the nearest repeated ancestor, and what follows it."""
    at = path.rfind("[]")
    if at < 0:
        root, _, rest = path.partition(".")
        return root, rest
    return path[: at + 2], path[at + 2 :].lstrip(".")


def _place(path: str) -> tuple[str, str, str | None]:
    """Table and column of a path, and the table of its parent rows."""
    rel, column = relation(path)
    return _text(rel), _text(column or "value"), _text(relation(rel[:-2])[0]) if rel.endswith("[]") else None


class _Rows:
    """Rows of flat tables, column by column."""

    def __init__(self):
        self.id, self.root, self.rel, self.up = [], [], [], []
        self.own, self.own_ends, self.parent, self.parent_ends = [], [0], [], [0]
        self.keys, self.values, self.map_ends = [], [], [0]
        self.nodes, self.parents, self.object_ends = [], [], [0]

    def add(self, i, root: str, rel: str, ordinals: tuple, up: str | None, cols: dict, objects: list[tuple]) -> None:
        self.id.append(i)
        self.root.append(root)
        self.rel.append(rel)
        self.up.append(up)
        self.own += ordinals
        self.own_ends.append(len(self.own))
        if not ordinals:
            self.parent_ends[-1] = None  # the top row has no parent
        self.parent += ordinals[:-1]
        self.parent_ends.append(len(self.parent))
        self.keys += cols
        self.values += map(_text, cols.values())
        self.map_ends.append(len(self.keys))
        for node, parent in objects:
            self.nodes.append(_text(node))
            self.parents.append(_text(parent))
        self.object_ends.append(len(self.nodes))

    def batch(self) -> pa.RecordBatch:
        text = lambda x: pa.array(x, pa.string())
        ends = lambda x: pa.array(x, pa.int32())
        pairs = pa.StructArray.from_arrays([text(self.nodes), text(self.parents)], ["node", "parent"])
        columns = [
            pa.array(self.id, pa.int64()), text(self.root), text(self.rel), pa.ListArray.from_arrays(ends(self.own_ends), ends(self.own)), text(self.up),
            pa.ListArray.from_arrays(ends(self.parent_ends), ends(self.parent)), pa.MapArray.from_arrays(ends(self.map_ends), text(self.keys), text(self.values)), pa.ListArray.from_arrays(ends(self.object_ends), pairs),
        ]
        return pa.record_batch(columns, names=["id", "root", "rel", "ordinals", "parent_rel", "parent_ordinals", "cols", "objects"])


def rows(df: DataFrame, roots: list[str], id_col: str = "id", lists: Collection[str] = (), kinds: Collection[str] | None = None, objects: bool = False) -> DataFrame:
    """One row per row of the flat tables, with its values in the map `cols` and, if asked for, its objects (node, parent) in `objects`.

    rel is the table (the repeated ancestor's path), ordinals the row's key within id,
    parent_rel and parent_ordinals the parent row; elements of lists of scalars, and
    nulls in lists, have the single column 'value'. Null fields are left out of cols;
    columns are named by step(). Records without usable JSON give no rows. A bare object
    at one of the paths `lists` is the one row of that list's table. kinds restricts the
    values read, as for triples.
    """
    keep = frozenset(kinds) if kinds else None

    def kernel(batches):
        known: dict[str, tuple] = {}  # what a path says of its rows: table, column, the parent's table
        for batch in batches:
            out = _Rows()
            for i, root, cell in _records(batch, roots):
                tables: dict[tuple, tuple[dict, list]] = {}
                for path, ordinals, kind, value, node, parent in walk(root, cell, lists, keep):
                    if path not in known:
                        if len(known) == MOST_PATHS:
                            known.clear()
                        known[path] = _place(path)
                    rel, column, _ = place = known[path]
                    held = tables.get((rel, ordinals))
                    if held is None:
                        held = tables[rel, ordinals] = ({}, [], place)
                    if kind == "object":
                        if objects:
                            held[1].append((node, parent))
                    elif value is not None:
                        held[0][column] = value
                for (rel, ordinals), (cols, own, place) in tables.items():
                    out.add(i, root, rel, ordinals, place[2], cols, own)
            yield out.batch()

    cells = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(r).cast("string").alias(r) for r in roots])
    return spread(cells).mapInArrow(kernel, ROWS)


def catalog(shredded: DataFrame) -> DataFrame:
    """(rel, col, n_rows): the columns found in each table and how many rows have them; col null: the table's rows."""
    return (
        shredded.select("rel", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.map_keys("cols"))).alias("col"))
        .groupBy("rel", "col").agg(F.count("*").alias("n_rows"))
    )


def flat(shredded: DataFrame) -> DataFrame:
    """(id, root, rel, row_key, parent_rel, parent_key, col, value): every column of every row of all tables; col is null where a row has none."""
    return shredded.select(
        "id", "root", "rel", F.array_join("ordinals", ".").alias("row_key"), "parent_rel", F.array_join("parent_ordinals", ".").alias("parent_key"),
        F.explode_outer("cols").alias("col", "value"),
    )


def pivot(shredded: DataFrame, rel: str, columns: list[str]) -> DataFrame:
    """The flat table of one repeated ancestor: id, ordinals, parent_ordinals and the named columns as strings."""
    return shredded.filter(F.col("rel") == rel).select(
        "id", F.array_join("ordinals", ".").alias("row_key"), F.array_join("parent_ordinals", ".").alias("parent_key"),
        *[F.col("cols").getItem(c).alias(c.replace(".", "_")) for c in columns],
    )


def write_tables(shredded: DataFrame, output: str) -> dict[str, dict[str, str]]:
    """Write every flat table as Parquet under `output`, in a folder named by its path; returns the path of each column, by table.

    Each has id, row_key, parent_key and its columns as strings, named c_ and the path below
    the repeated ancestor; names that differ in case only get a number. The driver holds
    the names of tables and columns, nothing else.
    """
    kept = persisted(shredded.select("id", "rel", "ordinals", "parent_ordinals", "cols"), "shredded")
    named: dict[str, dict[str, str]] = {}
    taken: set[tuple[str, str]] = set()
    for r in catalog(kept).orderBy("rel", "col").collect():
        own = named.setdefault(r["rel"], {})
        if r["col"] is None:
            continue
        name, n = f"c_{r['col']}", 1
        while (r["rel"], name.lower()) in taken:
            n += 1
            name = f"c_{r['col']}~{n}"
        taken.add((r["rel"], name.lower()))
        own[name] = r["col"]
    for rel, columns in named.items():
        keys = [F.array_join("ordinals", ".").alias("row_key"), F.array_join("parent_ordinals", ".").alias("parent_key")]
        rows_of = kept.filter(F.col("rel") == rel).select("id", *keys, *[F.col("cols").getItem(c).alias(n) for n, c in columns.items()])
        rows_of.write.mode("overwrite").parquet(f"{output}/{url_quote(rel)}")
    return named
