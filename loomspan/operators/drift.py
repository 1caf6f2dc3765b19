"""Schemas that drift between files (problem 5).

The header schema of every file is read in parallel (names in order, type of each), the schemas are folded in file order
through a type lattice, ordered differences are logged, and every file is cast to the union schema.

Lattice: no type < boolean, number, list, object < text; two different types meet in text.

Defined results: a file without a header (null or empty body) and a JSON null, empty, malformed or without components are
passed over: the next file is compared with the last one that has a schema. Missing values (``n/a``, empty, JSON null)
have no type. A name that stands twice in a header counts once, with the types of all its columns. Repeated rows count
once. Files of one place (equal seq) follow each other by run_id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.session import cut, table

MISSING = ("", "n/a")  # fixed values
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z")
BLOCK = 1024  # places of files folded in one go
MAX_COLUMNS = 10_000  # a union schema wider than this is refused, not cut

SCHEMA = "run_id bigint, dataset string, seq int, side string, fields array<string>, kinds array<string>"
CHANGE = "run_id bigint, dataset string, seq int, side string, field string, old_field string, change_kind string, old_type string, new_type string"


def join_kinds(a: str | None, b: str | None) -> str | None:
    """Least upper bound in the lattice."""
    return b if a is None else a if b is None or a == b else "text"


def kind_of_text(v: str) -> str | None:
    v = v.strip()
    if v.lower() in MISSING:
        return None
    if NUMBER.match(v):
        return "number"
    return "boolean" if v.lower() in ("true", "false") else "text"


def kind_of_json(v: object) -> str | None:
    if v is None or (isinstance(v, str) and v.strip().lower() in MISSING):
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "list" if isinstance(v, list) else "object" if isinstance(v, dict) else "text"


def rows_of(body: str | None) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a tab-separated text."""
    lines = [x for x in re.split(r"\r\n|\n|\r", body or "") if x]
    return (lines[0].split("\t"), [x.split("\t") for x in lines[1:]]) if lines else ([], [])


def components_of(text: str | None) -> dict[str, dict]:
    try:
        j = json.loads(text) if text else {}
    except ValueError:
        return {}
    return {k: v for k, v in j.items() if isinstance(v, dict)} if isinstance(j, dict) else {}


def table_schema(body: str | None) -> dict[str, str | None]:
    head, rows = rows_of(body)
    kinds: dict[str, str | None] = dict.fromkeys(head)
    for i, name in enumerate(head):
        for r in rows:
            if kinds[name] == "text":
                break
            kinds[name] = join_kinds(kinds[name], kind_of_text(r[i]) if i < len(r) else None)
    return kinds


def json_schema(text: str | None) -> dict[str, str | None]:
    kinds: dict[str, str | None] = {}
    for attrs in components_of(text).values():
        before = None
        for name, v in attrs.items():
            if name not in kinds and before is not None and before in kinds:  # a name that only later components have stands after its neighbour
                names = list(kinds.items())
                at = [n for n, _ in names].index(before) + 1
                kinds = dict(names[:at] + [(name, kind_of_json(v))] + names[at:])
            else:
                kinds[name] = join_kinds(kinds.get(name), kind_of_json(v))
            before = name
    return kinds


def file_schemas(files: DataFrame) -> DataFrame:
    """run_id, dataset, seq, body, json_body -> a row for each file and side that has a schema."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for side, kinds in (("confounds", table_schema(r.body)), ("confounds_json", json_schema(r.json_body))):
                    if kinds:
                        out.append((r.run_id, r.dataset, r.seq, side, list(kinds), list(kinds.values())))
            yield pd.DataFrame(out, columns=["run_id", "dataset", "seq", "side", "fields", "kinds"])

    return files.select("run_id", "dataset", "seq", "body", "json_body").mapInPandas(read, SCHEMA)


def between(a: list[str], b: list[str]) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """(renamed pairs old and new, added, removed) from header a to header b: names that go and as many that come between
    the same neighbours are renamed, in order; order alone is no change."""

    def runs(names: list[str], other: set[str]) -> dict[tuple, list[str]]:
        out, left, run = {}, None, []
        for x in [*names, None]:
            if x is None or x in other:
                if run:
                    out[left, x] = run
                left, run = x, []
            else:
                run.append(x)
        return out

    gone, come = runs(a, set(b)), runs(b, set(a))
    renamed, added = [], []
    for at, new in come.items():
        old = gone.get(at, [])
        if len(old) == len(new):
            renamed += zip(old, new)
        else:
            added += new
    named = {o for o, _ in renamed}
    return renamed, added, [x for run in gone.values() for x in run if x not in named]


class Fold:
    """State of one dataset and side while its schemas pass by in order: the last names and each name's last known type."""

    def __init__(self, names: list[str] | None = None, kinds: dict[str, str | None] | None = None) -> None:
        self.names, self.kinds = names, dict(kinds or {})

    def step(self, names: list[str], kinds: dict[str, str | None], known: Callable = bool) -> list[tuple]:
        """Changes as (field, old field, kind of change, old type, new type)."""
        out: list[tuple] = []
        if self.names is None:
            self.kinds = dict(kinds)
        else:
            renamed, added, removed = between(self.names, names)
            for o, n in renamed:
                self.kinds[n] = self.kinds.pop(o, None)
                out.append((n, o, "renamed", None, None))
            for n in removed:
                out.append((n, None, "removed", self.kinds.pop(n, None), None))
            for n in added:
                self.kinds[n] = kinds[n]
                out.append((n, None, "added", None, kinds[n]))
            for n, k in kinds.items():
                was = self.kinds.get(n)
                if k is not None:
                    if was is not None and known(was) and was != k:
                        out.append((n, None, "retyped", was, k))
                    self.kinds[n] = k
        self.names = names
        return out


def _folded(rows: DataFrame, keys: list[str], order: list[str], begin: Callable, schema: str) -> DataFrame:
    """Rows sorted by keys and order pass by one state per key; ``begin()`` gives (row -> output rows, () -> last rows)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, take, end = None, None, lambda: []
        for b in batches:
            out = []
            for r in b.astype(object).where(b.notna(), None).itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != at:
                    out += end()
                    at, (take, end) = key, begin()
                out += take(r)
            yield pd.DataFrame(out, columns=names).astype(object)
        yield pd.DataFrame(end(), columns=names).astype(object)

    return rows.repartition(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(work, schema)


def _summary() -> tuple[Callable, Callable]:
    """A block of files without what stood before it: its first and last names, the first types, and the types at its end,
    where ``<name`` is the type that the first file's name had before the block."""
    fold, seen = Fold(), {}

    def take(r) -> list[tuple]:
        names = list(r.fields)
        kinds = dict(zip(names, r.kinds))
        if not seen:
            seen.update(dataset=r.dataset, side=r.side, block=r.block, first=names, kinds=list(r.kinds))
        fold.step(names, kinds if fold.names is not None else {n: k or f"<{n}" for n, k in kinds.items()}, known=lambda k: not k.startswith("<"))
        return []

    def end() -> list[tuple]:
        return [(*seen.values(), fold.names, [fold.kinds[n] for n in fold.names])] if seen else []

    return take, end


def _entries() -> tuple[Callable, Callable]:
    """From the summaries of a dataset's blocks in order: the names and types that stand before each block."""
    state: dict = {"names": None, "kinds": {}}

    def take(r) -> list[tuple]:
        out = [] if state["names"] is None else [(r.dataset, r.side, r.block, state["names"], [state["kinds"].get(n) for n in state["names"]])]
        fold = Fold(state["names"], state["kinds"])
        fold.step(list(r.first), dict(zip(r.first, r.first_kinds)))
        state["names"] = list(r.last)
        state["kinds"] = {n: fold.kinds.get(k[1:]) if k is not None and k.startswith("<") else k for n, k in zip(r.last, r.last_kinds)}
        return out

    return take, lambda: []


def _changes() -> tuple[Callable, Callable]:
    fold = Fold()

    def take(r) -> list[tuple]:
        names = list(r.fields)
        kinds = dict(zip(names, r.kinds))
        if r.entry == 0:
            fold.names, fold.kinds = names, kinds
            return []
        return [(r.run_id, r.dataset, r.seq, r.side, *x) for x in fold.step(names, kinds)]

    return take, lambda: []


def schema_changes(schemas: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ordered differences of each dataset and side.

    A dataset's files are cut into blocks by their place. Each block is first summed up on its own, the summaries (one per
    block) are folded in order to what stands before each block, and then every block is folded from there: a dataset,
    however many files it has, is many tasks. Sorted rows stream past, so memory does not grow with a block."""
    place = schemas.withColumn("block", F.coalesce(F.floor(F.col("seq") / block), F.lit(-1)).cast("long"))
    place = cut(place)
    summaries = _folded(place, ["dataset", "side", "block"], ["seq", "run_id"], _summary, "dataset string, side string, block bigint, first array<string>, first_kinds array<string>, last array<string>, last_kinds array<string>")
    entries = _folded(summaries, ["dataset", "side"], ["block"], _entries, "dataset string, side string, block bigint, fields array<string>, kinds array<string>")
    none = F.lit(None)
    rows = place.withColumn("entry", F.lit(1)).unionByName(entries.select("*", F.lit(0).alias("entry"), none.cast("bigint").alias("run_id"), none.cast("int").alias("seq")))
    return _folded(rows, ["dataset", "side", "block"], ["entry", "seq", "run_id"], _changes, CHANGE)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "confound_files").select("run_id", "dataset", "seq", "body", "json_body").dropDuplicates(["run_id", "dataset", "seq"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(file_schemas(_files(spark, sf_dir))).select("run_id", "side", "field", "change_kind").distinct()


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with old names and types."""
    return schema_changes(file_schemas(_files(spark, sf_dir)))


def union_schema(schemas: DataFrame, changes: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """(canonical name of each name, Spark type of each canonical name). Names linked by a rename are one column, called
    by the name the most files use. Both inputs come as distinct names, of which there are at most MAX_COLUMNS."""
    kinds = (
        schemas.select(F.explode(F.arrays_zip("fields", "kinds")).alias("z")).groupBy(F.col("z.fields").alias("name"))
        .agg(F.count("*").alias("n"), F.collect_set("z.kinds").alias("kinds")).limit(MAX_COLUMNS + 1).collect()
    )
    if len(kinds) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} different names")
    links = changes.where("change_kind = 'renamed'").select("old_field", "field").distinct().collect()
    files = {r["name"]: r["n"] for r in kinds}
    root = {n: n for n in files}

    def find(n: str) -> str:
        while root[n] != n:
            n = root[n]
        return n

    for r in sorted(links, key=lambda r: (r[0], r[1])):
        a, b = find(r[0]), find(r[1])
        if a != b:
            keep, drop = sorted((a, b), key=lambda n: (-files[n], n))
            root[drop] = keep
    types: dict[str, str | None] = {}
    for r in kinds:
        for k in r["kinds"] or [None]:
            types[find(r["name"])] = join_kinds(types.get(find(r["name"])), k)
    return {n: find(n) for n in files}, {n: {"number": "double", "boolean": "boolean"}.get(k or "text", "string") for n, k in types.items()}


def _cast(v: object, kind: str) -> object:
    if v is None or (isinstance(v, str) and v.strip().lower() in MISSING):
        return None
    if kind == "double":
        return float(v)
    if kind == "boolean":
        return v if isinstance(v, bool) else v.strip().lower() == "true"
    return v.strip() if isinstance(v, str) else json.dumps(v)


def unified(files: DataFrame, side: str) -> DataFrame:
    """All files of one side in one table: a row for each file and volume (side ``confounds``) or component
    (``confounds_json``), a column for each field of the union schema; fields a file lacks are null."""
    schemas = cut(file_schemas(files).where(F.col("side") == side))
    name, kind = union_schema(schemas, schema_changes(schemas))
    cols = sorted(kind)
    key = "t" if side == "confounds" else "component"
    taken = {"run_id", "dataset", "seq", key}
    out_name = {c: c if c.lower() not in taken else f"{c}_" for c in cols}
    seen: set[str] = set()
    for c in cols:  # names that differ only in case get a number, as column names are not case-sensitive
        while out_name[c].lower() in seen:
            out_name[c] += "_"
        seen.add(out_name[c].lower())
    schema = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("dataset", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField(key, T.LongType() if key == "t" else T.StringType())] + [T.StructField(out_name[c], T._parse_datatype_string(kind[c])) for c in cols])

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if side == "confounds":
                    head, rows = rows_of(r.body)
                    records = [(t, dict(zip(head, x))) for t, x in enumerate(rows)]
                else:
                    records = list(components_of(r.json_body).items())
                for k, rec in records:
                    vals = dict.fromkeys(cols)
                    for f, v in rec.items():
                        if vals[name[f]] is None:
                            vals[name[f]] = _cast(v, kind[name[f]])
                    out.append((r.run_id, r.dataset, r.seq, k, *vals.values()))
            yield pd.DataFrame(out, columns=schema.names).astype({n: object for n in schema.names})

    return files.select("run_id", "dataset", "seq", "body", "json_body").mapInPandas(cast, schema)


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(_files(spark, sf_dir), "confounds")


def p5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unified(_files(spark, sf_dir), "confounds_json")


QUERIES = {"p5_found": p5_found, "p5_changes": p5_changes, "p5_table": p5_table, "p5_components": p5_components}
SQL: dict[str, str] = {}
