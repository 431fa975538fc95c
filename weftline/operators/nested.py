"""Nested JSON columns to flat tables in one pass (tagged emission)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Nest:
    """A list of objects: where it is, its tag, the path to an element's id, and the lists inside."""

    kind: str
    field: str
    key: tuple[str, ...] = ()
    children: tuple["Nest", ...] = ()


WORK_NESTS = (
    Nest("authorship", "authorships_json", ("author", "id"), (Nest("authorship_institution", "institutions", ("id",)),)),
    Nest("topic", "topics_json", ("id",)),
    Nest("location", "locations_json", ("source", "id")),
    Nest("reference", "referenced_works_json"),
)

#: With the lists that only the flat tables have; ``p7_found`` lists the tags of WORK_NESTS.
FLAT_NESTS = (
    Nest("authorship", "authorships_json", ("author", "id"), (*WORK_NESTS[0].children, Nest("authorship_affiliation", "affiliations"))),
    *WORK_NESTS[1:],
)

_OUT = "{id} string, child_kind string, item_index int, sub_index int, item_key string"
_SHORT = re.compile(r"[A-Z][0-9]+")
_NOTHING: list = []


def no_constant(x: str) -> None:
    raise ValueError(x)


def read_array(text: object) -> list:
    """The array in a JSON text; an object counts as an array of one, JSON inside a JSON string is read too."""
    v: object = text
    try:
        while isinstance(v, str):
            v = json.loads(v, parse_constant=no_constant)
    except (ValueError, RecursionError):
        return _NOTHING
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else _NOTHING


def short(x: object) -> str:
    if not isinstance(x, str):
        return ""
    s = x.strip().rstrip("/").rpartition("/")[2].strip()
    return s if _SHORT.fullmatch(s) else ""


def visitor(nest: Nest, emit: Callable[[str, int, int, str, object], None], wanted: frozenset[str] | None) -> Callable[[object, tuple[int, ...]], None]:
    """A depth-first visitor of one list; ``emit`` gets tag, index, sub index, key and element."""
    below = [(c.field, visitor(c, emit, wanted)) for c in nest.children]
    kind, key, tell = nest.kind, nest.key, wanted is None or nest.kind in wanted

    def visit(value: object, at: tuple[int, ...]) -> None:
        for i, x in enumerate(value if isinstance(value, list) else read_array(value) if isinstance(value, str) else [value] if isinstance(value, dict) else _NOTHING):
            if x is None:
                continue
            if tell:
                k: object = x
                for step in key:
                    k = k.get(step) if isinstance(k, dict) else None
                if at:
                    emit(kind, at[0], i, short(k), x)
                else:
                    emit(kind, i, -1, short(k), x)
            if below and isinstance(x, dict):
                for field, go in below:
                    go(x.get(field), (*at, i))

    return visit


def emit_tagged(df: DataFrame, id_column: str, nests: Iterable[Nest] = WORK_NESTS, kinds: Iterable[str] | None = None, payload: bool = False) -> DataFrame:
    """One pass over each record's nested columns; a row for each non-null element, tagged with its table.

    Columns: the record's id (parent key), ``child_kind`` (tag), ``item_index`` and ``sub_index``
    (with the id and tag the primary key; the parent of a nested element is the same id and item
    index), ``item_key`` (short id or empty), and with ``payload`` the element as JSON text.
    Only the columns of the wanted ``kinds`` are read. Null, empty, damaged or scalar texts give no
    rows; null elements keep their position; other columns of ``df`` are ignored, whatever their
    names. A null id stays null. Repeated records repeat their rows: see ``flat_rows``.
    """
    want = None if kinds is None else frozenset(kinds)

    def used(n: Nest) -> bool:
        return want is None or n.kind in want or any(used(c) for c in n.children)

    top = [n for n in nests if used(n)]
    schema = _OUT.format(id=f"`{id_column}`") + (", payload string" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0), 0
            row, kind, item, sub, keys, body = [], [], [], [], [], []

            def emit(k: str, i: int, j: int, key: str, x: object) -> None:
                row.append(n)
                kind.append(k)
                item.append(i)
                sub.append(j)
                keys.append(key)
                if payload:
                    body.append(json.dumps(x, sort_keys=True))

            visits = [visitor(nest, emit, want) for nest in top]
            texts = [b.column(1 + c).to_pylist() for c in range(len(top))]
            for n in range(b.num_rows):
                for c, go in enumerate(visits):
                    if texts[c][n] is not None:
                        go(texts[c][n], ())
            cols = [ids.take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(item, pa.int32()), pa.array(sub, pa.int32()), pa.array(keys, pa.string())]
            names = [id_column, "child_kind", "item_index", "sub_index", "item_key"]
            if payload:
                cols.append(pa.array(body, pa.string()))
                names.append("payload")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(id_column, *[n.field for n in top]).mapInArrow(run, schema)


def flat_rows(df: DataFrame, id_column: str = "work_id", **kw) -> DataFrame:
    """``emit_tagged`` with repeated deliveries of a record taken once."""
    return emit_tagged(df, id_column, **kw).distinct()


#: Schemas of the flat tables; the payload of each tag is read with its own.
PAYLOADS = {
    "authorship": "author struct<id:string,display_name:string>, author_position string, raw_affiliation_strings array<string>",
    "authorship_institution": "id string, display_name string, ror string, country_code string, type string, lineage array<string>",
    "authorship_affiliation": "raw_affiliation_string string, institution_ids array<string>",
    "topic": "id string, display_name string, score double, subfield struct<id:string,display_name:string>, field struct<id:string,display_name:string>, domain struct<id:string,display_name:string>",
    "location": "source struct<id:string,display_name:string,type:string>, is_oa boolean, landing_page_url string, license string, version string",
    "reference": "",
}


def _left(x: object, kind: T.DataType, lists: frozenset[str] = frozenset()) -> object:
    """What of a value its schema has no place for; None if nothing. Child tables have ``lists``."""
    if x is None or isinstance(kind, T.StringType):
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(x, dict):
            return x
        named = {f.name: f.dataType for f in kind}
        out = {}
        for k, v in x.items():
            if k in lists and (v is None or isinstance(v, (list, dict)) or read_array(v)):
                continue
            if k not in named:
                out[k] = v
            elif (r := _left(v, named[k])) is not None:
                out[k] = r
        return out or None
    if isinstance(kind, T.ArrayType):
        return None if isinstance(x, list) else x
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return None if (isinstance(x, bool) if isinstance(kind, T.BooleanType) else number) else x


def rest(schema: T.StructType, lists: frozenset[str]) -> Callable:
    """A column function: payload to the JSON of all that neither the schema nor a child table takes, or null."""

    @F.pandas_udf(T.StringType())
    def of(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            left = None if t is None else _left(json.loads(t), schema, lists)
            return None if left is None else json.dumps(left, sort_keys=True)

        return s.map(one, na_action=None).astype(object)

    return of


def _all(nests: Iterable[Nest]) -> Iterator[Nest]:
    for n in nests:
        yield n
        yield from _all(n.children)


def flat_table(tagged: DataFrame, kind: str) -> DataFrame:
    """The table of one tag, its payload read with the tag's schema (fields that do not fit are null).

    ``rest`` has the JSON of whatever was delivered besides: unnamed fields, values that do not fit,
    elements that are no objects. It is null where nothing is.
    """
    own = tagged.filter(F.col("child_kind") == kind).drop("child_kind")
    fields = PAYLOADS[kind]
    if not fields:
        return own.drop("payload")
    schema = T.StructType.fromDDL(fields)
    lists = frozenset(c.field for n in _all(FLAT_NESTS) if n.kind == kind for c in n.children)
    own = own.withColumn("_p", F.from_json("payload", schema))
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType:
                own = own.withColumn(f"{f.name}_{g.name}", F.col(f"_p.{f.name}.{g.name}"))
        else:
            own = own.withColumn(f.name if f.name != "id" else "raw_id", F.col(f"_p.{f.name}"))
    return own.withColumn("rest", rest(schema, lists)("payload")).drop("_p", "payload")


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Write all tables at once, partitioned by tag; a later read of one tag reads only its files.

    Rows of a tag are kept together inside each task, so a task has one open file at a time.
    """
    tagged.sortWithinPartitions("child_kind").write.mode("overwrite").option("compression", "zstd").partitionBy("child_kind").parquet(path)
