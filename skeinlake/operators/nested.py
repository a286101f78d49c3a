"""Deeply nested records into related flat tables: one pass, tagged rows, then one table per tag.

A visitor walks the schema depth-first and builds, for every record, one array of tagged rows (table tag, primary key,
parent key, position, payload). The array is exploded once, so the input is read once however many tables come out. The
payload is a struct with one field per tag of which only the row's own is set: written partitioned by tag it costs nothing
for the others (parquet stores runs of nulls), keeps every type exactly and gets its flat schema by selecting that field.

Defined results
- null or empty array, null struct of flags: no child rows; an empty input gives empty tables with full schemas
- a null element, an element whose fields are all null, a repeat of an earlier element of the same array: no row;
  the others keep their position in the original array; incomplete elements come out
- null record key: rows come out with null keys (the payload is kept, the link cannot be)
- extra columns and columns named like the output's are not touched: only the fields of the spec are read
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace


@dataclass(frozen=True)
class Child:
    """A nested field that becomes a table. kind: ``array`` of structs, or ``flags``, a struct of booleans of which the
    true members come out by name. children: nested fields inside each element."""

    path: str
    tag: str
    kind: str = "array"
    children: tuple[Child, ...] = ()

    def walk(self) -> Iterable[Child]:
        yield self
        for c in self.children:
            yield from c.walk()


def plan_children(schema: T.StructType, prefix: str = "") -> tuple[Child, ...]:
    """The spec a schema implies: every array of structs is a table named by its path, every struct of booleans flags."""
    found = []
    for f in schema.fields:
        kind, tag = f.dataType, f"{prefix}{f.name}"
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found.append(Child(f.name, tag, "array", plan_children(kind.elementType, f"{tag}_")))
        elif isinstance(kind, T.StructType) and kind.fields and all(isinstance(x.dataType, T.BooleanType) for x in kind.fields):
            found.append(Child(f.name, tag, "flags"))
    return tuple(found)


def _field(schema: T.StructType, name: str) -> T.DataType:
    return schema[name].dataType


def payload_schema(kind: T.DataType, child: Child) -> T.StructType:
    """The flat columns of a child's table besides its keys."""
    if child.kind == "flags":
        return T.StructType([T.StructField("member", T.StringType())])
    own = {c.path for c in child.children}
    return T.StructType([T.StructField(f.name, f.dataType) for f in kind.elementType.fields if f.name not in own])


def _schemas(schema: T.StructType, children: Iterable[Child]) -> dict[str, T.StructType]:
    out: dict[str, T.StructType] = {}
    for c in children:
        kind = _field(schema, c.path)
        out[c.tag] = payload_schema(kind, c)
        if c.children:
            out |= _schemas(kind.elementType, c.children)
    return out


def _comparable(col: Column, kind: T.DataType) -> Column:
    """A form that can be ordered: maps become sorted entries, all else stays."""
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(F.transform(F.map_entries(col), lambda e: _comparable(e, entry)))
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(col, lambda e: _comparable(e, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(col.isNotNull(), F.struct(*[_comparable(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return col


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def kept_elements(arr: Column, element: T.StructType) -> Column:
    """Array of (pos, x): the elements that are neither null nor hollow nor repeats, by sorting, not by all pairs."""
    hollow = lambda x: F.expr("true") if not element.fields else _all([x[f.name].isNull() for f in element.fields])
    placed = F.transform(arr, lambda x, i: F.struct(_comparable(x, element).alias("c"), i.alias("pos")))
    alive = F.filter(placed, lambda e: e["c"].isNotNull() & ~hollow(e["c"]))
    # the one-element array binds the sorted array to a lambda variable, so it is made once and not once per element
    firsts = F.transform(F.array(F.array_sort(alive)), lambda s: F.filter(s, lambda e, i: (i == 0) | ~F.get(s, i - 1)["c"].eqNullSafe(e["c"])))
    return F.transform(F.coalesce(F.get(firsts, F.lit(0)), F.array()), lambda e: F.struct(e["pos"].alias("pos"), F.get(arr, e["pos"]).alias("x")))


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _visit(node: Column | None, schema: T.StructType, key: Column, children: Iterable[Child], payloads: dict[str, T.StructType], record: T.ArrayType) -> list[Column]:
    """Depth-first: arrays of tagged rows below ``node`` (None: the record itself)."""

    def body(tag: str, own: Column) -> Column:
        return F.struct(*[(own if t == tag else F.lit(None)).cast(s).alias(t) for t, s in payloads.items()])

    def row(tag: str, parent: Column, pos: Column, own: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), F.concat(parent, F.lit(f"/{tag}/"), pos.cast("string")).alias("pk"), parent.alias("parent_pk"), pos.alias("pos"), body(tag, own).alias("payload"))

    def flags(c: Child, value: Column, kind: T.StructType) -> list[Column]:
        members = F.array(*[F.struct(F.lit(f.name).alias("member"), F.lit(i).alias("pos"), value[f.name].alias("on")) for i, f in enumerate(kind.fields)])
        return [F.transform(F.filter(members, lambda m: m["on"]), lambda m: row(c.tag, key, m["pos"], F.struct(m["member"].alias("member"))))]

    def elements(c: Child, value: Column, kind: T.ArrayType) -> list[Column]:
        flat, kept = payloads[c.tag], kept_elements(value, kind.elementType)
        rows = [F.transform(kept, lambda k: row(c.tag, key, k["pos"], F.struct(*[k["x"][f.name].alias(f.name) for f in flat.fields])))]
        if c.children:
            below = lambda k: F.concat(*_visit(k["x"], kind.elementType, F.concat(key, F.lit(f"/{c.tag}/"), k["pos"].cast("string")), c.children, payloads, record))
            rows.append(F.flatten(F.transform(kept, below)))
        return rows

    out = []
    for c in children:
        value, kind = (F.col(c.path) if node is None else node[c.path]), _field(schema, c.path)
        out += (flags if c.kind == "flags" else elements)(c, value, kind)
    return [F.coalesce(rows.cast(record), F.array().cast(record)) for rows in out]


def emit_tagged(df: DataFrame, key: str, children: Iterable[Child]) -> DataFrame:
    """All child rows of all records in one pass: ``key``, tag, pk, parent_pk, pos, payload."""
    children = tuple(children)
    payloads = _schemas(df.schema, children)
    if len(payloads) != sum(1 for c in children for _ in c.walk()):
        raise ValueError("tags must differ")
    one = T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("pk", T.StringType()), T.StructField("parent_pk", T.StringType()), T.StructField("pos", T.IntegerType()),
        T.StructField("payload", T.StructType([T.StructField(t, s) for t, s in payloads.items()])),
    ])
    rows = F.concat(*_visit(None, df.schema, F.col(key).cast("string"), children, payloads, T.ArrayType(one)))
    return df.select(F.col(key).alias("_root"), F.explode(rows).alias("_r")).select(F.col("_root").alias(key), "_r.*")


class TaggedTables:
    """The tagged rows written once, partitioned by tag, and read as one flat table per tag."""

    def __init__(self, spark: SparkSession, df: DataFrame, key: str, children: Iterable[Child]):
        self.key, self.payloads = key, _schemas(df.schema, tuple(children))
        self.work = Workspace(spark, "nested")
        self.rows = self.work.save(emit_tagged(df, key, children), "rows", partition_by=["tag"])

    def table(self, tag: str, schema: T.StructType | None = None) -> DataFrame:
        """Keys and flat columns of one tag (a pruned read of its partition); ``schema`` renames nothing and casts."""
        fields = (schema or self.payloads[tag]).fields
        return self.rows.where(F.col("tag") == tag).select(self.key, "pk", "parent_pk", "pos", *[F.col(f"payload.`{tag}`.`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])

    def links(self) -> DataFrame:
        """Every child row of every table: record key, tag, pos (one column pair read from each partition)."""
        return self.rows.select(self.key, F.col("tag").alias("child"), "pos")
