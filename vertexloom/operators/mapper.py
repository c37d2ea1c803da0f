"""Declarative mapping of records to vertices and edges, compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.text import JUNK, NATURAL_KEYS, REGISTRY, clean, is_junk

END = re.compile(r"^(?P<label>[^.]+)\.(?P<key>[^(]+)\((?P<value>.+)\)$")


@dataclass(frozen=True)
class Call:
    """A registered function over fields; ``many`` if it gives an array."""

    function: str
    fields: tuple[str, ...]
    many: bool = False


@dataclass(frozen=True)
class NodeMap:
    """A vertex: label, properties as expressions, and the property that names it."""

    label: str
    properties: Mapping[str, str]
    unique: str


@dataclass(frozen=True)
class EdgeMap:
    """An edge between ``label.property(expression)`` ends.

    ``aggregate``, as ``counter-eventTime-5s``, has equal edges of a stretch of time counted:
    the property that holds the count, the one that holds the time, and the length.
    """

    label: str
    left: str
    right: str
    properties: Mapping[str, str] = field(default_factory=dict)
    aggregate: str | None = None


@dataclass(frozen=True)
class Mapper:
    """Expressions are a field, ``default=text``, ``A+B`` (joined), ``A|B`` (either) or ``analyze-name`` (a call)."""

    nodes: tuple[NodeMap, ...]
    edges: tuple[EdgeMap, ...]
    calls: Mapping[str, Call] = field(default_factory=dict)

    @staticmethod
    def from_dict(spec: Mapping) -> Mapper:
        """From the same structure as plain data, for mappings that are kept as JSON."""
        return Mapper(
            tuple(NodeMap(n["label"], n["properties"], n["unique"]) for n in spec["nodes"]),
            tuple(EdgeMap(e["label"], e["left"], e["right"], e.get("properties", {}), e.get("aggregate")) for e in spec["edges"]),
            {k: Call(c["function"], tuple(c["fields"]), c.get("many", False)) for k, c in spec.get("calls", {}).items()},
        )


def _field(name: str, columns: set[str]) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")


def either(a: Column, b: Column) -> Column:
    """The value of two fields: one of equal ones, the one that is not ``-`` or empty, the first if they differ, ``NA`` if there is none."""
    none = lambda c: c.isin("", "-")
    return F.when(none(a) & none(b), "NA").when(none(a), b).otherwise(a)


def compile_value(expression: str, mapper: Mapper, columns: set[str]) -> Column:
    """An expression as an array of strings, lower-cased and cleaned; one element unless it is a call that gives many."""
    if expression.startswith("default="):
        value = F.array(F.lit(expression.removeprefix("default=")))
    elif expression.startswith("analyze-"):
        call = mapper.calls[expression.removeprefix("analyze-")]
        value = REGISTRY[call.function](*[_field(f, columns) for f in call.fields])
        value = value if call.many else F.array(value)
    elif "+" in expression:
        value = F.array(F.concat(*[_field(f.strip(), columns) for f in expression.split("+")]))
    elif "|" in expression:
        a, b = (f.strip() for f in expression.split("|"))
        value = F.array(either(_field(a, columns), _field(b, columns)))
    else:
        value = F.array(_field(expression, columns))
    return F.transform(value, lambda v: F.lower(clean(v)))


def _map(entries: Mapping[str, Column]) -> Column:
    if not entries:
        return F.create_map().cast("map<string,array<string>>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in entries]), F.array(*entries.values()))


def _valued(df: DataFrame, mapper: Mapper, expressions: Iterable[str], keep: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """``keep`` and each distinct expression as a column of its own, worked out once a row, and those columns by expression."""
    names = {e: f"value {n} of the mapping" for n, e in enumerate(dict.fromkeys(expressions))}
    rows = df.select(*keep, *[compile_value(e, mapper, set(df.columns)).alias(c) for e, c in names.items()])
    return rows, {e: F.col(f"`{c}`") for e, c in names.items()}


def _vertices(n: NodeMap, value: Mapping[str, Column]) -> Column:
    values = {k: value[e] for k, e in n.properties.items()}
    named = lambda v: _map({**values, n.unique: F.array(v)})
    return F.transform(values[n.unique], lambda v: F.struct(F.lit(n.label).alias("label"), v.alias("identifier"), named(v).alias("properties")))


def map_nodes(df: DataFrame, mapper: Mapper, keep: tuple[str, ...] = ()) -> DataFrame:
    """``label, identifier, properties`` for each mapped vertex of each row, one for each value of its naming property.

    All mappings are expanded by one explode over one scan. Vertices without a name are left out.
    """
    rows, value = _valued(df, mapper, [e for n in mapper.nodes for e in n.properties.values()], keep)
    arrays = [_vertices(n, value) for n in mapper.nodes]
    found = rows.select(*keep, F.explode(F.concat(*arrays)).alias("n")).select(*keep, "n.*")
    return found.filter(~is_junk(F.col("identifier")))


def _ends(e: EdgeMap) -> tuple[str, str, str, str]:
    """Expressions and labels of both ends."""
    left, right = END.match(e.left), END.match(e.right)
    if not left or not right:
        raise ValueError(f"an end must read label.property(expression): {e.left}, {e.right}")
    return left["value"], right["value"], left["label"], right["label"]


def _paired(left: Column, right: Column) -> Column:
    return (F.size(left) == 1) | (F.size(right) == 1) | (F.size(left) == F.size(right))


def _links(e: EdgeMap, value: Mapping[str, Column]) -> Column:
    a, b, src, dst = _ends(e)
    left, right = value[a], value[b]
    values = _map({k: value[x] for k, x in e.properties.items()})
    at = lambda side, i: F.try_element_at(side, F.least(i, F.size(side)).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(left), F.size(right), F.lit(1))),
        lambda i: F.struct(
            F.lit(e.label).alias("label"), F.lit(src).alias("src_label"), at(left, i).alias("src_identifier"),
            F.lit(dst).alias("dst_label"), at(right, i).alias("dst_identifier"), values.alias("properties"),
        ),
    )
    return F.when(_paired(left, right), pairs).otherwise(F.slice(pairs, 1, 0))


def map_edges(df: DataFrame, mapper: Mapper, keep: tuple[str, ...] = ()) -> DataFrame:
    """``label, src_label, src_identifier, dst_label, dst_identifier, properties`` for each mapped edge.

    One end of a side goes with all of the other, or both sides go pairwise; sides of unequal
    numbers are left to :func:`unpaired`. Edges with a nameless end are left out.
    """
    rows, value = _valued(df, mapper, [x for e in mapper.edges for x in (*_ends(e)[:2], *e.properties.values())], keep)
    arrays = [_links(e, value) for e in mapper.edges]
    found = rows.select(*keep, F.explode(F.concat(*arrays)).alias("e")).select(*keep, "e.*")
    return found.filter(~is_junk(F.col("src_identifier")) & ~is_junk(F.col("dst_identifier")))


def unpaired(df: DataFrame, mapper: Mapper) -> DataFrame:
    """Rows with an edge whose sides have unequal numbers of ends, with the labels of those edges."""
    columns = set(df.columns)
    bad = []
    for e in mapper.edges:
        left, right = (compile_value(x, mapper, columns) for x in _ends(e)[:2])
        bad.append(F.when(~_paired(left, right), F.lit(e.label)))
    labels = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return df.withColumn("unpaired_labels", labels).filter(F.size("unpaired_labels") > 0)


def natural_key(properties: Column) -> Column:
    """First value of the first property, in a fixed order, that names a vertex."""
    return F.coalesce(*[F.try_element_at(F.try_element_at(properties, F.lit(k)), F.lit(1)) for k in NATURAL_KEYS])


def is_empty_node(properties: Column, identifier: Column) -> Column:
    """Whether the name or all values of a vertex are junk."""
    values = F.flatten(F.map_values(properties))
    return is_junk(identifier) | ~F.exists(values, lambda v: ~F.lower(F.trim(v)).isin(*JUNK))


def node_key(label: Column, identifier: Column) -> Column:
    """Id of a vertex: the same for the same name, so loading again changes nothing."""
    return F.xxhash64(label, identifier)


def edge_key(*parts: Column) -> Column:
    """Id of an edge: a digest of its ends, label, time and source."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def composite_edge_key(src: Column, row: Column, label: Column, dst: Column) -> Column:
    """Readable edge id of source, row, label and destination."""
    return F.concat_ws("_", src, row, label, dst)


def first_of_each(nodes: DataFrame, order: str) -> DataFrame:
    """One vertex for each label and identifier: the properties of the least ``order``, of equal ones those that read first."""
    return nodes.groupBy("label", "identifier").agg(F.min_by("properties", F.struct(order, F.to_json("properties"))).alias("properties"))


def one_of_each_edge(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["edge_id"])
