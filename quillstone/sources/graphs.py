"""Graph sources: relational tables seen as a virtual graph, and stored quads.

A source lowers basic graph patterns. The virtual graph answers all triple patterns of one subject in one class by one scan of its
table (a star), on native columns, so filters and column pruning reach Parquet. Stored quads are (s, p, o, g) encoded terms.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Compiler
from ..operators.relation import Algebra, Relation, build, empty, q
from ..plans.algebra import IRI, RDF, Literal, Triple, Var
from ..terms import Value, constant, encode, to_term

DB = "http://example.org/db/"


@dataclass
class Table:
    """A class of the mapping: rows are subjects named by ``key``, columns are predicates of the same name."""

    name: str
    key: str | None  # SQL expression of the subject's key; None: rows have no key of their own
    columns: dict[str, str]  # column -> kind, or ref:<table>
    lang: dict[str, str] = field(default_factory=dict)  # column -> column with its language tag
    derived: dict[str, str] = field(default_factory=dict)  # column -> SQL expression over a window or row, computed at the scan
    file: str | None = None


def _kind(t: str) -> str:
    return {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}.get(t, "string")


class VirtualGraph:
    def __init__(self, spark: SparkSession, reader, tables: list[Table], namespace: str = DB):
        self.spark, self.reader, self.namespace = spark, reader, namespace
        self.tables = {t.name: t for t in tables}
        self.refs = {t.name: f"{namespace}{t.name}/" for t in tables}
        self.algebra = Algebra(self.refs)
        self.owners = {namespace + c: t.name for t in tables for c in (*t.columns, *t.derived)}

    def graph_names(self) -> list[str]:
        return [self.namespace + t for t in self.tables]

    def rows(self, name: str) -> DataFrame:
        t = self.tables[name]
        df = self.reader(t.file or t.name)
        for c, e in t.derived.items():
            df = df.withColumn(c, F.expr(e))
        return df

    def key(self, name: str) -> Column:
        t = self.tables[name]
        return F.expr(t.key) if t.key else F.monotonically_increasing_id()

    def cell(self, name: str, column: str) -> Value:
        t = self.tables[name]
        kind = t.columns.get(column) or "ref:" + name
        c = q(column)
        if kind == "integer":
            c = c.cast("bigint")
        if column in t.lang:
            return Value(c, "lang", q(t.lang[column]))
        return Value(c, kind)

    def bgp(self, triples: list[Triple], graph: Any) -> Relation:
        """``graph``: None, or the IRI of a table's graph; a list of IRIs is their union."""
        allowed = set(self.tables) if graph is None else {g[len(self.namespace) :] for g in ([graph] if isinstance(graph, str) else graph)} & set(self.tables)
        stars: dict[tuple, list[Triple]] = {}
        loose: list[Triple] = []
        types: dict[Any, str] = {}
        names = {v.name for t in triples for v in (t.s, t.p, t.o) if isinstance(v, Var)}
        for t in triples:
            if isinstance(t.p, IRI) and t.p.value == RDF + "type" and isinstance(t.o, IRI):
                types[t.s] = t.o.value[len(self.namespace) :] if t.o.value.startswith(self.namespace) else ""
        for t in triples:
            if isinstance(t.p, IRI) and t.p.value == RDF + "type" and isinstance(t.o, IRI):
                owner = types[t.s]
            elif isinstance(t.p, IRI) and t.p.value != RDF + "type":
                owner = self.owners.get(t.p.value, "")
            else:
                loose.append(t)
                continue
            if owner not in allowed:
                return empty(self.spark, dict.fromkeys(names, "term"))
            stars.setdefault((t.s, owner), []).append(t)
        parts = [self.star(s, owner, group) for (s, owner), group in stars.items()]
        classes = {s: owner for s, owner in stars}
        parts += [self.loose(t, allowed, classes.get(t.s) or types.get(t.s)) for t in loose]
        return join_connected(self.algebra, parts) if parts else Relation(self.spark.range(1).select(F.lit(1).alias("__one")), {}, set(), True)

    def star(self, subject: Any, name: str, triples: list[Triple]) -> Relation:
        df = self.rows(name)
        c = Compiler({}, self.refs)
        values: dict[str, Value] = {}
        key = Value(self.key(name), "ref:" + name)
        conditions: list[Column] = []
        if isinstance(subject, Var):
            values[subject.name] = key
        else:
            conditions.append(self.algebra.same(key, constant(subject)) if isinstance(subject, IRI) and self.tables[name].key and not subject.value.startswith(self.refs[name]) else c.compare("=", key, constant(subject)))
        for t in triples:
            if t.p.value == RDF + "type":
                continue
            cell = self.cell(name, t.p.value[len(self.namespace) :])
            if isinstance(t.o, Var):
                if t.o.name in values:
                    conditions.append(self.algebra.same(values[t.o.name], cell))
                else:
                    values[t.o.name] = cell
                    conditions.append(cell.col.isNotNull())
            else:
                k = constant(t.o)
                conditions.append(c.compare("=", cell, k) if cell.kind.startswith("ref:") else self.algebra.same(cell, k))
        if conditions:
            df = df.filter(reduce(lambda a, b: a & b, conditions))
        if not values:
            return Relation(df.select(F.lit(1).alias("__one")), {}, set())
        return build(df, values, set(values))

    def loose(self, t: Triple, allowed: set[str], owner: str | None) -> Relation:
        """A pattern with a variable predicate (or type): tables turned to triples, only those that can match."""
        names = [n for n in self.tables if n in allowed and (owner is None or n == owner) and not (isinstance(t.s, IRI) and not t.s.value.startswith(self.refs[n]))]
        quads = self.quads(names)
        return match(quads, t, self.spark, self.refs)

    def quads(self, names: list[str] | None = None) -> DataFrame:
        """(s, p, o, g) encoded terms of the named tables."""
        out = None
        for n in self.tables if names is None else names:
            df = self.rows(n)
            t = self.tables[n]
            cells = [(self.namespace + c, to_term(self.algebra.plain(self.cell(n, c)))) for c in (*t.columns, *t.derived)]
            pairs = [F.struct(F.lit("I" + p).alias("p"), o.alias("o")) for p, o in cells] + [F.struct(F.lit("I" + RDF + "type").alias("p"), F.lit("I" + self.namespace + n).alias("o"))]
            df = df.select(F.concat(F.lit("I" + self.refs[n]), self.key(n).cast("string")).alias("s"), F.explode(F.array(*pairs)).alias("x"))
            df = df.select("s", "x.p", "x.o", F.lit("I" + self.namespace + n).alias("g")).filter("o is not null")
            out = df if out is None else out.unionByName(df)
        if out is None:
            return self.spark.createDataFrame([], "s string, p string, o string, g string")
        return out

    def triples(self, graph: Any) -> DataFrame:
        names = None if graph is None else [g[len(self.namespace) :] for g in ([graph] if isinstance(graph, str) else graph) if g[len(self.namespace) :] in self.tables]
        return self.quads(names).select("s", "p", "o")


@dataclass
class EachGraph:
    """Patterns are matched in every named graph (or in those of ``names``) apart; ``variable`` holds the graph."""

    variable: str
    names: list[str] | None = None


class QuadGraph:
    """Stored quads: encoded terms in (s, p, o, g), g null in the default graph. Rows are a set."""

    def __init__(self, spark: SparkSession, quads: DataFrame):
        self.spark, self.quads_df, self.refs = spark, quads, {}
        self.algebra = Algebra({})

    def graph_names(self) -> list[str]:
        return [r[0][1:] for r in self.quads_df.select("g").filter("g is not null").distinct().collect()]  # names of graphs, not data

    def triples(self, graph: Any) -> DataFrame:
        df = self.quads_df
        if graph is None:
            return df.filter("g is null").select("s", "p", "o")
        if isinstance(graph, str):
            return df.filter(F.col("g") == F.lit("I" + graph)).select("s", "p", "o")
        return df.filter(F.col("g").isin(["I" + g for g in graph])).select("s", "p", "o").distinct()

    def quads(self) -> DataFrame:
        return self.quads_df

    def bgp(self, triples: list[Triple], graph: Any) -> Relation:
        if not triples:
            return Relation(self.spark.range(1).select(F.lit(1).alias("__one")), {}, set(), True)
        if isinstance(graph, EachGraph):
            named = self.quads_df.filter("g is not null" if graph.names is None else F.col("g").isin(["I" + g for g in graph.names]))
            return join_connected(self.algebra, [match(named, t, self.spark, {}, graph.variable) for t in triples], {graph.variable})
        source = self.triples(graph)
        return join_connected(self.algebra, [match(source, t, self.spark, {}) for t in triples])


def match(source: DataFrame, t: Triple, spark: SparkSession, refs: dict[str, str], graph: str | None = None) -> Relation:
    """One triple pattern over encoded triples; ``graph`` names a variable for the graph of encoded quads."""
    values: dict[str, Value] = {graph: Value(F.col("g"), "term")} if graph else {}
    for name, x in (("s", t.s), ("p", t.p), ("o", t.o)):
        if isinstance(x, (IRI, Literal)):
            source = source.filter(F.col(name) == F.lit(encode(x)))
        elif x.name in values:
            source = source.filter(F.col(name) == values[x.name].col)
        else:
            values[x.name] = Value(F.col(name), "term")
    if not values:
        return Relation(source.select(F.lit(1).alias("__one")), {}, set())
    return build(source, values, set(values))


def join_connected(algebra: Algebra, parts: list[Relation], everywhere: set[str] = frozenset()) -> Relation:
    """Joins relations so that each next one shares a variable with what is joined already, as long as one does; one that all have is no link."""
    parts = list(parts)
    out = parts.pop(0)
    while parts:
        k = next((i for i, p in enumerate(parts) if out.kinds.keys() & p.kinds.keys() - everywhere), 0)
        out = algebra.join(out, parts.pop(k))
    return out


TPCH = [
    Table("region", "r_regionkey", {"r_regionkey": "integer", "r_name": "string"}),
    Table("nation", "n_nationkey", {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "ref:region"}),
    Table("customer", "c_custkey", {"c_custkey": "integer", "c_name": "string", "c_nationkey": "ref:nation", "c_acctbal": "double", "c_mktsegment": "string"}),
    Table("supplier", "s_suppkey", {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "ref:nation", "s_acctbal": "double"}),
    Table("part", "p_partkey", {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"}),
    Table("orders", "o_orderkey", {"o_orderkey": "integer", "o_custkey": "ref:customer", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "dateTime", "o_orderpriority": "string"}),
    Table("lineitem", None, {"l_orderkey": "ref:orders", "l_partkey": "ref:part", "l_suppkey": "ref:supplier", "l_linenumber": "integer", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "dateTime"}),
    Table("events", "event_id", {"event_id": "integer", "ts": "dateTime", "user_id": "integer", "event_type": "string", "value": "double", "props": "string"}),
    Table("documents", "doc_id", {"doc_id": "integer", "text": "lang", "lang": "string", "source": "string", "n_chars": "integer"}, {"text": "lang"}),
    Table("labels", "doc_id", {"quality": "integer", "toxic": "integer"}),
    Table("pages", "page_id", {"page_id": "integer", "url": "string", "html": "string"}),
    Table("conversations", "conv_id * 100000 + turn", {"conv_id": "integer", "turn": "integer", "role": "string"}, derived={"next": "lead(conv_id * 100000 + turn) over (partition by conv_id order by turn)"}),
]


def tables_graph(spark: SparkSession, sf_dir: str) -> VirtualGraph:
    """The driver's tables as a virtual graph; foreign keys are links between resources."""
    return VirtualGraph(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), TPCH)
