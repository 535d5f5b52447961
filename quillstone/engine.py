"""The query engine: SELECT, ASK, CONSTRUCT, DESCRIBE and updates over a graph source."""

from __future__ import annotations

import re
import threading
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lower import Lowering
from .operators.relation import Relation, q
from .plans import algebra as A
from .plans.parser import parse_query
from .plans.rewrite import rewrite
from .sources.graphs import DB, QuadGraph, tables_graph
from .terms import Value, encode, to_term

PREFIXES = {
    "rdf": A.RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": A.XSD, "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#",
    "foaf": "http://xmlns.com/foaf/0.1/", "fn": "urn:quillstone:fn:", "search": "urn:quillstone:search:", "geof": "http://www.opengis.net/def/function/geosparql/", "geo": "http://www.opengis.net/ont/geosparql#",
    "uom": "http://www.opengis.net/def/uom/OGC/1.0/", "wikibase": "http://wikiba.se/ontology#", "bd": "http://www.bigdata.com/rdf#", "db": DB,
}


class Engine:
    """Answers SPARQL over ``source`` (a graph source). Queries give lazy DataFrames.

    A query may open with lines ``#key:value``: ``no_optimizer`` leaves the algebra as written, ``user_locales`` sets the languages of
    [AUTO_LANGUAGE]. ``timeout`` in seconds cancels the jobs of an action that runs under ``limited()``.
    """

    def __init__(self, spark: SparkSession, source: Any, prefixes: dict[str, str] | None = None, base: str = "", endpoints: dict[str, Any] | None = None, indexes: dict[str, DataFrame] | None = None, timeout: float | None = None):
        self.spark, self.source, self.base, self.timeout = spark, source, base, timeout
        self.prefixes = PREFIXES | (prefixes or {})
        self.options = {"endpoints": endpoints or {}, "indexes": indexes or {}}

    @classmethod
    def over_tables(cls, spark: SparkSession, sf_dir: str, **options: Any) -> Engine:
        return cls(spark, tables_graph(spark, sf_dir), {"": DB} | options.pop("prefixes", {}), **options)

    @classmethod
    def over_quads(cls, spark: SparkSession, quads: DataFrame, **options: Any) -> Engine:
        return cls(spark, QuadGraph(spark, quads), **options)

    def parse(self, text: str) -> tuple[A.Query, dict[str, str]]:
        config = dict(re.findall(r"^#(\w+):(.*)$", re.match(r"(?:#[^\n]*\n|\s)*", text)[0], re.M))
        query = parse_query(text, self.prefixes, self.base)
        if config.get("no_optimizer", "").strip() not in ("1", "true"):
            query.pattern = rewrite(query.pattern)
        return query, config

    def relation(self, query: A.Query, config: dict[str, str]) -> Relation:
        low = Lowering(self.spark, self.source, self.base, query.default_graphs, query.named_graphs if query.default_graphs or query.named_graphs else None, self.options | {"config": config, "wanted": mentioned(query.pattern)})
        return low(query.pattern)

    def plain(self, r: Relation, terms: bool = False) -> DataFrame:
        """A relation as a table: native columns, IRIs spelled out, terms of unknown kind by their lexical form (or encoded)."""
        out = []
        for v in r.kinds:
            x = r.value(v)
            if x.kind.startswith("ref:"):
                x = Value(F.concat(F.lit(self.source.refs[x.kind[4:]]), x.col.cast("string")), "iri")
            if terms:
                out.append(to_term(x).alias(v))
            elif x.kind == "term":
                from .terms import term_lex

                out.append(F.coalesce(term_lex(x.col), F.concat(F.lit("_:"), F.substring(x.col, 2, 1 << 30))).alias(v))
            else:
                out.append(x.col.alias(v))
        return r.df.select(*out)

    def select(self, text: str, terms: bool = False) -> DataFrame:
        """A row per solution. ``terms``: every column holds encoded terms, with datatypes and languages."""
        query, config = self.parse(text)
        if query.form != "SELECT":
            raise ValueError(f"a {query.form} query")
        return self.plain(self.relation(query, config), terms)

    def match(self, patterns: list[tuple[str, str, str]]) -> DataFrame:
        """Triple patterns without SPARQL: each part is a ?variable, an <iri>, a prefixed name or a literal; a row per match of all of them."""
        return self.select("SELECT * WHERE { " + " . ".join(" ".join(p) for p in patterns) + " }")

    def ask(self, text: str) -> bool:
        query, config = self.parse(text)
        return not self.relation(query, config).df.isEmpty()

    def construct(self, text: str) -> DataFrame:
        """(s, p, o) encoded terms, distinct."""
        query, config = self.parse(text)
        if query.form == "DESCRIBE":
            return self.describe_query(query, config)
        return instantiate(self, self.relation(query, config), [(t, None) for t in query.template]).select("s", "p", "o").distinct()

    describe = construct

    def describe_query(self, query: A.Query, config: dict[str, str]) -> DataFrame:
        """Concise descriptions: the triples of each resource, and those of the blank nodes they lead to."""
        from .operators.materialize import materialized

        r = self.relation(query, config)
        wanted = None
        for d in query.describe:
            if isinstance(d, A.IRI):
                x = self.spark.createDataFrame([("I" + d.value,)], "s string")
            elif d.name in r.kinds:
                v = r.value(d.name)
                if v.kind.startswith("ref:"):
                    v = Value(F.concat(F.lit(self.source.refs[v.kind[4:]]), v.col.cast("string")), "iri")
                x = r.df.select(to_term(v).alias("s")).filter("s is not null")
            else:
                continue
            wanted = x if wanted is None else wanted.union(x)
        triples = self.source.triples(query.default_graphs or None)
        if wanted is None:
            return triples.limit(0)
        newest = materialized(wanted.distinct())
        seen = newest
        out = None
        while not newest.isEmpty():
            found = triples.join(newest, "s", "left_semi")
            out = found if out is None else out.union(found)
            newest = materialized(found.filter(F.col("o").startswith("B")).select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti"))
            seen = seen.union(newest)
        return out.select("s", "p", "o").distinct() if out is not None else triples.limit(0)

    def query(self, text: str) -> Any:
        form = self.parse(text)[0].form
        return {"SELECT": self.select, "ASK": self.ask}.get(form, self.construct)(text)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The algebra and Spark's plan of a query."""
        query, config = self.parse(text)
        df = self.plain(self.relation(query, config))
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return f"{query.pattern}\n\n{plan}"

    @contextmanager
    def limited(self, seconds: float | None = None):
        """Jobs started in this block are cancelled after the timeout."""
        tag = f"quillstone-{id(self)}-{threading.get_ident()}"
        self.spark.addTag(tag)
        timer = threading.Timer(seconds or self.timeout or 300.0, self.spark.interruptTag, [tag])
        timer.start()
        try:
            yield
        finally:
            timer.cancel()
            self.spark.removeTag(tag)


def mentioned(x: Any) -> set[str]:
    """Every variable named anywhere in a pattern."""
    if isinstance(x, A.Var):
        return {x.name}
    if isinstance(x, str):
        return set()
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
        return {x[1]}
    if isinstance(x, A.Project):
        return set(x.vars) | mentioned(x.child)
    if hasattr(x, "__dataclass_fields__"):
        return set().union(*(mentioned(getattr(x, f)) for f in x.__dataclass_fields__))
    if isinstance(x, (list, tuple)):
        return set().union(*map(mentioned, x)) if x else set()
    return set()


def instantiate(engine: Engine, r: Relation, template: list[tuple[A.Triple, Any]]) -> DataFrame:
    """(s, p, o, g) for every solution and template triple that is complete and well formed; blank nodes are new in each solution."""
    names = set(A.variables(A.BGP([t for t, _ in template])))
    fresh = {v for v in names if v.startswith("_b") and v not in r.kinds}
    df = r.df
    if fresh:
        from .operators.materialize import materialized

        df = materialized(df.withColumn("__solution", F.uuid()))

    def cell(x: Any):
        if isinstance(x, A.Var):
            if x.name in fresh:
                return F.concat(F.lit("B"), q("__solution"), F.lit(x.name))
            if x.name not in r.kinds:
                return F.lit(None).cast("string")
            v = r.value(x.name)
            if v.kind.startswith("ref:"):
                v = Value(F.concat(F.lit(engine.source.refs[v.kind[4:]]), v.col.cast("string")), "iri")
            return to_term(v)
        return F.lit(None).cast("string") if x is None else F.lit(encode(x))

    rows = [F.struct(cell(t.s).alias("s"), cell(t.p).alias("p"), cell(t.o).alias("o"), cell(g).alias("g"), F.lit(g is not None).alias("named")) for t, g in template]
    if not rows:
        return engine.spark.createDataFrame([], "s string, p string, o string, g string")
    out = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return out.filter("s is not null and p is not null and o is not null and not s like 'L%' and p like 'I%' and (g is not null or not named)").drop("named")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
