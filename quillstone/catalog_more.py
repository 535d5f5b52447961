"""Registered queries that aren't one SELECT: construct, ask, describe, updates, store operations, services, formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline_nodes, store
from .engine import Engine
from .operators.materialize import materialized, shared_dir
from .sources.graphs import DB, tables_graph
from .sources.rdf import nt_lines, read_rdf, write_ntriples
from .store import Store
from .terms import SEP, term_lex

RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"


def fresh_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}/{name}"


def readable(df: DataFrame) -> DataFrame:
    """Encoded terms by their IRIs and lexical forms."""
    return df.select(*(F.coalesce(term_lex(F.col(c)), F.lit("")).alias(c) for c in df.columns))


def nation_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as quads of the default graph."""
    return tables_graph(spark, sf_dir).quads(["nation", "region"]).withColumn("g", F.lit(None).cast("string"))


def nation_store(spark: SparkSession, sf_dir: str) -> Store:
    out = Store(spark, fresh_path(spark, "store"), prefixes={"": DB})
    out.add(nation_quads(spark, sf_dir))
    return out


def construct_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(Engine.over_tables(spark, sf_dir).construct("CONSTRUCT { ?r :has ?n . ?n :label ?x } WHERE { ?n :n_regionkey ?r ; :n_name ?x }"))


def construct_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(Engine.over_tables(spark, sf_dir).construct("CONSTRUCT WHERE { ?r :r_name ?n }"))


def ask_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine.over_tables(spark, sf_dir)
    found = [("yes", e.ask("ASK { ?o :o_totalprice ?p FILTER(?p > 100.0) }")), ("no", e.ask("ASK { ?o :o_totalprice ?p FILTER(?p < 0.0) }"))]
    return spark.createDataFrame(found, "question string, answer boolean")


def describe_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(Engine.over_tables(spark, sf_dir).describe(f"DESCRIBE <{DB}nation/7>")).select("p", "o")


def describe_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readable(Engine.over_tables(spark, sf_dir).describe('DESCRIBE ?n WHERE { ?n :n_regionkey/:r_name "ASIA" }'))


def label_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents get a label in their language; French is preferred, then English, else empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = F.concat(F.lit(f"I{DB}documents/"), F.col("doc_id").cast("string"))
    label = F.concat(F.lit("L@"), F.col("lang"), F.lit(SEP), F.concat(F.lit("document "), F.col("n_chars").cast("string")))
    kind = docs.select(s.alias("s"), F.lit(f"I{DB}length").alias("p"), F.concat(F.lit(f"Lxsd:integer{SEP}"), F.col("n_chars").cast("string")).alias("o"))
    quads = kind.union(docs.select(s, F.lit("I" + RDFS_LABEL), label)).withColumn("g", F.lit(None).cast("string"))
    return Engine.over_quads(spark, quads, prefixes={"": DB}).select('SELECT ?d ?dLabel WHERE { ?d :length ?n SERVICE wikibase:label { [] wikibase:language "fr,en" } FILTER(?n > 500) }')


def service_federation(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = tables_graph(spark, sf_dir)
    e = Engine.over_tables(spark, sf_dir, endpoints={"http://remote.example/sparql": remote})
    return e.select("SELECT ?n ?r WHERE { ?x :n_name ?n ; :n_regionkey ?k SERVICE <http://remote.example/sparql> { ?k :r_name ?r } SERVICE SILENT <http://nowhere.example/> { ?k ?p ?o } }")


def update_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = nation_store(spark, sf_dir)
    st.update(f"""
        INSERT DATA {{ <{DB}nation/99> :n_name "NEW" ; :n_regionkey <{DB}region/1> . <{DB}nation/1> :n_name "NATION_1" }} ;
        DELETE DATA {{ <{DB}nation/2> :n_name "NATION_2" . <{DB}nation/3> :n_name "other" }}""")
    return st.engine().select("SELECT ?s ?n WHERE { ?s :n_name ?n }")


def update_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = nation_store(spark, sf_dir)
    st.update(f"""DELETE {{ ?s :n_regionkey ?r }} INSERT {{ ?s :moved <{DB}region/4> }} WHERE {{ ?s :n_regionkey ?r . ?r :r_regionkey ?k FILTER(?k < 2) }} ; DELETE WHERE {{ ?s :n_nationkey 0 }}""")
    return readable(st.quads().select("s", "p", "o").filter(F.col("s").startswith(f"I{DB}nation")))


def update_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADD, COPY, MOVE, CLEAR and WITH between named graphs."""
    st = nation_store(spark, sf_dir)
    st.update("""INSERT { GRAPH :g1 { ?s :r_name ?n } GRAPH :g2 { ?s :r_name "x" } } WHERE { ?s :r_name ?n } ;
                 ADD :g1 TO :g2 ; COPY :g1 TO :g3 ; MOVE :g3 TO :g4 ; CLEAR GRAPH :g1 ; WITH :g4 DELETE { ?s :r_name ?n } WHERE { ?s :r_name ?n FILTER(?n = "ASIA") } ; CLEAR DEFAULT""")
    return st.engine().select("SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g")


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes and adds again over several versions, then merges: the quads are what they were."""
    st = nation_store(spark, sf_dir)
    st.update("DELETE WHERE { ?s :n_name ?n }")
    st.add(nation_quads(spark, sf_dir))
    st.begin()
    st.update(f"DELETE WHERE {{ ?s :r_name ?n }} ; INSERT DATA {{ <{DB}region/0> :r_name \"AGAIN\" }}")
    st.commit()
    st.merge()
    st.vacuum()
    return readable(st.quads().select("s", "p", "o"))


def store_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = nation_quads(spark, sf_dir)
    return readable(store.cat(q, q.filter(F.col("s").startswith(f"I{DB}region"))).select("s", "p", "o"))


def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = nation_quads(spark, sf_dir)
    return readable(store.diff(q, q.filter(F.col("p") == F.lit(f"I{DB}n_name"))).select("s", "p", "o"))


def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier triples written as N-Triples, read again and queried."""
    path = fresh_path(spark, "supplier.nt")
    write_ntriples(tables_graph(spark, sf_dir).quads(["supplier"]).select("s", "p", "o"), path)
    return Engine.over_quads(spark, read_rdf(spark, path), prefixes={"": DB}).select("SELECT ?s ?n (xsd:double(?b) AS ?bal) WHERE { ?s :s_name ?n ; :s_acctbal ?b FILTER(?b > 5000) }")


def quads_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregation over stored terms, whose kinds are known only at run time."""
    quads = materialized(tables_graph(spark, sf_dir).quads(["part"])).withColumn("g", F.lit(None).cast("string"))
    e = Engine.over_quads(spark, quads, prefixes={"": DB})
    return e.select("SELECT ?b (COUNT(*) AS ?n) (xsd:integer(SUM(?s)) AS ?total) (xsd:integer(MAX(?s)) AS ?top) (xsd:double(MIN(?r)) AS ?low) WHERE { ?p :p_brand ?b ; :p_size ?s ; :p_retailprice ?r } GROUP BY ?b")


def pipeline_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples routed by type and predicate."""
    t = tables_graph(spark, sf_dir).quads(["nation", "region"]).select("s", "p", "o")
    node = pipeline_nodes.multi_type(t, {DB + "nation": pipeline_nodes.Node(route=pipeline_nodes.predicate_filter(DB + "n_name"), yes=[pipeline_nodes.Node("names")], no=[pipeline_nodes.Node("rest")]), DB + "region": pipeline_nodes.Node("regions")})
    out = None
    for name, rows in sorted(node.run(t).items()):
        x = rows.select(F.lit(name).alias("target"))
        out = x if out is None else out.union(x)
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words answered from a token index."""
    from .operators.fulltext import build_index

    source = tables_graph(spark, sf_dir)
    index = build_index(source.triples([DB + "part"]), [DB + "p_type"])
    e = Engine(spark, source, {"": DB}, indexes={"": index})
    return e.select('SELECT ?s WHERE { ?s search:matches [ search:query "small promo" ; search:property :p_type ] }')


def nt_lines_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt_lines(tables_graph(spark, sf_dir).quads(["region"]).select("s", "p", "o"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        construct_triples, construct_where, ask_form, describe_one, describe_where, label_service, service_federation, update_insert_delete, update_delete_where, update_graphs, store_merge, store_cat, store_diff,
        ntriples_round_trip, quads_group, pipeline_routes, fulltext_index, nt_lines_of_region,
    )
    return {f.__name__: f for f in found}


TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
NATION = f"""n AS (SELECT '{DB}nation/' || n_nationkey AS s, * FROM nation), r AS (SELECT '{DB}region/' || r_regionkey AS s, * FROM region),
t AS (SELECT s, '{DB}n_name' AS p, n_name AS o FROM n UNION ALL SELECT s, '{DB}n_nationkey', CAST(n_nationkey AS VARCHAR) FROM n UNION ALL SELECT s, '{DB}n_regionkey', '{DB}region/' || n_regionkey FROM n
      UNION ALL SELECT s, '{TYPE}', '{DB}nation' FROM n),
u AS (SELECT s, '{DB}r_name' AS p, r_name AS o FROM r UNION ALL SELECT s, '{DB}r_regionkey', CAST(r_regionkey AS VARCHAR) FROM r UNION ALL SELECT s, '{TYPE}', '{DB}region' FROM r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "construct_triples": f"""SELECT '{DB}region/' || n_regionkey AS s, '{DB}has' AS p, '{DB}nation/' || n_nationkey AS o FROM nation
                                 UNION SELECT '{DB}nation/' || n_nationkey, '{DB}label', n_name FROM nation""",
        "construct_where": f"SELECT '{DB}region/' || r_regionkey AS s, '{DB}r_name' AS p, r_name AS o FROM region",
        "ask_form": "SELECT 'yes' AS question, (SELECT count(*) > 0 FROM orders WHERE o_totalprice > 100) AS answer UNION ALL SELECT 'no', (SELECT count(*) > 0 FROM orders WHERE o_totalprice < 0)",
        "describe_one": f"WITH {NATION} SELECT p, o FROM t WHERE s = '{DB}nation/7'",
        "describe_where": f"WITH {NATION} SELECT t.* FROM t JOIN n ON n.s = t.s JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
        "label_service": f"SELECT '{DB}documents/' || doc_id AS d, CASE WHEN lang IN ('fr', 'en') THEN 'document ' || n_chars ELSE '' END AS dLabel FROM documents WHERE n_chars > 500",
        "service_federation": "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
        "update_insert_delete": f"SELECT '{DB}nation/' || n_nationkey AS s, n_name AS n FROM nation WHERE n_nationkey <> 2 UNION ALL SELECT '{DB}nation/99', 'NEW'",
        "update_delete_where": f"""WITH {NATION} SELECT s, CASE WHEN p = '{DB}n_regionkey' AND o IN ('{DB}region/0', '{DB}region/1') THEN '{DB}moved' ELSE p END AS p,
                                   CASE WHEN p = '{DB}n_regionkey' AND o IN ('{DB}region/0', '{DB}region/1') THEN '{DB}region/4' ELSE o END AS o FROM t WHERE NOT (s = '{DB}nation/0' AND p = '{DB}n_nationkey')""",
        "update_graphs": f"SELECT '{DB}g2' AS g, 2 * count(*) AS n FROM region UNION ALL SELECT '{DB}g4', count(*) FROM region WHERE r_name <> 'ASIA'",
        "store_merge": f"WITH {NATION} SELECT * FROM t UNION ALL SELECT * FROM u WHERE p <> '{DB}r_name' UNION ALL SELECT '{DB}region/0', '{DB}r_name', 'AGAIN'",
        "store_cat": f"WITH {NATION} SELECT * FROM t UNION ALL SELECT * FROM u",
        "store_diff": f"WITH {NATION} SELECT * FROM t WHERE p <> '{DB}n_name' UNION ALL SELECT * FROM u",
        "ntriples_round_trip": f"SELECT '{DB}supplier/' || s_suppkey AS s, s_name AS n, s_acctbal AS bal FROM supplier WHERE s_acctbal > 5000",
        "quads_group": "SELECT p_brand AS b, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, CAST(max(p_size) AS BIGINT) AS top, min(p_retailprice) AS low FROM part GROUP BY 1",
        "pipeline_routes": "SELECT 'names' AS target, count(*) AS n FROM nation UNION ALL SELECT 'rest', 3 * count(*) FROM nation UNION ALL SELECT 'regions', 3 * count(*) FROM region",
        "fulltext_index": f"SELECT '{DB}part/' || p_partkey AS s FROM part WHERE len(list_intersect(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), ['small', 'promo'])) > 0",
        "nt_lines_of_region": f"""WITH {NATION} SELECT '<' || s || '> <' || p || '> ' || CASE WHEN p = '{TYPE}' THEN '<' || o || '>' WHEN p = '{DB}r_name' THEN '"' || o || '"'
                                  ELSE '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#integer>' END || ' .' AS value FROM u""",
    }
