"""Registered queries of the corners: syntax forms, error semantics, formats, loading, pipelines, services of the store, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline_nodes as pn
from .catalog_more import DB, NATION, fresh_path, nation_quads, nation_store, readable
from .engine import Engine
from .functions import registry
from .operators.fulltext import build_index
from .operators.materialize import materialized
from .sources.graphs import tables_graph
from .sources.rdf import QUADS, TurtleParser, nt_lines, read_changes, read_rdf
from .sources.results import csv_lines, tsv_lines
from .store import Store, diff_cat, statistics
from .terms import SEP, Value

XSD = "http://www.w3.org/2001/XMLSchema#"
#: name -> (SPARQL over the tables, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "base_prefix": ("BASE <http://example.org/> PREFIX d: <db/> SELECT ?n ?r WHERE { <db/nation/3> d:n_name ?n ; <db/n_regionkey>/d:r_name ?r }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3"),
    "blank_nodes_in_pattern": ('SELECT ?n WHERE { [] :n_name ?n ; :n_regionkey [ :r_name "ASIA" ] . _:x :n_name ?n }', "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "path_in_graph": ("SELECT ?c (COUNT(*) AS ?n) WHERE { GRAPH :conversations { ?x :conv_id ?c ; :next+ ?y } } GROUP BY ?c", "SELECT x.conv_id AS c, count(*) AS n FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn GROUP BY 1"),
    "agg_bad_member": (
        'SELECT ?s (SUM(?v) AS ?total) (COUNT(?v) AS ?n) WHERE { ?p :p_size ?s BIND(IF(?s > 40, "x", ?s) AS ?v) } GROUP BY ?s',
        "SELECT CAST(p_size AS BIGINT) AS s, CASE WHEN p_size <= 40 THEN CAST(sum(p_size) AS VARCHAR) END AS total, count(*) AS n FROM part GROUP BY p_size",
    ),
    "same_term": ("SELECT ?k (sameTerm(?s, xsd:integer(STR(?s))) AS ?a) (sameTerm(1, 1.0) AS ?b) (sameTerm(?p, ?p) AS ?c) WHERE { ?p :p_partkey ?k ; :p_size ?s }", "SELECT p_partkey AS k, true AS a, false AS b, true AS c FROM part"),
    "type_promotion": (
        "SELECT ?k (STR(DATATYPE(?s + 1)) AS ?i) (STR(DATATYPE(?s + 1.5)) AS ?d) (STR(DATATYPE(?s * 1.5e0)) AS ?e) (STR(DATATYPE(?s / 2)) AS ?q) WHERE { ?p :p_partkey ?k ; :p_size ?s }",
        f"SELECT p_partkey AS k, '{XSD}integer' AS i, '{XSD}decimal' AS d, '{XSD}double' AS e, '{XSD}decimal' AS q FROM part",
    ),
    "bound_fn": (
        "SELECT ?c (BOUND(?o) AS ?has) WHERE { ?cu :c_custkey ?c OPTIONAL { ?o :o_custkey ?cu ; :o_totalprice ?p FILTER(?p > 450000.0) } }",
        "SELECT c_custkey AS c, o_orderkey IS NOT NULL AS has FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000",
    ),
    "iri_fn": (f'SELECT ?n WHERE {{ ?x :n_name ?n ; :n_nationkey ?k FILTER(?x = IRI(CONCAT("{DB}nation/", STR(?k)))) }}', "SELECT n_name AS n FROM nation"),
    "strdt_strlang": (
        'SELECT ?n (STR(DATATYPE(STRDT(?n, :kind))) AS ?d) (LANG(STRLANG(?n, "en")) AS ?l) (STR(STRLANG(?n, "en")) AS ?s) WHERE { ?x :r_name ?n }',
        f"SELECT r_name AS n, '{DB}kind' AS d, 'en' AS l, r_name AS s FROM region",
    ),
    "bnode_fn": ("SELECT (COUNT(DISTINCT ?b) AS ?n) (COUNT(DISTINCT ?t) AS ?blank) WHERE { ?x :n_name ?a BIND(BNODE() AS ?b) BIND(ISBLANK(?b) AS ?t) }", "SELECT count(*) AS n, 1::BIGINT AS blank FROM nation"),
    "uuid_fn": ('SELECT (COUNT(*) AS ?n) WHERE { ?x :n_name ?a BIND(STR(UUID()) AS ?u) BIND(STRUUID() AS ?v) FILTER(REGEX(?u, "^urn:uuid:[0-9a-f-]{36}$") && STRLEN(?v) = 36) }', "SELECT count(*) AS n FROM nation"),
    "rand_now": ('SELECT (COUNT(*) AS ?n) WHERE { ?x :p_size ?s BIND(RAND() AS ?r) FILTER(?r >= 0 && ?r < 1 && NOW() > "2001-01-01T00:00:00Z"^^xsd:dateTime) }', "SELECT count(*) AS n FROM part"),
    "timezone_fn": (
        'SELECT ?k (TZ(?d) AS ?z) (STR(TIMEZONE(?d)) AS ?t) (HOURS(?d) AS ?h) WHERE { ?x :n_nationkey ?k BIND(STRDT(CONCAT("2019-03-04T1", STR(?k - 10 * FLOOR(?k / 10)), ":20:30", IF(?k > 12, "Z", "-05:30")), xsd:dateTime) AS ?d) FILTER(?k < 10 || ?k > 12) }',
        None,
    ),
    "zoned_dates": (
        'SELECT ?k (?a = ?b AS ?same) (?a < ?c AS ?less) (?a = ?d AS ?unsure) WHERE { ?x :n_nationkey ?k BIND(CONCAT("2006-08-", STR(?k + 10000)) AS ?u) BIND(CONCAT("2006-08-", SUBSTR(STR(?k + 101), 2)) AS ?t) BIND(STRDT(CONCAT(?t, "Z"), xsd:date) AS ?a) BIND(STRDT(CONCAT(?t, "+00:00"), xsd:date) AS ?b) BIND(STRDT(CONCAT(?t, "-03:00"), xsd:date) AS ?c) BIND(STRDT(?t, xsd:date) AS ?d) }',
        "SELECT CAST(n_nationkey AS BIGINT) AS k, true AS same, true AS less, NULL::BOOLEAN AS unsure FROM nation",
    ),
    "errors_are_unbound": (
        'SELECT ?k (REGEX(?n, "[") AS ?a) (REGEX(?n, CONCAT("(", ?n)) AS ?b) (REPLACE(?n, "N", "$") AS ?c) (REPLACE(?n, "(N)ATION", "$1$2.") AS ?d) (fn:parse_date(xsd:dateTime("2019-01-02T03:04:05"), "jjj") AS ?e) (STR(123456789012345678901234567890) AS ?f) WHERE { ?x :n_nationkey ?k ; :n_name ?n }',
        "SELECT CAST(n_nationkey AS BIGINT) AS k, NULL::BOOLEAN AS a, NULL::BOOLEAN AS b, NULL::VARCHAR AS c, replace(n_name, 'NATION', 'N.') AS d, NULL::VARCHAR AS e, '123456789012345678901234567890' AS f FROM nation",
    ),
    "geo_distance": (
        'SELECT ?k (ROUND(geof:distance(?p, "POINT(0 0)"^^geo:wktLiteral, uom:metre)) AS ?m) WHERE { ?x :n_nationkey ?k BIND(STRDT(CONCAT("POINT(", STR(?k), " 0)"), geo:wktLiteral) AS ?p) }',
        "SELECT CAST(n_nationkey AS BIGINT) AS k, floor(2 * 6371008.8 * asin(sin(radians(n_nationkey) / 2)) + 0.5) AS m FROM nation",
    ),
    "geo_contains": (
        """SELECT ?k (geof:ehContains("POLYGON((0.5 0, 20.5 0, 20.5 10, 0.5 10, 0.5 0), (4.5 4, 8.5 4, 8.5 6, 4.5 6, 4.5 4))"^^geo:wktLiteral, ?p) AS ?hole)
           (geof:ehContains(?p, "MULTIPOLYGON(((0.5 0, 2.5 0, 2.5 9, 0.5 9, 0.5 0)), ((5.5 0, 7.5 0, 7.5 9, 5.5 9, 5.5 0)))"^^geo:wktLiteral) AS ?many) (geof:ehContains("POLYGON((0 zero, 1))"^^geo:wktLiteral, ?p) AS ?bad)
           WHERE { ?x :n_nationkey ?k BIND(STRDT(CONCAT("POINT(", STR(?k), " 5)"), geo:wktLiteral) AS ?p) }""",
        "SELECT CAST(n_nationkey AS BIGINT) AS k, n_nationkey BETWEEN 1 AND 20 AND n_nationkey NOT BETWEEN 5 AND 8 AS hole, n_nationkey IN (1, 2, 6, 7) AS many, NULL::BOOLEAN AS bad FROM nation",
    ),
    "config_header": ("#no_optimizer:true\n#user_locales:fr\nSELECT ?n WHERE { ?x :n_name ?n ; :n_regionkey ?r FILTER(?k < 2) ?r :r_regionkey ?k }", "SELECT n_name AS n FROM nation WHERE n_regionkey < 2"),
    "custom_aggregate": ("SELECT ?b (<urn:quillstone:example:spread>(?r) AS ?spread) (COUNT(*) AS ?n) WHERE { ?p :p_brand ?b ; :p_retailprice ?r } GROUP BY ?b", "SELECT p_brand AS b, max(p_retailprice) - min(p_retailprice) AS spread, count(*) AS n FROM part GROUP BY 1"),
}
QUERIES["timezone_fn"] = (
    QUERIES["timezone_fn"][0],
    """SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey > 12 THEN 'Z' ELSE '-05:30' END AS z, CASE WHEN n_nationkey > 12 THEN 'PT0S' ELSE '-PT5H30M' END AS t, 10 + n_nationkey % 10 AS h
       FROM nation WHERE n_nationkey < 10 OR n_nationkey > 12""",
)


@registry.aggregate("urn:quillstone:example:spread")
def spread(c, v: Value, distinct: bool) -> Value:
    """The largest number less the smallest one."""
    return Value(F.max(v.col.cast("double")) - F.min(v.col.cast("double")), "double")


def over(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Engine.over_tables(spark, sf_dir).select(text)


def conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns without SPARQL."""
    return Engine.over_tables(spark, sf_dir).match([("?c", ":c_nationkey", "?n"), ("?n", ":n_regionkey", f"<{DB}region/2>"), ("?c", ":c_name", "?name")]).select("name")


def construct_bnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new blank node for each solution."""
    t = Engine.over_tables(spark, sf_dir).construct("CONSTRUCT { ?n :at [ :region ?r ] } WHERE { ?n :n_regionkey ?r }")
    return t.groupBy(F.substring_index("p", "/", -1).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("s").startswith("B"), F.col("s")).when(F.col("o").startswith("B"), F.col("o"))).alias("blank"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists are made for each part and walked again."""
    t = Engine.over_tables(spark, sf_dir).construct("CONSTRUCT { ?p :about ( ?b ?s ?t ) } WHERE { ?p :p_brand ?b ; :p_size ?s ; :p_type ?t }")
    quads = materialized(t).withColumn("g", F.lit(None).cast("string"))
    return Engine.over_quads(spark, quads, prefixes={"": DB}).select("SELECT ?p ?v WHERE { ?p :about/rdf:rest*/rdf:first ?v }")


def many_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for every customer; one plan whatever their number."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s, g = F.concat(F.lit(f"I{DB}orders/"), F.col("o_orderkey").cast("string")), F.concat(F.lit(f"I{DB}customer/"), F.col("o_custkey").cast("string"))
    pair = lambda p, v: F.struct(F.lit(f"I{DB}{p}").alias("p"), F.concat(F.lit(f"Lxsd:string{SEP}"), v).alias("o"))
    quads = o.select(s.alias("s"), g.alias("g"), F.explode(F.array(pair("status", F.col("o_orderstatus")), pair("priority", F.col("o_orderpriority")))).alias("x")).select("s", "x.p", "x.o", "g")
    return Engine.over_quads(spark, quads, prefixes={"": DB}).select('SELECT ?g (COUNT(*) AS ?n) (MAX(?b) AS ?last) WHERE { GRAPH ?g { ?o :status ?a ; :priority ?b FILTER(?a = "F") } } GROUP BY ?g')


def notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as Turtle, TriG, RDF/XML and gzipped lines, and read by their notation from folders."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    iri, name = F.concat(F.lit(DB + "nation/"), F.col("n_nationkey").cast("string")), F.col("n_name")
    at = {k: fresh_path(spark, k) for k in ("turtle", "trig", "rdfxml", "lines")}
    for k, line in (
        ("turtle", F.concat(F.lit("<"), iri, F.lit(f'> <{DB}turtle> "'), name, F.lit('"@en .'))),
        ("trig", F.concat(F.lit(f"<{DB}g> {{ <"), iri, F.lit(f'> <{DB}trig> "'), name, F.lit('" . }'))),
    ):
        n.select(line).write.text(at[k])
    xml = F.concat(F.lit(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="{DB}">'), F.array_join(F.collect_list(F.concat(F.lit('<rdf:Description rdf:about="'), iri, F.lit('"><rdfxml>'), name, F.lit("</rdfxml></rdf:Description>"))), ""), F.lit("</rdf:RDF>"))
    n.agg(xml.alias("value")).write.text(at["rdfxml"])
    nt_lines(tables_graph(spark, sf_dir).quads(["region"]).select("s", "p", "o")).write.option("compression", "gzip").text(at["lines"])
    out = read_rdf(spark, at["lines"], "ntriples")
    for k in ("turtle", "trig", "rdfxml"):
        out = out.unionByName(read_rdf(spark, at[k], k))
    return out.groupBy(F.substring_index("p", "/", -1).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("graphs"), F.count_distinct("o").alias("objects")).filter(F.col("p") != "22-rdf-syntax-ns#type")


def dataset_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store dumped as a dataset, loaded into another one with replacement, and dumped as lines."""
    a, b, lines = fresh_path(spark, "a.parquet"), Store(spark, fresh_path(spark, "b"), prefixes={"": DB}), fresh_path(spark, "c.nt")
    nation_store(spark, sf_dir).dump(a)
    b.update("INSERT DATA { :old :p 1 }")
    b.load(a, "parquet", replace=True)
    b.dump(lines, "ntriples")
    return readable(read_rdf(spark, lines, "ntriples").select("s", "p", "o"))


def change_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of changes, applied to a store."""
    st, path = nation_store(spark, sf_dir), fresh_path(spark, "changes")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = lambda sign, name: F.concat(F.lit(f"{sign} <{DB}nation/"), F.col("n_nationkey").cast("string"), F.lit(f'> <{DB}n_name> "'), name, F.lit('" .'))
    n.filter("n_nationkey < 5").select(F.explode(F.array(line("-", F.col("n_name")), line("+", F.lit("changed"))))).write.text(path)
    c = read_changes(spark, path)
    st.change(adds=c.filter("operation = 'add'").drop("operation"), dels=c.filter("operation = 'remove'").drop("operation"))
    return st.engine().select("SELECT ?k ?n WHERE { ?s :n_nationkey ?i ; :n_name ?n BIND(xsd:integer(?i) AS ?k) }")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a folder taken in as a stream."""
    from .streaming.ingest import ingest, line_stream

    st, path = Store(spark, fresh_path(spark, "store"), prefixes={"": DB}), fresh_path(spark, "lines")
    nt_lines(tables_graph(spark, sf_dir).quads(["nation"]).select("s", "p", "o")).write.text(path)
    ingest(st, line_stream(spark, path), fresh_path(spark, "checkpoint"), available_now=True).awaitTermination()
    return st.engine().select("SELECT ?n WHERE { ?s :n_name ?n }")


def result_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(Engine.over_tables(spark, sf_dir).select('SELECT ?x (CONCAT(?n, ",", "a") AS ?c) ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k }', terms=True))


def result_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsv_lines(Engine.over_tables(spark, sf_dir).select("SELECT ?x ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k }", terms=True))


def fulltext_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of one property in two languages, made anew after a change of its source."""
    source = tables_graph(spark, sf_dir)
    index = build_index(source.triples([DB + "documents"]), [DB + "text"], ["fr", "de"])
    return Engine(spark, source, {"": DB}, indexes={"": index}).select('SELECT ?d WHERE { ?d search:matches [ search:query "license the" ; search:property :text ] }')


CONFIG = """@prefix p: <urn:quillstone:pipe:> . @prefix : <urn:c/> .
:root p:kind "predicate" ; p:value "${db}n_name" ; p:yes :words ; p:no :typed .
:words p:kind "text" ; p:value "NATION_1*" ; p:yes :ones ; p:no :others . :ones p:name "ones" . :others p:name "others" .
:typed p:kind "type" ; p:value "${db}region" ; p:yes :regions ; p:no :short . :regions p:name "regions" .
:short p:kind "shorter" ; p:value "2" ; p:yes :digits ; p:no :rest . :digits p:name "digits" . :rest p:name "rest" ."""


def pipeline_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline from a configuration graph, with a node kind of our own."""
    pn.KINDS["shorter"] = lambda found, data: pn.where(F.col("o").startswith("L") & (F.length(F.substring_index("o", SEP, -1)) < int(found[0])))
    t = materialized(tables_graph(spark, sf_dir).quads(["nation", "region"]).select("s", "p", "o"))
    node = pn.compile_config(spark.createDataFrame(TurtleParser(CONFIG).quads(), QUADS), t, "urn:c/root", {"db": DB})
    return counted(node.run(t))


def pipeline_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked nodes: language, then text, then a point in a polygon."""
    t = tables_graph(spark, sf_dir).quads(["documents"]).select("s", "p", "o")
    texts = counted(pn.chain(pn.Node(route=pn.predicate_filter(DB + "text")), pn.Node(route=pn.language_filter("fr", "de")), pn.Node(route=pn.text_filter("+license the")), pn.Node("found")).run(t))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("I:x").alias("s"), F.lit("I:p").alias("p"), F.concat(F.lit(f"L:wkt{SEP}POINT("), F.col("n_nationkey").cast("string"), F.lit(" 1)")).alias("o"))
    return texts.unionByName(counted(pn.Node(route=pn.geo_filter("POLYGON((0.5 0, 9.5 0, 9.5 2, 0.5 2, 0.5 0))"), yes=[pn.Node("inside")], no=[pn.Node("outside")]).run(n)))


def counted(ends: dict[str, DataFrame]) -> DataFrame:
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("target"), "n") for name, rows in sorted(ends.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_service_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label service stands before the pattern whose variables it labels."""
    quads = nation_quads(spark, sf_dir)
    names = quads.filter(F.col("p") == F.lit(f"I{DB}n_name")).select("s", F.lit("Ihttp://www.w3.org/2000/01/rdf-schema#label").alias("p"), F.concat(F.lit(f"L@en{SEP}"), F.substring_index("o", SEP, -1)).alias("o"), "g")
    return Engine.over_quads(spark, quads.unionByName(names), prefixes={"": DB}).select('SELECT ?x ?xLabel WHERE { SERVICE wikibase:label { [] wikibase:language "[AUTO_LANGUAGE],en" } ?x a :nation }')


def update_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on graphs that aren't there (or are) fail, unless they are SILENT."""
    st = nation_store(spark, sf_dir)
    st.update("INSERT DATA { GRAPH :g { :a :p 1 } }")
    tried = [("drop", "DROP {} GRAPH :none"), ("copy", "COPY {} :none TO :g2"), ("move", "MOVE {} :none TO :g2"), ("add", "ADD {} :none TO :g2"), ("create", "CREATE {} GRAPH :g"), ("load", "LOAD {} <file:///no/such/file.nt>")]
    out = []
    for name, text in tried:
        st.update(text.format("SILENT"))
        try:
            st.update(text.format(""))
            failed = False
        except Exception:
            failed = True
        out.append((name, failed, st.size()))
    return spark.createDataFrame(out, "operation string, failed boolean, size long")


def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(nation_quads(spark, sf_dir))


def store_diff_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals and additions of whole datasets at once."""
    q = nation_quads(spark, sf_dir)
    added = q.filter(F.col("p") == F.lit(f"I{DB}n_name")).withColumn("p", F.lit(f"I{DB}label"))
    return readable(diff_cat(q, q.filter(F.col("p") == F.lit(f"I{DB}n_name")), added).select("s", "p", "o").filter(F.col("p").startswith(f"I{DB}")))


def store_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge threshold, and listeners that hear what has changed."""
    heard = []
    st = Store(spark, fresh_path(spark, "store"), threshold=30, prefixes={"": DB})
    st.listeners.append(lambda adds, dels: heard.append((adds.count(), dels.count(), len(st.manifest()["base"]))))
    st.update("INSERT DATA { :a :p 1 , 2 }")
    st.add(nation_quads(spark, sf_dir))
    st.update("DELETE WHERE { ?s :n_nationkey ?k }")
    return spark.createDataFrame([(i, *h) for i, h in enumerate(heard)], "step long, added long, removed long, bases long")


def explain_and_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of a query, and its rows under a time limit."""
    e = Engine.over_tables(spark, sf_dir, timeout=600)
    text = "SELECT ?n WHERE { ?x :n_name ?n }"
    with e.limited():
        n = e.select(text).count()
    return spark.createDataFrame([("Physical Plan" in e.explain(text), "FileScan" in e.explain(text, "simple") or "Scan parquet" in e.explain(text, "simple"), n)], "planned boolean, scanned boolean, n long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        conjunctive, construct_bnodes, collections, many_graphs, notations, dataset_round_trip, change_lines, stream_ingest, result_csv, result_tsv, fulltext_languages, pipeline_config, pipeline_chain, label_service_first,
        update_silent, store_statistics, store_diff_cat, store_options, explain_and_limit,
    )
    return {name: (lambda spark, sf_dir, text=text: over(spark, sf_dir, text)) for name, (text, _) in QUERIES.items()} | {f.__name__: f for f in found}


WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')"


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()} | {
        "conjunctive": "SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
        "construct_bnodes": "SELECT 'at' AS p, count(*) AS n, count(*) AS blank FROM nation UNION ALL SELECT 'region', count(*), count(*) FROM nation",
        "collections": f"SELECT '{DB}part/' || p_partkey AS p, unnest([p_brand, CAST(p_size AS VARCHAR), p_type]) AS v FROM part",
        "many_graphs": f"SELECT '{DB}customer/' || o_custkey AS g, count(*) AS n, max(o_orderpriority) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
        "notations": """SELECT 'turtle' AS p, count(*) AS n, 0::BIGINT AS graphs, count(DISTINCT n_name) AS objects FROM nation UNION ALL SELECT 'trig', count(*), count(*), count(DISTINCT n_name) FROM nation
                        UNION ALL SELECT 'rdfxml', count(*), 0, count(DISTINCT n_name) FROM nation UNION ALL SELECT 'r_name', count(*), 0, count(*) FROM region UNION ALL SELECT 'r_regionkey', count(*), 0, count(*) FROM region""",
        "dataset_round_trip": f"WITH {NATION} SELECT * FROM t UNION ALL SELECT * FROM u",
        "change_lines": "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey < 5 THEN 'changed' ELSE n_name END AS n FROM nation",
        "stream_ingest": "SELECT n_name AS n FROM nation",
        "result_csv": f"""SELECT '{DB}nation/' || n_nationkey || ',"' || n_name || ',a",' || n_nationkey AS value FROM nation""",
        "result_tsv": f"""SELECT '<{DB}nation/' || n_nationkey || '>' || chr(9) || '"' || n_name || '"' || chr(9) || n_nationkey AS value FROM nation""",
        "fulltext_languages": f"SELECT '{DB}documents/' || doc_id AS d FROM documents WHERE lang IN ('fr', 'de') AND len(list_intersect({WORDS}, ['license', 'the'])) > 0",
        "pipeline_config": """SELECT 'ones' AS target, count(*) AS n FROM nation WHERE n_name LIKE 'NATION_1%' UNION ALL SELECT 'others', count(*) FROM nation WHERE n_name NOT LIKE 'NATION_1%'
                              UNION ALL SELECT 'regions', 3 * count(*) FROM region UNION ALL SELECT 'digits', count(*) FROM nation WHERE n_nationkey < 10
                              UNION ALL SELECT 'rest', 2 * count(*) + count(*) FILTER (n_nationkey >= 10) FROM nation""",
        "pipeline_chain": f"""SELECT 'found' AS target, count(*) AS n FROM documents WHERE lang IN ('fr', 'de') AND list_contains({WORDS}, 'license')
                              UNION ALL SELECT 'inside', count(*) FROM nation WHERE n_nationkey BETWEEN 1 AND 9 UNION ALL SELECT 'outside', count(*) FROM nation WHERE n_nationkey NOT BETWEEN 1 AND 9""",
        "label_service_first": f"""SELECT '{DB}nation/' || n_nationkey AS x, n_name AS "xLabel" FROM nation""",
        "update_silent": "SELECT unnest(['drop', 'copy', 'move', 'add', 'create', 'load']) AS operation, true AS failed, (SELECT 4 * count(*) FROM nation) + (SELECT 3 * count(*) FROM region) + 1 AS size",
        "store_statistics": f"WITH {NATION}, a AS (SELECT * FROM t UNION ALL SELECT * FROM u) SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects, 0::BIGINT AS graphs FROM a",
        "store_diff_cat": f"WITH {NATION} SELECT s, CASE WHEN p = '{DB}n_name' THEN '{DB}label' ELSE p END AS p, o FROM (SELECT * FROM t UNION ALL SELECT * FROM u) WHERE starts_with(p, '{DB}')",
        "store_options": """SELECT 0::BIGINT AS step, 2::BIGINT AS added, 0::BIGINT AS removed, 0::BIGINT AS bases UNION ALL SELECT 1, (SELECT 4 * count(*) FROM nation) + (SELECT 3 * count(*) FROM region), 0, 0
                            UNION ALL SELECT 2, 0, (SELECT count(*) FROM nation), 1""",
        "explain_and_limit": "SELECT true AS planned, true AS scanned, count(*) AS n FROM nation",
    }
