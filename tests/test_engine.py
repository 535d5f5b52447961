"""Small graphs of our own that mirror the situations the language defines, compared as bags."""

import math

import pytest

from quillstone.engine import Engine
from quillstone.sources.rdf import QUADS, TurtleParser
from quillstone.sources.results import choose, serialize
from quillstone.terms import decode

DATA = """
@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:a :p 1 , 2.5 ; :q :b ; :name "Ann" ; :when "2011-02-01T01:02:03Z"^^xsd:dateTime .
:b :p 1.0 ; :q :c ; :name "Bob"@en ; rdfs:label "b en"@en , "b fr"@fr .
:c :p "x" ; :q :a ; :r _:n ; rdfs:label "c de"@de .
_:n :p 4e0 .
:d :p :b , "z"^^:odd ; :name "" .
"""
TRIG = DATA + ":g1 { :a :in 1 . :b :in 2 } GRAPH :g2 { :a :in 1 . :c :in 3 }"


def engine(spark, text=DATA, **options):
    return Engine.over_quads(spark, spark.createDataFrame(TurtleParser(text).quads(), QUADS), prefixes={"": "http://x/"}, **options)


@pytest.fixture(scope="module")
def e(spark):
    return engine(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def short(x):
    return x.replace("http://x/", ":") if isinstance(x, str) else x


def bag(e, text):
    return sorted((tuple(short(x) for x in r) for r in e.select(text).collect()), key=repr)


def test_same_term_is_not_value_equality(e):
    assert bag(e, "SELECT ?s { ?s :p 1 }") == [(":a",)]
    assert bag(e, "SELECT ?s { ?s :p ?v FILTER(?v = 1) }") == [(":a",), (":b",)]


def test_optional_filter_sees_the_left_side(e):
    assert bag(e, "SELECT ?s ?n { ?s :q ?t OPTIONAL { ?t :name ?n FILTER(?s = :a) } }") == [(":a", "Bob"), (":b", None), (":c", None)]
    assert bag(e, "SELECT ?s ?n { ?s :q ?t OPTIONAL { { ?t :name ?n FILTER(?s = :a) } } }") == [(":a", None), (":b", None), (":c", None)]


def test_minus_and_not_exists_differ(e):
    assert len(bag(e, "SELECT ?s { ?s :q ?t MINUS { ?x :name ?y } }")) == 3
    assert bag(e, "SELECT ?s { ?s :q ?t FILTER NOT EXISTS { ?x :name ?y } }") == []
    assert bag(e, "SELECT ?s { ?s :q ?t MINUS { ?s :name ?y } }") == [(":c",)]


def test_exists_in_an_expression(e):
    assert bag(e, 'SELECT ?s { ?s :q ?t FILTER(?s = :c || EXISTS { ?s :name "Ann" }) }') == [(":a",), (":c",)]
    assert bag(e, "SELECT ?s ?x { ?s :q ?t BIND(EXISTS { ?s :name ?n } AS ?x) }") == [(":a", True), (":b", True), (":c", False)]


def test_compatible_join_on_unbound(e):
    assert bag(e, "SELECT ?s ?t { VALUES (?s ?t) { (:a UNDEF) (UNDEF :a) (:b :a) } ?s :q ?t }") == [(":a", ":b"), (":c", ":a")]
    assert bag(e, "SELECT ?s ?n { { ?s :q ?t OPTIONAL { ?s :name ?n } } { VALUES ?n { 'Ann' } } }") == [(":a", "Ann"), (":c", "Ann")]


def test_errors_are_unbound(e):
    assert bag(e, "SELECT ?s ?y { ?s :p ?v BIND(?v + 1 AS ?y) FILTER(?s = :c || ?s = :a) }") == [(":a", "2"), (":a", "3.5"), (":c", None)]


def test_three_valued_logic(e):
    assert bag(e, "SELECT ?s { ?s :q ?t FILTER(1/0 > 1 || ?s = :a) }") == [(":a",)]
    assert bag(e, "SELECT ?s { ?s :q ?t FILTER(1/0 > 1 && ?s = :a) }") == []


def test_unknown_datatypes(e):
    assert bag(e, 'SELECT ?s { ?s :p ?v FILTER(?v = "z"^^:odd) }') == [(":d",)]
    assert (":d",) not in bag(e, 'SELECT ?s { ?s :p ?v FILTER(?v != "y"^^:odd && isLiteral(?v)) }')


def test_aggregates_over_terms(e):
    assert bag(e, "SELECT ?s (SUM(?v) AS ?t) { ?s :p ?v FILTER(?s IN (:a, :b, :c)) } GROUP BY ?s") == [(":a", "3.5"), (":b", "1"), (":c", None)]
    assert bag(e, "SELECT (AVG(?v) AS ?m) { ?s :p ?v FILTER(isNumeric(?v) && isIRI(?s)) }") == [("1.5",)]
    assert bag(e, "SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?t) (MIN(?v) AS ?m) { :nobody :p ?v }") == [(0, "0", None)]
    assert bag(e, "SELECT ?s (COUNT(*) AS ?n) { ?s :nothing ?v } GROUP BY ?s") == []
    assert bag(e, 'SELECT (GROUP_CONCAT(?n ; SEPARATOR="|") AS ?g) { ?s :name ?n }') == [("|Ann|Bob",)]
    assert bag(e, "SELECT (MAX(?v) AS ?m) { ?s :p ?v FILTER isNumeric(?v) }") == [("4.0",)] or bag(e, "SELECT (MAX(?v) AS ?m) { ?s :p ?v FILTER isNumeric(?v) }") == [("4e0",)]


def test_paths(e):
    nodes = {(":a", x) for x in (":a", ":b", ":c")}
    assert set(bag(e, "SELECT ?s ?o { BIND(:a AS ?s) :a :q+ ?o }")) == nodes
    assert bag(e, "SELECT ?o { :a :q* ?o }") == [(":a",), (":b",), (":c",)]
    assert bag(e, "SELECT ?o { :nowhere :q* ?o }") == [(":nowhere",)]
    assert bag(e, "SELECT ?o { :a :q? ?o }") == [(":a",), (":b",)]
    assert bag(e, "SELECT ?o { :a (:q/:q)|^:q ?o }") == [(":c",), (":c",)]
    assert bag(e, "SELECT ?o { :a !(:p|:name|:when) ?o }") == [(":b",)]
    assert len(bag(e, "SELECT ?s ?o { ?s :q+ ?o }")) == 9
    assert bag(e, "SELECT ?o { :a :q{2} ?o }") == [(":c",)]
    assert e.ask("ASK { :a :q*/:r/:p 4e0 }")


def test_closures_against_brute_force(spark):
    """A chain longer than the rounds between compactions, a cycle with a tail, a diamond and a node that links to itself."""
    links = [(f"c{i}", f"c{i + 1}") for i in range(21)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r1", "t0"), ("t0", "t1")] + [("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("s", "s")]
    g = engine(spark, "@prefix : <http://x/> . " + " ".join(f":{a} :next :{b} ." for a, b in links) + " :c3 :start 1 . :r0 :start 1 . :t1 :end 1 .")
    found = set(links)
    while more := {(a, d) for a, b in found for c, d in links if b == c} - found:
        found |= more
    want = sorted((f":{a}", f":{b}") for a, b in found)
    assert sorted(bag(g, "SELECT ?a ?b { ?a :next+ ?b }")) == want
    assert sorted(bag(g, "SELECT ?b { :c0 :next+ ?b }")) == [(b,) for a, b in want if a == ":c0"]
    assert sorted(bag(g, "SELECT ?a { ?a :next+ :c21 }")) == [(a,) for a, b in want if b == ":c21"]
    assert sorted(bag(g, "SELECT ?a ?b { ?a :start 1 . ?a :next+ ?b }")) == [x for x in want if x[0] in (":c3", ":r0")]
    assert sorted(bag(g, "SELECT ?a ?b { ?b :end 1 . ?a :next+ ?b }")) == [x for x in want if x[1] == ":t1"]


def test_paths_between_patterns_that_share_nothing_else(spark):
    """Ends bound by patterns, by one that a union may leave open, by none, and two pairs of ends that nothing links."""
    g = engine(spark, "@prefix : <http://x/> . " + " ".join(f":n{i} :next :n{i + 1} ." for i in range(6)) + " :n0 :start 1 . :n3 :start 2 . :n3 :end 3 . :n5 :end 4 . :n6 :end 5 . :lone :start 6 , 7 ; :end 8 .")
    starts, ends = [(0, "1"), (3, "2"), (None, "6"), (None, "7")], [(3, "3"), (5, "4"), (6, "5"), (None, "8")]

    def want(*steps):
        return sorted((a, b) for i, a in starts for j, b in ends if (j - i in steps if None not in (i, j) else i == j and 0 in steps))

    for path, steps in (("?", (0, 1)), ("+", range(1, 7)), ("*", range(7)), ("{2,3}", (2, 3)), ("{5,}", (5, 6))):
        assert bag(g, f"SELECT ?a ?b {{ ?x :start ?a . ?x :next{path} ?y . ?y :end ?b }}") == want(*steps), path
        assert bag(g, f"SELECT ?a ?b {{ ?y :end ?b . ?x :next{path} ?y . ?x :start ?a }}") == want(*steps), path
        assert bag(g, f"SELECT ?a ?b {{ {{ ?x :start ?a }} UNION {{ ?z :start 7 BIND(0 AS ?a) }} ?x :next{path} ?y . ?y :end ?b FILTER(?a != 0) }}") == want(*steps), path
    assert len(bag(g, "SELECT * { ?x :start ?a . ?x :next? ?y . ?y :end ?b . ?p :start 2 . ?p :next+ ?q . ?q :end ?c }")) == len(want(0, 1)) * 2
    assert bag(g, "SELECT ?b { :n0 :start ?a . :n3 :end ?c . ?x :start 2 . ?x !:start ?y . :n0 :next+ ?y . ?x :end ?b }") == [("3",)]
    assert bag(g, "SELECT ?b { ?x :nothing ?a . ?x :next* ?y . ?y :end ?b }") == []


def test_graphs(spark):
    g = engine(spark, TRIG)
    assert bag(g, "SELECT ?s { GRAPH :g1 { ?s :in ?v } }") == [(":a",), (":b",)]
    assert bag(g, "SELECT ?g ?s { GRAPH ?g { ?s :in 1 } }") == [(":g1", ":a"), (":g2", ":a")]
    assert bag(g, "SELECT ?s { ?s :in ?v }") == []
    assert bag(g, "SELECT ?s ?v FROM :g1 FROM :g2 { ?s :in ?v }") == [(":a", "1"), (":b", "2"), (":c", "3")]
    assert bag(g, "SELECT ?s FROM NAMED :g2 { GRAPH ?g { ?s :in ?v } }") == [(":a",), (":c",)]
    assert bag(g, "SELECT ?s FROM :g1 FROM NAMED :g2 { ?s :in ?v GRAPH ?g { ?s :in ?v } }") == [(":a",)]
    assert bag(g, "SELECT ?g ?s ?t { GRAPH ?g { ?s :in ?v . ?t :in ?w FILTER(?v < ?w) } }") == [(":g1", ":a", ":b"), (":g2", ":a", ":c")]
    assert bag(g, "SELECT ?g ?s ?v { GRAPH ?g { ?s :in ?v . ?t :in ?w . { ?s :in ?w } UNION { ?t :in ?v } FILTER(?s != ?t) } }") == []


def test_strings_keep_languages(e):
    x = e.select('SELECT (UCASE(?n) AS ?u) (CONCAT(?n, "x"@en) AS ?c) (STRBEFORE(?n, "b"@en) AS ?b) (STRAFTER(?n, "B"@fr) AS ?f) (SUBSTR(?n, 2) AS ?s) { :b :name ?n }', terms=True).first()
    assert [decode(v) and (decode(v).lex, decode(v).lang) for v in x] == [("BOB", "en"), ("Bobx", "en"), ("Bo", "en"), None, ("ob", "en")]


def test_functions(e):
    one = lambda expr: e.select(f"SELECT ({expr} AS ?x) {{ }}").first()[0]
    assert one("ROUND(-2.5)") == -2 and one("ROUND(2.5)") == 3
    assert one('ENCODE_FOR_URI("a b~é*")') == "a%20b~%C3%A9%2A"
    assert one('REPLACE("abcd", "b(.)", "<$1>")') == "a<c>d"
    assert one('REGEX("ABC", "b", "i")') is True
    assert one('SUBSTR("hello", 0, 3)') == "he"
    assert one("IF(1/0 = 1, 1, 2)") is None and float(one("COALESCE(1/0, 7)")) == 7
    assert one("2 IN (1/0, 2)") is True and one("2 IN (1/0, 3)") is None and one("2 NOT IN ()") is True
    assert one('xsd:integer("12")') == 12 and one('xsd:integer("1x")') is None and one('xsd:boolean("1")') is True
    assert one('YEAR("2011-02-01T01:02:03-08:00"^^xsd:dateTime)') == 2011 and one('HOURS("2011-02-01T01:02:03-08:00"^^xsd:dateTime)') == 1
    assert one('TZ("2011-02-01T01:02:03-08:00"^^xsd:dateTime)') == "-08:00" and one('STR(TIMEZONE("2011-02-01T01:02:03-08:00"^^xsd:dateTime))') == "-PT8H"
    assert one("1e0/0") == math.inf and one("1/0") is None and float(one("1/4")) == 0.25
    assert one('STRLEN("日本")') == 2 and one('LANGMATCHES("en-GB", "EN")') is True and one('LANGMATCHES("", "*")') is False
    assert one('sameTerm(1, 1.0)') is False and one("1 = 1.0") is True
    assert one('xsd:double("NaN") = xsd:double("NaN")') is False
    assert one('SHA384("a")').startswith("54a59b9f")
    assert one('DATATYPE("x"@en)') == "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
    assert abs(one("fn:log(8, 2)") - 3) < 1e-9 and one("fn:log(-1)") is None
    assert one('fn:parse_date("2020-03-04"^^xsd:date, "dd.MM.yy")') == "04.03.20"
    d = one('geof:distance("POINT(0 0)"^^geo:wktLiteral, "POINT(1 0)"^^geo:wktLiteral, uom:kilometre)')
    assert abs(d - 111.195) < 0.01
    assert one('geof:ehContains("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"^^geo:wktLiteral, "POINT(1 2)"^^geo:wktLiteral)') is True
    assert one('geof:ehContains("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"^^geo:wktLiteral, "POINT(5 2)"^^geo:wktLiteral)') is False


def test_tuple_function_and_bnode_scope(e):
    assert bag(e, 'SELECT ?w { BIND(fn:split("a,b,,", ",") AS ?w) }') == [("a",), ("b",)]


def test_order_of_mixed_terms(e):
    got = [short(r[0]) for r in e.select("SELECT ?x { { BIND(:a AS ?x) } UNION { BIND(10 AS ?x) } UNION { BIND(9 AS ?x) } UNION { BIND('s' AS ?x) } UNION { } } ORDER BY ?x").collect()]
    assert got == [None, ":a", "9", "10", "s"]


def test_labels(e):
    text = 'SELECT ?s ?sLabel { ?s :q ?t SERVICE wikibase:label { [] wikibase:language "fr,en" } }'
    assert bag(e, text) == [(":a", ""), (":b", "b fr"), (":c", "")]
    assert bag(e, "#user_locales:de\n" + text.replace("fr,en", "[AUTO_LANGUAGE],en")) == [(":a", ""), (":b", "b en"), (":c", "c de")]


def test_construct_and_describe(e):
    got = rows(e.construct("CONSTRUCT { ?s :v [ :is ?v ] } WHERE { ?s :p ?v FILTER(?s = :a) }"))
    assert len(got) == 4 and len({r[2] for r in got if r[1] == "Ihttp://x/v"}) == 2
    got = rows(e.describe("DESCRIBE :c"))
    assert len([r for r in got if r[0].startswith("B")]) == 1 and len(got) == 5


def test_service_errors(e):
    with pytest.raises(LookupError):
        e.select("SELECT * { SERVICE <http://no/> { ?s ?p ?o } }")
    assert len(bag(e, "SELECT ?s { ?s :q ?t SERVICE SILENT <http://no/> { ?s ?p ?o } }")) == 3


def test_optimizer_changes_nothing(e):
    for text in ("SELECT ?s ?v { ?s :p ?v . { ?s :q ?t } FILTER sameTerm(?s, :a) }", "SELECT ?s ?n { { ?s :q ?t } { ?t :name ?n } }"):
        assert bag(e, text) == bag(e, "#no_optimizer:true\n" + text)


def test_result_formats(e):
    df = e.select("SELECT ?s ?n { ?s :name ?n } ORDER BY ?s", terms=True)
    csv = "".join(serialize(df, "csv"))
    assert csv.splitlines()[0] == "s,n" and "http://x/b,Bob" in csv
    assert '"Bob"@en' in "".join(serialize(df, "tsv"))
    import json

    assert json.loads("".join(serialize(df, "json")))["results"]["bindings"][1]["n"] == {"type": "literal", "value": "Bob", "xml:lang": "en"}
    import xml.etree.ElementTree as ET

    ET.fromstring("".join(serialize(df, "xml")))
    assert choose("text/html;q=0.3, text/csv;q=0.8, application/json;q=0.5") == "csv"
    assert "true" in "".join(serialize(True, "json"))


def test_explain_and_timeout(e):
    assert "BGP" in e.explain("SELECT ?s { ?s :p ?o }")
    with e.limited(60):
        assert e.ask("ASK { ?s :p ?o }")


def test_fulltext(e):
    assert bag(e, 'SELECT ?s { ?s search:matches [ search:query "ann nobody" ] }') == [(":a",)]
    assert bag(e, 'SELECT ?s { ?s search:matches [ search:query "bo*" ; search:property :name ] }') == [(":b",)]
    assert bag(e, 'SELECT ?s { ?s search:matches [ search:query "+b -fr" ] }') == [(":b",)]


def test_graph_variable_is_one_plan(spark):
    e = engine(spark, TRIG)
    assert bag(e, "SELECT ?g ?s { GRAPH ?g { ?s :in 1 } }") == [(":g1", ":a"), (":g2", ":a")]
    assert bag(e, "SELECT ?g ?v { GRAPH ?g { :a :in ?v OPTIONAL { :b :in ?w } FILTER(!BOUND(?w)) } }") == [(":g2", "1")]
    assert bag(e, "SELECT ?g { GRAPH ?g { :b :in ?v . :c :in ?w } }") == []
    assert bag(e, "SELECT ?g ?s FROM NAMED :g2 { GRAPH ?g { ?s :in ?v } }") == [(":g2", ":a"), (":g2", ":c")]
    assert bag(e, "SELECT ?g { VALUES ?g { :g2 } GRAPH ?g { :c :in ?v FILTER(!BOUND(?g)) } }") == [(":g2",)]
    many = engine(spark, "".join(f":g{i} {{ :a :in {i} }} " for i in range(300)).join(["@prefix : <http://x/> . ", ""]))
    df = many.select("SELECT ?g { GRAPH ?g { ?s :in ?v FILTER(?v < 3) } }")
    assert df.count() == 3 and "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_every_error_is_unbound(e):
    assert bag(e, 'SELECT (REGEX("a", "[") AS ?x) (REPLACE("a", "(", "b") AS ?y) (REPLACE("a", "a", "$") AS ?z) {}') == [(None, None, None)]
    assert bag(e, 'SELECT (REPLACE("ab", "(a)", "$1$1$2") AS ?x) (REGEX("a[", "[", "q") AS ?y) {}') == [("aab", True)]
    assert bag(e, 'SELECT (STR(99999999999999999999) AS ?x) ("2006-08-23Z"^^xsd:date = "2006-08-23+00:00"^^xsd:date AS ?y) ("2006-08-23"^^xsd:date = "2006-08-23Z"^^xsd:date AS ?z) ("2006-08-23"^^xsd:date < "2006-08-25Z"^^xsd:date AS ?w) {}') == [("99999999999999999999", True, None, True)]
    assert bag(e, 'SELECT (geof:sfWithin("POINT(1 1)", "POINT(1 1)") AS ?x) (fn:parse_date("2011-05-04T01:02:03", "jjj") AS ?y) {}') == [(None, None)]


def test_label_service_before_its_pattern(e):
    assert bag(e, 'SELECT ?s ?sLabel { SERVICE wikibase:label { [] wikibase:language "fr" } ?s :q :c }') == [(":b", "b fr")]
