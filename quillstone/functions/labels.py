"""The label service: ``SERVICE wikibase:label { [] wikibase:language "fr,en" }`` adds ?xLabel, ?xAltLabel and ?xDescription.

For each variable whose label variable the query uses, the label in the first language of the list that has one, else the empty string.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.relation import Relation, build, q
from ..plans.algebra import BGP, IRI, Literal
from ..terms import Value, term_lex, term_tag
from .registry import service

LABEL = "http://wikiba.se/ontology#label"
LANGUAGE = "http://wikiba.se/ontology#language"
PROPERTIES = {"Label": "http://www.w3.org/2000/01/rdf-schema#label", "AltLabel": "http://www.w3.org/2004/02/skos/core#altLabel", "Description": "http://schema.org/description"}


@service(LABEL)
def label(low, node, left: Relation, graph) -> Relation:
    triples = node.child.triples if isinstance(node.child, BGP) else []
    given = next((t.o.lex for t in triples if isinstance(t.p, IRI) and t.p.value == LANGUAGE and isinstance(t.o, Literal)), "en")
    auto = low.options.get("config", {}).get("user_locales", "en")
    languages = [x.strip().lower() for x in given.replace("[AUTO_LANGUAGE]", auto).split(",") if x.strip()]
    wanted = low.options.get("wanted")
    out = left
    source = low.source.triples(graph)
    for v in list(left.kinds):
        for suffix, predicate in PROPERTIES.items():
            name = v + suffix
            if name in out.kinds or wanted is not None and name not in wanted:
                continue
            tag = term_tag(F.col("o"))
            rank = F.array_position(F.array(*(F.lit("@" + x) for x in languages)), tag)
            found = source.filter((F.col("p") == F.lit("I" + predicate)) & tag.isin(["@" + x for x in languages])).groupBy("s").agg(F.min_by(term_lex(F.col("o")), F.struct(rank, term_lex(F.col("o")))).alias("found"))
            labels = build(found, {v: Value(q("s"), "term"), "__found": Value(q("found"), "string")}, {v, "__found"})
            joined = low.algebra.left_join(out, labels)
            out = build(joined.df, {k: x for k, x in joined.scope().items() if k != "__found"} | {name: Value(F.coalesce(q("__found"), F.lit("")), "string")}, out.sure | {name})
    return out
