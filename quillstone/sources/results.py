"""Result formats: SPARQL JSON and XML, CSV, TSV. Rows come as encoded terms (``Engine.select(..., terms=True)``).

CSV and TSV lines are made by Spark, so they can be written from executors; JSON and XML documents are streamed row by row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import IRI, RDF, XSD
from ..terms import decode, term_lex
from .rdf import nt_term

MIME = {
    "application/sparql-results+json": "json", "application/json": "json", "application/sparql-results+xml": "xml", "application/xml": "xml", "text/csv": "csv", "text/tab-separated-values": "tsv",
    "application/n-triples": "ntriples", "text/plain": "ntriples",
}


def choose(accept: str, default: str = "json") -> str:
    """The format an Accept header asks for, by its q-weights."""
    best = (0.0, default)
    for part in accept.split(","):
        name, _, params = part.strip().partition(";")
        weight = next((float(p.split("=")[1]) for p in params.split(";") if p.strip().startswith("q=")), 1.0)
        found = MIME.get(name.strip()) or (default if name.strip() == "*/*" else None)
        if found and weight > best[0]:
            best = (weight, found)
    return best[1]


def csv_lines(df: DataFrame) -> DataFrame:
    def cell(c: str):
        x = F.coalesce(term_lex(F.col(f"`{c}`")), F.concat(F.lit("_:"), F.substring(F.col(f"`{c}`"), 2, 1 << 30)), F.lit(""))
        return F.when(F.regexp_like(x, F.lit('[",\\n\\r]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return df.select(F.array_join(F.array(*map(cell, df.columns)), ",").alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    short = lambda c: F.regexp_replace(c, r'^"([+-]?[0-9]+)"\^\^<http://www\.w3\.org/2001/XMLSchema#integer>$', "$1")
    return df.select(F.array_join(F.array(*(F.coalesce(short(nt_term(F.col(f"`{c}`"))), F.lit("")) for c in df.columns)), "\t").alias("value"))


def _binding(t: Any) -> dict:
    if isinstance(t, IRI):
        return {"type": "uri", "value": t.value}
    if isinstance(t, str):
        return {"type": "bnode", "value": t[2:]}
    out = {"type": "literal", "value": t.lex}
    if t.lang:
        out["xml:lang"] = t.lang
    elif t.datatype not in (XSD + "string", RDF + "langString"):
        out["datatype"] = t.datatype
    return out


def serialize(result: DataFrame | bool, form: str) -> Iterator[str]:
    """Chunks of a result document."""
    if isinstance(result, bool):
        if form == "xml":
            yield f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{str(result).lower()}</boolean></sparql>\n'
        else:
            yield json.dumps({"head": {}, "boolean": result})
        return
    names = result.columns
    if form in ("csv", "tsv"):
        yield ",".join(names) + "\r\n" if form == "csv" else "\t".join("?" + n for n in names) + "\n"
        for r in (csv_lines if form == "csv" else tsv_lines)(result).toLocalIterator():
            yield r[0] + ("\r\n" if form == "csv" else "\n")
        return
    rows = ({n: _binding(decode(x)) for n, x in zip(names, r) if x is not None} for r in result.toLocalIterator())
    if form == "json":
        yield json.dumps({"head": {"vars": names}})[:-1] + ', "results": {"bindings": ['
        for i, row in enumerate(rows):
            yield (", " if i else "") + json.dumps(row, ensure_ascii=False)
        yield "]}}"
        return
    yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f"<variable name={quoteattr(n)}/>" for n in names) + "</head><results>\n"
    for row in rows:
        cells = []
        for n, b in row.items():
            extra = f" xml:lang={quoteattr(b['xml:lang'])}" if "xml:lang" in b else f" datatype={quoteattr(b['datatype'])}" if "datatype" in b else ""
            cells.append(f"<binding name={quoteattr(n)}><{b['type']}{extra}>{escape(b['value'])}</{b['type']}></binding>")
        yield "<result>" + "".join(cells) + "</result>\n"
    yield "</results></sparql>\n"
