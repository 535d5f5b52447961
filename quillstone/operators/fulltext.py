"""Full-text patterns: ``?s search:matches [ search:query "words" ; search:property :p ]``.

A query is words (any of them matches), +word (must), -word (must not), prefix* and "phrases". Tokens are runs of letters and digits,
lower-cased. Without an index the literals are scanned; ``build_index`` makes a table of (token, s, p) that answers word queries by joins.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import BGP, IRI, Literal, Triple, Var
from ..terms import Value, lexical, term_lex
from .relation import Relation, build, q

SEARCH = "urn:quillstone:search:"
TOKENS = r"[^\p{L}\p{N}]+"
WORD = r"[^\W_]+"  # a token in Python's terms


def parse_query(text: str) -> list[tuple[str, str, str]]:
    """(occurrence: + - or empty, kind: word, prefix or phrase, text) of each clause."""
    out = []
    for m in re.finditer(r'([+-]?)(?:"([^"]*)"|(\S+))', text):
        if m[2] is not None:
            out.append((m[1], "phrase", " ".join(re.findall(WORD, m[2].lower()))))
        elif m[3] in ("AND", "OR"):
            if m[3] == "AND" and out:
                out[-1] = ("+", *out[-1][1:])
                out.append(("&", "", ""))
        else:
            word = m[3].lower()
            kind = "prefix" if word.endswith("*") else "word"
            words = re.findall(WORD, word)
            for w in [" ".join(words)] if kind == "prefix" and words else words:
                out.append((m[1], kind, w))
    done, must = [], False
    for occur, kind, word in out:
        if occur == "&":
            must = True
            continue
        done.append(("+" if must and not occur else occur, kind, word))
        must = False
    return done


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKENS), lambda t: t != "")


def condition(text: Column, query: str) -> Column:
    """Whether a text matches a query."""
    found = tokens(text)
    spaced = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))

    def clause(kind: str, word: str) -> Column:
        if kind == "word":
            return F.array_contains(found, word)
        return F.contains(spaced, F.lit(f" {word}" + (" " if kind == "phrase" else "")))

    clauses = parse_query(query)
    must = [clause(k, w) for o, k, w in clauses if o == "+"] + [~clause(k, w) for o, k, w in clauses if o == "-"]
    may = [clause(k, w) for o, k, w in clauses if o == ""]
    if not any(o == "+" for o, _, _ in clauses) and may:
        must.append(reduce(lambda a, b: a | b, may))
    return reduce(lambda a, b: a & b, must) if must else F.lit(False)


def build_index(triples: DataFrame, properties: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(token, s, p) of literals, distinct; only the named properties and languages."""
    df = triples.filter(F.col("o").startswith("L"))
    if properties:
        df = df.filter(F.col("p").isin(["I" + p for p in properties]))
    if languages:
        df = df.filter(F.substring_index(F.substring("o", 3, 1 << 30), "\x1f", 1).isin(languages) & F.col("o").startswith("L@"))
    return df.select("s", "p", F.explode(F.array_distinct(tokens(term_lex(F.col("o"))))).alias("token")).distinct()


def search_relation(low: Any, triples: list[Triple], graph: Any) -> list[Relation]:
    """The subjects of full-text patterns."""
    out = []
    for t in triples:
        if t.p.value != SEARCH + "matches":
            continue
        spec: dict[str, Any] = {x.p.value[len(SEARCH) :]: x.o for x in triples if x.s == t.o}
        query = spec.get("query")
        if not isinstance(query, Literal):
            raise ValueError("a full-text pattern needs a constant search:query")
        v = low.new()
        prop = spec.get("property")
        p = prop if isinstance(prop, IRI) else Var(low.new())
        subject = t.s
        index = low.options.get("indexes", {}).get(getattr(spec.get("indexid"), "value", ""))
        clauses = parse_query(query.lex)
        if index is not None and clauses and all(k == "word" and o == "" for o, k, _ in clauses):
            hits = index.filter(F.col("token").isin([w for _, _, w in clauses]))
            if isinstance(prop, IRI):
                hits = hits.filter(F.col("p") == F.lit("I" + prop.value))
            r = build(hits.select("s").distinct(), {subject.name: Value(q("s"), "term")}, {subject.name})
        else:
            r = low.bgp(BGP([Triple(subject, p, Var(v))]), graph)
            value = r.value(v)
            text = lexical(value) if value.kind != "term" else F.when(value.col.startswith("L"), term_lex(value.col))
            r = Relation(r.df.filter(condition(text, query.lex)), r.kinds, r.sure)
            r = low.algebra.distinct(low.algebra.project(r, [x for x in r.kinds if x != v and not x.startswith("_h")]))
        out.append(r)
    return out
