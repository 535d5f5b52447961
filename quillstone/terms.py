"""RDF terms in columns.

A variable's column is either native (its kind is known when the plan is made: bigint, double, timestamp, string, ...) or a *term*: one
string that carries everything and whose equality is sameTerm,

    I<iri>          B<blank node label>          L<tag>\\x1f<lexical form>      with tag = datatype IRI, xsd:name, or @language

so patterns join on one plain column in either case. Kinds: iri, bnode, string, lang (with a second column for the tag), integer,
decimal, float, double, boolean, dateTime, date, term, and ref:<class> for the key of a mapped table's row, whose IRI is only spelled out
where it is looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plans.algebra import IRI, RDF, XSD, Literal

SEP = "\x1f"
NUMERIC = ("integer", "decimal", "float", "double")
DERIVED_INTEGERS = (
    "integer", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte", "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
)
DECIMAL = "decimal(38,18)"
SQL_TYPES = {"iri": "string", "bnode": "string", "string": "string", "lang": "string", "integer": "bigint", "decimal": DECIMAL, "float": "float", "double": "double", "boolean": "boolean", "dateTime": "timestamp", "date": "date", "term": "string"}


@dataclass(frozen=True)
class Value:
    """A column with its kind; ``lang`` is the tag column of kind lang; ``constant`` the term it stands for, if it is one."""

    col: Column
    kind: str
    lang: Column | None = None
    constant: object = None


def tag(datatype: str) -> str:
    return "xsd:" + datatype[len(XSD) :] if datatype.startswith(XSD) else datatype


def encode(t: IRI | Literal) -> str:
    if isinstance(t, IRI):
        return "I" + t.value
    return "L" + ("@" + t.lang if t.lang else tag(t.datatype)) + SEP + t.lex


def decode(s: str | None) -> object:
    """A Python view of an encoded term: IRI, Literal, or the string of a blank node."""
    if s is None:
        return None
    if s[0] == "I":
        return IRI(s[1:])
    if s[0] == "B":
        return "_:" + s[1:]
    t, _, lex = s[1:].partition(SEP)
    if t.startswith("@"):
        return Literal(lex, RDF + "langString", t[1:])
    return Literal(lex, XSD + t[4:] if t.startswith("xsd:") else t)


def constant(t: IRI | Literal) -> Value:
    """A constant in its native kind, where its lexical form is canonical enough to be native; else a term."""
    if isinstance(t, IRI):
        return Value(F.lit(t.value), "iri", constant=t)
    if t.lang:
        return Value(F.lit(t.lex), "lang", F.lit(t.lang), t)
    name = t.datatype[len(XSD) :] if t.datatype.startswith(XSD) else ""
    try:
        if name == "string":
            return Value(F.lit(t.lex), "string", constant=t)
        if name == "integer":
            if -(1 << 63) <= int(t.lex) < 1 << 63:
                return Value(F.lit(int(t.lex)).cast("bigint"), "integer", constant=t)
        if name == "decimal":
            return Value(F.lit(t.lex).cast(DECIMAL), "decimal", constant=t) if t.lex.replace(".", "").lstrip("+-").isdigit() else Value(F.lit(encode(t)), "term", constant=t)
        if name == "double":
            return Value(F.lit(float(t.lex)), "double", constant=t)
        if name == "boolean" and t.lex in ("true", "false", "1", "0"):
            return Value(F.lit(t.lex in ("true", "1")), "boolean", constant=t)
        if name == "dateTime":
            if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?", t.lex):  # without a zone, as columns without one
                return Value(F.expr(f"TIMESTAMP_NTZ '{t.lex}'"), "dateTime", constant=t)
            return Value(F.try_to_timestamp(F.lit(t.lex)), "dateTime", constant=t)
        if name == "date" and re.fullmatch(r"\d{4}-\d\d-\d\d", t.lex):  # a zone needs the whole form
            return Value(F.lit(t.lex).try_cast("date"), "date", constant=t)
    except ValueError:
        pass
    return Value(F.lit(encode(t)), "term", constant=t)


def null(kind: str = "term") -> Value:
    return Value(F.lit(None).cast(SQL_TYPES.get(kind, "string")), kind)


# parts of encoded terms


def term_lex(c: Column) -> Column:
    """STR of a term: the IRI or the lexical form; null for blank nodes."""
    return F.when(c.startswith("I"), F.substring(c, 2, 1 << 30)).when(c.startswith("L"), F.substring(c, F.instr(c, SEP) + 1, F.lit(1 << 30)))


def term_tag(c: Column) -> Column:
    return F.when(c.startswith("L"), F.substring_index(F.substring(c, 2, 1 << 30), SEP, 1))


def is_integer_tag(t: Column) -> Column:
    return t.isin(["xsd:" + n for n in DERIVED_INTEGERS])


def is_numeric_tag(t: Column) -> Column:
    return t.isin(["xsd:" + n for n in (*DERIVED_INTEGERS, "decimal", "float", "double")])


def rank(t: Column) -> Column:
    """Promotion order of a term's datatype: integer 1, decimal 2, float 3, double 4; null if not numeric."""
    return F.when(is_integer_tag(t), 1).when(t == "xsd:decimal", 2).when(t == "xsd:float", 3).when(t == "xsd:double", 4)


def xsd_double(lex: Column) -> Column:
    """A double from its XSD form: INF and NaN as XSD spells them, and no Java suffixes."""
    return F.when(lex == "INF", F.lit(float("inf"))).when(lex == "-INF", F.lit(float("-inf"))).when(lex == "NaN", F.lit(float("nan"))).when(F.regexp_like(lex, F.lit(r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")), F.trim(lex).try_cast("double"))


def term_double(c: Column) -> Column:
    return F.when(rank(term_tag(c)).isNotNull(), xsd_double(term_lex(c)))


def term_decimal(c: Column) -> Column:
    return F.when(rank(term_tag(c)) <= 2, F.trim(term_lex(c)).try_cast(DECIMAL))


# canonical lexical forms


def plain_decimal(c: Column) -> Column:
    """Decimal digits without trailing zeros."""
    s = c.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def double_lex(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").otherwise(s)


def stamp_lex(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, micro)


def lexical(v: Value) -> Column:
    """STR() of a value."""
    if v.constant is not None:
        return F.lit(v.constant.value if isinstance(v.constant, IRI) else v.constant.lex)
    if v.kind == "term":
        return term_lex(v.col)
    if v.kind == "bnode":
        return F.lit(None).cast("string")
    return {"integer": lambda c: c.cast("string"), "boolean": lambda c: c.cast("string"), "decimal": plain_decimal, "float": double_lex, "double": double_lex, "dateTime": stamp_lex, "date": lambda c: c.cast("string")}.get(v.kind, lambda c: c)(v.col)


def to_term(v: Value) -> Column:
    if v.constant is not None:
        return F.lit(encode(v.constant))
    if v.kind == "term":
        return v.col
    if v.kind in ("iri", "bnode"):
        return F.concat(F.lit("I" if v.kind == "iri" else "B"), v.col)
    if v.kind == "lang":
        return F.concat(F.lit("L@"), F.lower(v.lang), F.lit(SEP), v.col)
    return F.concat(F.lit(f"Lxsd:{v.kind}{SEP}"), lexical(v))


def order_key(v: Value) -> Column:
    """A sortable key: unbound, blank nodes, IRIs, literals; numbers by value, others by lexical form."""
    if v.kind != "term":
        return v.col
    c = v.col
    t = term_tag(c)
    kind = F.when(c.isNull(), 0).when(c.startswith("B"), 1).when(c.startswith("I"), 2).when(rank(t).isNotNull(), 3).when(t == "xsd:dateTime", 4).otherwise(5)
    return F.struct(kind.alias("k"), term_double(c).alias("n"), F.when(t == "xsd:dateTime", F.try_to_timestamp(term_lex(c))).alias("t"), F.coalesce(term_lex(c), c).alias("s"), t.alias("d"))


def from_numeric(best: Column, dec: Column, dbl: Column) -> Column:
    """A numeric term of promotion rank ``best`` from its decimal or double value."""
    whole = F.when(dec == F.floor(dec), plain_decimal(dec))
    return (
        F.when(best == 1, F.concat(F.lit("Lxsd:integer" + SEP), whole))
        .when(best == 2, F.concat(F.lit("Lxsd:decimal" + SEP), plain_decimal(dec)))
        .when(best == 3, F.concat(F.lit("Lxsd:float" + SEP), double_lex(dbl.cast("float"))))
        .when(best == 4, F.concat(F.lit("Lxsd:double" + SEP), double_lex(dbl)))
    )
