"""The SPARQL 1.1 function library. Each entry gets the compiler and the argument expressions."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urljoin

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import IRI, XSD
from ..terms import DECIMAL, NUMERIC, SEP, Value, is_integer_tag, is_numeric_tag, lexical, null, term_lex, term_tag, to_term
from .expressions import LANG_STRING, Compiler, boolean, string, typed

BUILTINS: dict = {}
STAMP = r"^(-?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$"


def builtin(*names: str):
    def put(f):
        BUILTINS.update(dict.fromkeys(names, f))
        return f

    return put


def on_values(*names: str):
    """A function of evaluated arguments."""

    def put(f):
        BUILTINS.update(dict.fromkeys(names, lambda c, *args: f(c, *(c.plain(c(a)) for a in args))))
        return f

    return put


# terms


@builtin("BOUND")
def bound(c: Compiler, e):
    return boolean(c(e).col.isNotNull())


@builtin("IF")
def if_(c: Compiler, cond, a, b):
    test = c.truth(cond)
    return c.choose(lambda cols: F.when(test, cols[0]).when(~test, cols[1]), [c.plain(c(a)), c.plain(c(b))])


@builtin("COALESCE")
def coalesce(c: Compiler, *args):
    values = [c.plain(c(a)) for a in args]
    known = [v for v in values if not (v.kind == "term" and v.constant is None and str(v.col._jc) == "NULL")] or values
    return c.choose(lambda cols: F.coalesce(*cols), known)


@builtin("SAMETERM")
def same_term(c: Compiler, a, b):
    return boolean(c.same_term(c(a), c(b)))


@on_values("STR")
def str_(c, v):
    return string(lexical(v))


@on_values("LANG")
def lang(c, v):
    if v.kind == "term":
        t = term_tag(v.col)
        return string(F.when(v.col.startswith("L"), F.when(t.startswith("@"), F.substring(t, 2, 1 << 30)).otherwise(F.lit(""))))
    if v.kind in ("iri", "bnode"):
        return null("string")
    return string(F.when(v.col.isNotNull(), v.lang if v.kind == "lang" else F.lit("")))


@on_values("LANGMATCHES")
def lang_matches(c, tag_, range_):
    t, r = F.lower(lexical(tag_)), F.lower(lexical(range_))
    return boolean(F.when(r == "*", t != "").otherwise((t == r) | F.startswith(t, F.concat(r, F.lit("-")))))


@on_values("DATATYPE")
def datatype(c, v):
    if v.kind == "term":
        t = term_tag(v.col)
        return Value(F.when(t.startswith("@"), LANG_STRING).when(t.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(t, 5, 1 << 30))).otherwise(t), "iri")
    if v.kind in ("iri", "bnode"):
        return null("iri")
    return Value(F.when(v.col.isNotNull(), F.lit(LANG_STRING if v.kind == "lang" else XSD + v.kind)), "iri")


@on_values("IRI", "URI")
def iri(c, v):
    if v.kind == "iri":
        return v
    if v.constant is not None:
        return Value(F.lit(urljoin(c.base, v.constant.lex)), "iri", constant=IRI(urljoin(c.base, v.constant.lex)))
    ok = v.kind in ("string", "term")
    lex = lexical(v) if ok else F.lit(None).cast("string")
    if v.kind == "term":
        lex = F.when(v.col.startswith("I") | (term_tag(v.col) == "xsd:string"), lex)
    if c.base:
        folder = c.base if c.base.endswith(("/", "#")) else c.base.rsplit("/", 1)[0] + "/"
        lex = F.when(F.regexp_like(lex, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), lex).otherwise(F.concat(F.lit(folder), lex))
    return Value(lex, "iri")


@builtin("BNODE")
def bnode(c: Compiler, e=None):
    if e is None:
        return Value(F.uuid(), "bnode")
    scope = [v.col for _, v in sorted(c.scope.items())]
    return Value(F.concat(F.lit("b"), F.sha1(F.concat_ws("|", lexical(c(e)), *(F.coalesce(x.cast("string"), F.lit("")) for x in scope)))), "bnode")


@builtin("STRDT")
def strdt(c: Compiler, e, d):
    v, dt = c(e), c(d)
    if v.kind not in ("string", "term"):
        return null()
    lex = v.col if v.kind == "string" else F.when(term_tag(v.col) == "xsd:string", term_lex(v.col))
    if isinstance(dt.constant, IRI):
        return typed(lex, dt.constant.value)
    name = lexical(dt)
    return typed(lex, F.when(name.startswith(XSD), F.concat(F.lit("xsd:"), F.substring(name, len(XSD) + 1, 1 << 30))).otherwise(name))


@on_values("STRLANG")
def strlang(c, v, l):
    if v.kind == "string":
        return Value(v.col, "lang", F.lower(lexical(l)))
    if v.kind != "term":
        return null()
    return Value(F.concat(F.lit("L@"), F.lower(lexical(l)), F.lit(SEP), F.when(term_tag(v.col) == "xsd:string", term_lex(v.col))), "term")


@builtin("UUID")
def uuid(c: Compiler):
    return Value(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri")


@builtin("STRUUID")
def struuid(c: Compiler):
    return string(F.uuid())


def _kind_test(native: tuple, runtime):
    def test(c, v):
        if v.kind == "term":
            return boolean(runtime(v.col))
        return boolean(F.when(v.col.isNotNull(), F.lit(v.kind in native)))

    return test


on_values("ISIRI", "ISURI")(_kind_test(("iri",), lambda x: x.startswith("I")))
on_values("ISBLANK")(_kind_test(("bnode",), lambda x: x.startswith("B")))
on_values("ISLITERAL")(_kind_test(("string", "lang", "boolean", "dateTime", "date", *NUMERIC), lambda x: x.startswith("L")))


@on_values("ISNUMERIC")
def is_numeric(c, v):
    if v.kind == "term":
        t, lex = term_tag(v.col), term_lex(v.col)
        form = F.when(is_integer_tag(t), F.regexp_like(lex, F.lit(r"^\s*[+-]?[0-9]+\s*$"))).otherwise(F.regexp_like(lex, F.lit(r"^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)\s*$")))
        return boolean(F.when(v.col.isNotNull(), F.coalesce(is_numeric_tag(t) & form, F.lit(False))))
    return boolean(F.when(v.col.isNotNull(), F.lit(v.kind in NUMERIC)))


# strings


@on_values("STRLEN")
def strlen(c, v):
    return Value(F.char_length(c.text(v)[0]).cast("bigint"), "integer")


@on_values("SUBSTR")
def substr(c, v, start, n=None):
    s, at = c.text(v)[0], start.col.cast("int") if start.kind in NUMERIC else lexical(start).try_cast("int")
    many = F.lit(1 << 30) if n is None else (n.col.cast("int") if n.kind in NUMERIC else lexical(n).try_cast("int"))
    # positions before the first character count, as in XPath
    low = F.greatest(at, F.lit(1))
    return c.like(v, F.substring(s, low, F.greatest(F.least(many.cast("bigint") + at - low, F.lit(1 << 30)), F.lit(0)).cast("int")))


@on_values("UCASE")
def ucase(c, v):
    return c.like(v, F.upper(c.text(v)[0]))


@on_values("LCASE")
def lcase(c, v):
    return c.like(v, F.lower(c.text(v)[0]))


def _test(f):
    def run(c, a, b):
        return boolean(F.when(c.compatible(a, b), f(c.text(a)[0], c.text(b)[0])))

    return run


on_values("STRSTARTS")(_test(F.startswith))
on_values("STRENDS")(_test(F.endswith))
on_values("CONTAINS")(_test(F.contains))


def _cut(c, a, b, part):
    s, m = c.text(a)[0], c.text(b)[0]
    at = F.call_function("instr", s, m)
    found = (at > 0) | (m == "")
    ok = c.compatible(a, b)
    cut = part(s, m, at)
    if a.kind == "string":
        return string(F.when(ok, F.when(found, cut).otherwise(F.lit(""))))
    kept = to_term(c.like(a, cut))
    return Value(F.when(ok, F.when(found, kept).otherwise(F.lit(f"Lxsd:string{SEP}"))), "term")


@on_values("STRBEFORE")
def strbefore(c, a, b):
    return _cut(c, a, b, lambda s, m, at: F.substring(s, F.lit(1), F.greatest(at - 1, F.lit(0))))


@on_values("STRAFTER")
def strafter(c, a, b):
    return _cut(c, a, b, lambda s, m, at: F.when(m == "", s).otherwise(F.substring(s, at + F.char_length(m), F.lit(1 << 30))))


@on_values("CONCAT")
def concat(c, *args):
    parts = [c.text(v) for v in args]
    joined = F.concat(*(p for p, _ in parts)) if parts else F.lit("")
    if all(v.kind == "string" for v in args):
        return string(joined)
    first = parts[0][1]
    same = first != ""
    for _, l in parts[1:]:
        same = same & (l == first)
    return Value(F.concat(F.lit("L"), F.when(same, F.concat(F.lit("@"), first)).otherwise("xsd:string"), F.lit(SEP), joined), "term")


@on_values("ENCODE_FOR_URI")
def encode_for_uri(c, v):
    out = F.url_encode(c.text(v)[0])
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return string(out)


@lru_cache(4096)
def groups(pattern: str) -> int:
    """Groups of a pattern; -1 if it is none."""
    try:
        return SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, PySparkException):
        return -1


def _pattern(p: Value, flags: Value | None = None) -> Column:
    """A pattern with its flags; null for a bad one, as every error is."""
    given = "" if flags is None else (flags.constant.lex if flags.constant is not None else "")
    source = lexical(p)
    if "q" not in given and p.constant is None:
        source = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), source)
    elif "q" not in given and groups(p.constant.lex) < 0:
        source = F.lit(None).cast("string")
    if "q" in given:
        source = F.concat(F.lit("\\Q"), F.replace(source, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    mode = "".join(f for f in "imsx" if f in given)
    return F.concat(F.lit(f"(?{mode})"), source) if mode else source


@on_values("REGEX")
def regex(c, v, p, flags=None):
    return boolean(F.regexp_like(c.text(v)[0], _pattern(p, flags)))


@on_values("REPLACE")
def replace(c, v, p, r, flags=None):
    into = lexical(r)
    if r.constant is not None and p.constant is not None and "q" not in (flags.constant.lex if flags is not None and flags.constant is not None else ""):
        n = groups(p.constant.lex)
        # a group that the pattern doesn't have is empty
        into = F.lit(re.sub(r"(?<!\\)\$([0-9])", lambda m: m[0] if int(m[1]) <= n else "", r.constant.lex))
    into = F.when(F.regexp_like(into, F.lit(r"^(?s:[^$\\]|\\.|\$[0-9])*$")), into)
    return c.like(v, F.regexp_replace(c.text(v)[0], _pattern(p, flags), into))


# numbers


@on_values("ABS")
def abs_(c, v):
    return c.numeric(v, lambda x, k: F.abs(x))


@on_values("CEIL")
def ceil(c, v):
    return c.numeric(v, lambda x, k: x if k == "integer" else F.ceil(x).cast({"decimal": DECIMAL}.get(k, k)))


@on_values("FLOOR")
def floor(c, v):
    return c.numeric(v, lambda x, k: x if k == "integer" else F.floor(x).cast({"decimal": DECIMAL}.get(k, k)))


@on_values("ROUND")
def round_(c, v):
    """Halves go up, as in XPath."""
    return c.numeric(v, lambda x, k: x if k == "integer" else F.floor(x + F.lit("0.5").cast(DECIMAL if k == "decimal" else k)).cast({"decimal": DECIMAL}.get(k, k)))


@builtin("RAND")
def rand(c: Compiler):
    return Value(F.rand(), "double")


# times


@builtin("NOW")
def now(c: Compiler):
    return Value(F.current_timestamp(), "dateTime")


def _stamp_part(group: int, native):
    def part(c, v):
        if v.kind in ("dateTime", "date"):
            if v.constant is None:
                return Value(native(v.col).cast("bigint"), "integer")
        return Value(F.nullif(F.regexp_extract(lexical(v), STAMP, group), F.lit("")).try_cast("bigint"), "integer")

    return part


on_values("YEAR")(_stamp_part(1, F.year))
on_values("MONTH")(_stamp_part(2, F.month))
on_values("DAY")(_stamp_part(3, F.day))
on_values("HOURS")(_stamp_part(4, F.hour))
on_values("MINUTES")(_stamp_part(5, F.minute))


@on_values("SECONDS")
def seconds(c, v):
    if v.kind == "dateTime" and v.constant is None:
        return Value(F.extract(F.lit("SECOND"), v.col).cast(DECIMAL), "decimal")
    return Value(F.nullif(F.regexp_extract(lexical(v), STAMP, 6), F.lit("")).try_cast(DECIMAL), "decimal")


@on_values("TZ")
def tz(c, v):
    lex = lexical(v)
    return string(F.when(F.regexp_like(lex, F.lit(STAMP)), F.regexp_extract(lex, STAMP, 7)))


@on_values("TIMEZONE")
def timezone(c, v):
    z = F.nullif(F.regexp_extract(lexical(v), STAMP, 7), F.lit(""))
    hours, minutes = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    sign = F.when(z.startswith("-"), "-").otherwise("")
    body = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
    text = F.when(z.isin("Z", "+00:00", "-00:00"), "PT0S").otherwise(F.concat(sign, F.lit("PT"), body))
    return typed(F.when(z.isNotNull(), text), XSD + "dayTimeDuration")


# hashes


def _hash(f):
    return lambda c, v: string(f(c.text(v)[0] if v.kind != "term" else F.when(term_tag(v.col) == "xsd:string", term_lex(v.col))))


on_values("MD5")(_hash(F.md5))
on_values("SHA1")(_hash(F.sha1))
for _bits in (256, 384, 512):
    on_values(f"SHA{_bits}")(_hash(lambda x, n=_bits: F.sha2(x, n)))

