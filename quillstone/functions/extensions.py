"""Extension functions of the store: logarithm, date formatting, splitting into rows, and geometry. The IRIs are fixed values."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..terms import NUMERIC, Value, lexical, null, term_double
from .builtins import _pattern
from .registry import scalar, tuple_function

FN = "urn:quillstone:fn:"
GEOF = "http://www.opengis.net/def/function/geosparql/"
UOM = "http://www.opengis.net/def/uom/OGC/1.0/"
EARTH_METRES = 6371008.8
POINT = r"(?i)POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)"


def _double(v: Value):
    return v.col.cast("double") if v.kind in NUMERIC else term_double(v.col) if v.kind == "term" else F.lit(None).cast("double")


@scalar(FN + "log")
def log(c, v, base=None):
    """Logarithm of a positive number, to base 10 or a whole base above 1; anything else is an error."""
    x = F.when(_double(v) > 0, _double(v))
    if base is None:
        return Value(F.log10(x), "double")
    b = _double(base)
    b = F.when((b > 0) & (b != 1) & (b == F.floor(b)), b)
    return Value(F.when(b == 10, F.log10(x)).otherwise(F.ln(x) / F.ln(b)), "double")


@lru_cache(4096)
def _date_pattern(text: str) -> bool:
    try:
        SparkSession.active().sql("SELECT date_format(timestamp_seconds(0), :p)", args={"p": text}).collect()  # folded, no job
    except PySparkException:
        return False
    return True


@scalar(FN + "parse_date")
def parse_date(c, v, pattern):
    """A date or time formatted by a constant date pattern; null for a bad one."""
    if pattern.constant is None or not _date_pattern(pattern.constant.lex):
        return null("string")
    stamp = v.col if v.kind in ("dateTime", "date") else F.coalesce(F.try_to_timestamp(lexical(v)), F.substring(lexical(v), 1, 10).try_cast("date").cast("timestamp"))
    return Value(F.date_format(stamp, pattern.constant.lex), "string")


@tuple_function(FN + "split")
def split(c, v, pattern):
    """The parts of a string between matches, as rows; empty parts at the end are left out."""
    parts = F.split(c.text(v)[0], _pattern(pattern))
    # the last part that isn't empty
    keep = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda x: x != ""), True) - 1, F.size(parts).cast("bigint"))
    return F.slice(parts, F.lit(1), keep.cast("int"))


def _point(v: Value):
    lex = lexical(v)
    return F.regexp_extract(lex, POINT, 1).try_cast("double"), F.regexp_extract(lex, POINT, 2).try_cast("double")


@scalar(GEOF + "distance")
def distance(c, a, b, unit=None):
    """Great-circle distance of two points, in metres or the unit named."""
    (x1, y1), (x2, y2) = _point(a), _point(b)
    h = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    angle = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    name = getattr(unit.constant, "value", "") if unit is not None else UOM + "metre"
    scale = {"metre": EARTH_METRES, "meter": EARTH_METRES, "kilometre": EARTH_METRES / 1000, "kilometer": EARTH_METRES / 1000, "radian": 1.0}.get(name[len(UOM) :])
    if name.endswith("degree"):
        return Value(F.degrees(angle), "double")
    return Value(angle * scale, "double") if scale else null("double")


@lru_cache(1024)
def _rings(text: str) -> list[list[tuple[float, float]]] | None:
    """The rings, outer ones and holes, of a polygon or of several; None for anything else."""
    m = re.fullmatch(r"(?is)\s*(?:<[^>]*>\s*)?(?:MULTI)?POLYGON\s*(?:Z|M|ZM)?\s*(\(.*\))\s*", text)
    if not m:
        return None
    try:
        rings = [[(float(x), float(y)) for x, y, *_ in (p.split() for p in r.split(","))] for r in re.findall(r"\(([^()]*)\)", m[1])]
    except ValueError:
        return None
    return rings if rings and all(len(r) > 2 for r in rings) else None


def _inside(polygon: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """Whether a ray from the point crosses an odd number of edges, those of holes included."""

    def test(text, px, py):
        rings = _rings(text) if text is not None else None
        if not rings or px is None or py is None or px != px or py != py:
            return None
        odd = False
        for r in rings:
            for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
                if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                    odd = not odd
        return odd

    return pd.Series([test(*r) for r in zip(polygon, x, y)], dtype=object)


def _contains(c, a, b):
    """Whether a polygon holds a point; the two may come in either order."""
    first = F.regexp_like(lexical(a), F.lit(r"(?i)^\s*(<[^>]*>\s*)?POINT"))
    polygon, point = F.when(first, lexical(b)).otherwise(lexical(a)), Value(F.when(first, lexical(a)).otherwise(lexical(b)), "string")
    x, y = _point(point)
    return Value(F.pandas_udf(_inside, BooleanType())(polygon, x, y), "boolean")


for _name in ("ehContains", "sfContains"):
    scalar(GEOF + _name)(_contains)


@scalar(GEOF + "sfWithin")
def within(c, point, polygon):
    return _contains(c, polygon, point)
