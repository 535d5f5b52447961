"""Extension functions by IRI: scalar ones (compiler, values -> value), tuple ones (row generators), aggregates and services (DataFrame -> DataFrame)."""

from __future__ import annotations

from typing import Any

SCALAR: dict[str, Any] = {}
TUPLE: dict[str, Any] = {}
SERVICE: dict[str, Any] = {}
AGGREGATE: dict[str, Any] = {}


def scalar(iri: str):
    """Registers a scalar function: it gets the compiler and its arguments' values, and returns a value; an error is null."""

    def put(f):
        SCALAR[iri] = f
        return f

    return put


def tuple_function(iri: str):
    """Registers a row-generating function: it gets the compiler and values, and returns an array column of result rows."""

    def put(f):
        TUPLE[iri] = f
        return f

    return put


def aggregate(iri: str):
    """Registers an aggregate, called by its IRI in a grouped query: it gets the compiler, the value of its argument and whether DISTINCT was
    given, and returns a value whose column is an aggregate (of Spark's own functions or a grouped pandas UDF)."""

    def put(f):
        AGGREGATE[iri] = f
        return f

    return put


def service(iri: str):
    """Registers a service: it gets (lowering, service node, input relation) and returns a relation."""

    def put(f):
        SERVICE[iri] = f
        return f

    return put
