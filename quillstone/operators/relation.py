"""Solutions as DataFrames: a column per variable with a known kind, null where a variable is unbound."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..terms import SQL_TYPES, Value, null, to_term

LANG = "__lang"
_numbers = itertools.count()


def q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Relation:
    df: DataFrame
    kinds: dict[str, str]
    sure: set[str] = field(default_factory=set)
    unit: bool = False  # the one empty solution

    def value(self, v: str) -> Value:
        return Value(q(v), self.kinds[v], q(v + LANG) if self.kinds[v] == "lang" else None)

    def scope(self) -> dict[str, Value]:
        return {v: self.value(v) for v in self.kinds}


def columns(name: str, v: Value) -> list[Column]:
    return [v.col.alias(name)] + ([v.lang.alias(name + LANG)] if v.kind == "lang" else [])


def build(df: DataFrame, values: dict[str, Value], sure: set[str]) -> Relation:
    return Relation(df.select(*(c for n, v in values.items() for c in columns(n, v))), {n: v.kind for n, v in values.items()}, sure)


class Algebra:
    """Joins, unions and differences of relations. ``refs`` names the IRI prefix of each mapped class."""

    def __init__(self, refs: dict[str, str]):
        self.refs = refs

    def plain(self, v: Value) -> Value:
        return Value(F.concat(F.lit(self.refs[v.kind[4:]]), v.col.cast("string")), "iri") if v.kind.startswith("ref:") else v

    def term(self, v: Value) -> Column:
        return to_term(self.plain(v))

    def same(self, a: Value, b: Value) -> Column:
        """sameTerm as a join condition that stays an equality of columns wherever the kinds allow."""
        if a.kind == b.kind:
            return (a.col == b.col) & (F.lower(a.lang) == F.lower(b.lang)) if a.kind == "lang" else a.col == b.col
        for x, y in ((a, b), (b, a)):
            if x.kind.startswith("ref:") and y.kind == "iri":
                prefix = self.refs[x.kind[4:]]
                return x.col.cast("string") == F.when(y.col.startswith(prefix), F.substring(y.col, len(prefix) + 1, 1 << 30))
        if "term" in (a.kind, b.kind):
            return self.term(a) == self.term(b)
        return F.lit(False)

    def common(self, a: Value, b: Value) -> tuple[Value, Value]:
        """Both values in one kind."""
        if a.kind == b.kind:
            return a, b
        a, b = self.plain(a), self.plain(b)
        return (a, b) if a.kind == b.kind else (Value(to_term(a), "term"), Value(to_term(b), "term"))

    def _aside(self, r: Relation, names: set[str]) -> tuple[Relation, dict[str, str]]:
        """``r`` with the named variables under fresh names."""
        fresh = {v: f"__{v}_{next(_numbers)}" for v in sorted(names)}
        out = {fresh.get(v, v): r.value(v) for v in r.kinds}
        return build(r.df, out, {fresh.get(v, v) for v in r.sure}), fresh

    def compatible(self, left: Relation, right: Relation, fresh: dict[str, str]) -> Column:
        parts = []
        for v, w in fresh.items():
            a, b = left.value(v), right.value(w)
            same = self.same(a, b)
            if v not in left.sure:
                same = same | a.col.isNull()
            if w not in right.sure:
                same = same | b.col.isNull()
            parts.append(same)
        return reduce(lambda x, y: x & y, parts) if parts else F.lit(True)

    def join(self, left: Relation, right: Relation) -> Relation:
        if left.unit:
            return right
        if right.unit:
            return left
        shared = left.kinds.keys() & right.kinds.keys()
        for a, b in ((left, right), (right, left)):
            # a variable that one side may leave unbound: split it there, so that both halves are plain equi-joins
            open_ = sorted(v for v in shared if v not in a.sure)
            if open_ and len(open_) <= 3:
                v = open_[0]
                bound = Relation(a.df.filter(q(v).isNotNull()), a.kinds, a.sure | {v})
                free = {w: x for w, x in a.scope().items() if w != v}
                unbound = build(a.df.filter(q(v).isNull()), free, a.sure - {v})
                if not free:
                    unbound = Relation(a.df.filter(q(v).isNull()).select(F.lit(1).alias("__one")), {}, set())
                return self.union(self.join(bound, b), self.join(unbound, b))
        aside, fresh = self._aside(right, set(shared))
        if not shared:
            out = left.df.crossJoin(aside.df)
        else:
            out = left.df.join(aside.df, self.compatible(left, aside, fresh), "inner")
        values = left.scope() | {v: x for v, x in aside.scope().items() if v not in fresh.values()}
        for v, w in fresh.items():
            if v not in left.sure:
                a, b = self.common(left.value(v), aside.value(w))
                values[v] = Value(F.coalesce(a.col, b.col), a.kind, F.coalesce(a.lang, b.lang) if a.kind == "lang" else None)
            elif left.kinds[v] == "term" and aside.kinds[w] != "term":
                values[v] = aside.value(w) if w in aside.sure else left.value(v)
        return build(out, values, left.sure | right.sure)

    def left_join(self, left: Relation, right: Relation, condition=None) -> Relation:
        """``condition`` gets the scope of both sides and gives a column."""
        if right.unit:
            return left
        shared = set(left.kinds) & set(right.kinds)
        aside, fresh = self._aside(right, shared)
        on = self.compatible(left, aside, fresh)
        merged = left.scope() | {v: x for v, x in aside.scope().items() if v not in fresh.values()}
        open_ = {v for v in shared if v not in left.sure}
        for v in open_:
            a, b = self.common(left.value(v), aside.value(fresh[v]))
            merged[v] = Value(F.coalesce(a.col, b.col), a.kind, F.coalesce(a.lang, b.lang) if a.kind == "lang" else None)
        if condition is not None:
            on = on & condition(merged)
        df = left.df if not left.unit else left.df.select(F.lit(1).alias("__one"))
        return build(df.join(aside.df, on, "left"), merged, set(left.sure))

    def semi(self, left: Relation, right: Relation, negated: bool, condition=None) -> Relation:
        """Solutions of ``left`` with (or without) a compatible one in ``right``."""
        shared = set(left.kinds) & set(right.kinds)
        aside, fresh = self._aside(right, set(right.kinds))
        fresh_shared = {v: fresh[v] for v in shared}
        on = self.compatible(left, aside, fresh_shared)
        if condition is not None:
            inner = {v: aside.value(w) for v, w in fresh.items()}
            on = on & condition(inner | left.scope())
            keep = aside.df
        else:
            keep = aside.df.select(*(q(c) for c in aside.df.columns if any(c in (w, w + LANG) for w in fresh_shared.values())))
            if not fresh_shared:
                keep = aside.df.select(F.lit(1).alias("__some")).limit(1)
        df = left.df if not left.unit else left.df.select(F.lit(1).alias("__one"))
        return Relation(df.join(keep, on, "left_anti" if negated else "left_semi"), dict(left.kinds), set(left.sure), left.unit)

    def minus(self, left: Relation, right: Relation) -> Relation:
        shared = set(left.kinds) & set(right.kinds)
        if not shared:
            return left
        aside, fresh = self._aside(build(right.df, {v: right.value(v) for v in sorted(shared)}, right.sure & shared), shared)
        on = self.compatible(left, aside, fresh)
        if not any(v in left.sure and w in aside.sure for v, w in fresh.items()):
            on = on & reduce(lambda x, y: x | y, (q(v).isNotNull() & q(w).isNotNull() for v, w in fresh.items()))
        return Relation(left.df.join(aside.df, on, "left_anti"), dict(left.kinds), set(left.sure))

    def union(self, left: Relation, right: Relation) -> Relation:
        names = list(dict.fromkeys([*left.kinds, *right.kinds]))
        a, b = {}, {}
        for v in names:
            x, y = (r.value(v) if v in r.kinds else None for r in (left, right))
            kind = (x or y).kind
            missing = Value(F.lit(None).cast(self.type_of(left if x else right, v)), kind, F.lit(None).cast("string") if kind == "lang" else None)
            a[v], b[v] = self.common(x or missing, y or missing)
        if not names:
            one = lambda r: r.df.select(F.lit(1).alias("__one"))
            return Relation(one(left).unionAll(one(right)), {}, set())
        l, r = build(left.df, a, set()), build(right.df, b, set())
        return Relation(l.df.unionByName(r.df), l.kinds, left.sure & right.sure)

    @staticmethod
    def type_of(r: Relation, v: str) -> str:
        return r.df.schema[v].dataType.simpleString()

    def project(self, r: Relation, names: list[str]) -> Relation:
        if not names:
            return Relation(r.df.select(F.lit(1).alias("__one")), {}, set())
        return build(r.df, {v: r.value(v) if v in r.kinds else null() for v in names}, r.sure & set(names))

    def distinct(self, r: Relation) -> Relation:
        return Relation(r.df.distinct(), dict(r.kinds), set(r.sure), r.unit)


def empty(spark, kinds: dict[str, str], types: dict[str, str] | None = None) -> Relation:
    df = spark.range(0).select(*(F.lit(None).cast((types or {}).get(v) or SQL_TYPES.get(k, "bigint")).alias(v) for v, k in kinds.items()), F.lit(1).alias("__one"))
    for v, k in kinds.items():
        if k == "lang":
            df = df.withColumn(v + LANG, F.lit(None).cast("string"))
    return Relation(df, dict(kinds), set(kinds))
