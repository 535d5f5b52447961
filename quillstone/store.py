"""A store of quads on Parquet: a base, additions and tombstones, with versions.

Every commit writes its additions and its tombstones as new files and then one manifest, whose name is the version: the file that appears is
the commit, so readers see a whole version or the one before. A row is alive if no tombstone of its quad is younger, which is one anti join.
``merge`` rewrites what is alive as a new base; it can be repeated after a crash, as it changes nothing before its manifest appears.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, instantiate
from .operators.lower import Lowering
from .operators.materialize import materialized
from .plans import algebra as A
from .plans.parser import parse_update
from .plans.rewrite import rewrite
from .sources.graphs import QuadGraph
from .sources.rdf import QUADS, read_rdf, write_ntriples
from .terms import encode

KEY = ["s", "p", "o", "g"]


class Store:
    """``threshold``: additions and tombstones from which a commit merges (0: never)."""

    def __init__(self, spark: SparkSession, path: str, threshold: int = 1_000_000, **engine: Any):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.engine_options = engine
        self.listeners: list[Callable[[DataFrame, DataFrame], None]] = []
        self.staged: tuple[DataFrame, DataFrame] | None = None  # (adds, dels) of the open transaction
        self.open = False
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.version() is None:
            self._publish(0, {"base": [], "adds": [], "dels": [], "changes": 0})

    # versions
    def version(self) -> int | None:
        at = self._path(f"{self.path}/manifests")
        if not self.fs.exists(at):
            return None
        found = [int(f.getPath().getName().split(".")[0]) for f in self.fs.listStatus(at) if f.getPath().getName().endswith(".json")]
        return max(found) if found else None

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{v:012d}.json", wholetext=True).collect())
        return json.loads(text) | {"version": v}

    def _publish(self, version: int, content: dict) -> None:
        """Fails if another writer has made this version."""
        target = self._path(f"{self.path}/manifests/{version:012d}.json")
        temp = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(temp, target):
            self.fs.delete(temp, False)
            raise RuntimeError(f"version {version} was written by another transaction")

    # reading
    def _frames(self, paths: list) -> DataFrame:
        out = self.spark.createDataFrame([], QUADS + ", v long")
        for v, p in paths:
            out = out.unionByName(self.spark.read.schema(QUADS).parquet(p).withColumn("v", F.lit(v).cast("long")))
        return out

    def raw(self, version: int | None = None) -> DataFrame:
        """Alive quads of a version; the default graph is the empty name."""
        m = self.manifest(version)
        adds = self._frames(m["base"] + m["adds"])
        if m["dels"]:
            dels = self._frames(m["dels"]).groupBy(*KEY).agg(F.max("v").alias("gone"))
            adds = adds.join(dels, [*(adds[k] == dels[k] for k in KEY), dels["gone"] > adds["v"]], "left_anti")
        return adds.select(*KEY)

    def current(self) -> DataFrame:
        df = self.raw()
        if self.staged:
            adds, dels = self.staged
            df = df.join(dels, KEY, "left_anti").unionByName(adds)
        return df

    def quads(self, version: int | None = None) -> DataFrame:
        df = self.current() if version is None else self.raw(version)
        return df.withColumn("g", F.when(F.col("g") != "", F.col("g")))

    def engine(self, **options: Any) -> Engine:
        return Engine(self.spark, QuadGraph(self.spark, self.quads()), **(self.engine_options | options))

    def size(self) -> int:
        return self.current().count()

    # transactions
    def begin(self) -> None:
        self.open = True

    def rollback(self) -> None:
        self.staged, self.open = None, False

    def commit(self) -> None:
        staged, self.staged, self.open = self.staged, None, False
        if staged is None:
            return
        adds, dels = staged
        m = self.manifest()
        v = m["version"] + 1
        paths = {"adds": f"{self.path}/data/{v:012d}-add-{uuid.uuid4().hex}", "dels": f"{self.path}/data/{v:012d}-del-{uuid.uuid4().hex}"}
        # a quad added again after a tombstone of the same transaction is younger than it
        n_adds, n_dels = self._write(adds, paths["adds"]), self._write(dels, paths["dels"])
        content = {"base": m["base"], "adds": m["adds"] + ([[2 * v + 1, paths["adds"]]] if n_adds else []), "dels": m["dels"] + ([[2 * v, paths["dels"]]] if n_dels else []), "changes": m["changes"] + n_adds + n_dels}
        self._publish(v, content)
        for listener in self.listeners:
            listener(self.spark.read.schema(QUADS).parquet(paths["adds"]), self.spark.read.schema(QUADS).parquet(paths["dels"]))
        if 0 < self.threshold <= content["changes"]:
            self.merge()

    def _write(self, df: DataFrame, path: str) -> int:
        df.select(*KEY).write.parquet(path)
        return self.spark.read.schema(QUADS).parquet(path).count()

    def change(self, adds: DataFrame | None = None, dels: DataFrame | None = None) -> None:
        """Stages deletions, then additions of quads (g null: the default graph); commits unless a transaction is open."""
        blank = self.spark.createDataFrame([], QUADS)
        plain = lambda df: (df if df is not None else blank).select("s", "p", "o", F.coalesce("g", F.lit("")).alias("g")).distinct()
        now = self.current()
        dels_ = plain(dels).join(now, KEY, "left_semi")
        adds_ = plain(adds)
        # what is there and stays is no addition
        adds_ = adds_.join(now.join(dels_, KEY, "left_anti"), KEY, "left_anti") if adds is not None else blank
        adds_, dels_ = materialized(adds_), materialized(dels_)
        if self.staged:
            before_adds, before_dels = self.staged
            adds_, dels_ = materialized(before_adds.join(dels_, KEY, "left_anti").unionByName(adds_)), materialized(before_dels.unionByName(dels_).distinct())
        self.staged = (adds_, dels_)
        if not self.open:
            self.commit()

    def add(self, quads: DataFrame) -> None:
        self.change(adds=quads)

    def remove(self, quads: DataFrame) -> None:
        self.change(dels=quads)

    def load(self, path: str | list[str], kind: str | None = None, graph: str | None = None, replace: bool = False) -> None:
        df = read_rdf(self.spark, path, kind)
        if graph:
            df = df.withColumn("g", F.lit("I" + graph))
        self.change(adds=df, dels=self.quads() if replace else None)

    def merge(self) -> None:
        """A new base of what is alive."""
        m = self.manifest()
        v = m["version"] + 1
        path = f"{self.path}/data/{v:012d}-base-{uuid.uuid4().hex}"
        self.raw(m["version"]).repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.parquet(path)
        self._publish(v, {"base": [[2 * v, path]], "adds": [], "dels": [], "changes": 0})

    def vacuum(self) -> None:
        """Deletes files that the current version doesn't use."""
        m = self.manifest()
        used = {p.rsplit("/", 1)[-1] for _, p in m["base"] + m["adds"] + m["dels"]}
        at = self._path(f"{self.path}/data")
        for f in self.fs.listStatus(at) if self.fs.exists(at) else []:
            if f.getPath().getName() not in used:
                self.fs.delete(f.getPath(), True)

    def dump(self, path: str, kind: str = "parquet") -> None:
        """The alive quads, merged, as one dataset."""
        if kind == "ntriples":
            write_ntriples(self.quads(), path)
        else:
            self.quads().write.parquet(path)

    # updates
    def update(self, text: str) -> None:
        """Runs the operations of an update request in order, each in its own version, or all in the open transaction."""
        for u in parse_update(text, Engine(self.spark, QuadGraph(self.spark, self.quads()), **self.engine_options).prefixes):
            self._apply(u)

    def _ground(self, quads: list) -> DataFrame:
        labels: dict[str, str] = {}

        def cell(x: Any) -> str | None:
            return None if x is None else "B" + labels.setdefault(x.name, uuid.uuid4().hex) if isinstance(x, A.Var) else encode(x)

        return self.spark.createDataFrame([(cell(t.s), cell(t.p), cell(t.o), cell(g)) for t, g in quads], QUADS)

    def _of(self, target: str) -> DataFrame:
        df = self.quads()
        return {"ALL": df, "DEFAULT": df.filter("g is null"), "NAMED": df.filter("g is not null")}.get(target, df.filter(F.col("g") == F.lit("I" + target)))

    def _known(self, target: str) -> None:
        if target not in ("ALL", "DEFAULT", "NAMED") and self._of(target).isEmpty():
            raise LookupError(f"no graph {target}")

    def _apply(self, u: A.Update) -> None:
        a = u.args
        if u.kind == "INSERT DATA":
            return self.change(adds=self._ground(a["quads"]))
        if u.kind == "DELETE DATA":
            return self.change(dels=self._ground(a["quads"]))
        if u.kind == "MODIFY":
            return self._modify(a)
        if u.kind in ("CLEAR", "DROP"):
            if u.kind == "DROP" and not a["silent"]:
                self._known(a["target"])
            return self.change(dels=self._of(a["target"]))
        if u.kind == "CREATE":  # a graph is there when it has quads
            if not a["silent"] and not self._of(a["target"]).isEmpty():
                raise LookupError(f"graph {a['target']} exists")
            return None
        if u.kind == "LOAD":
            try:
                return self.load(a["source"], graph=a["target"])
            except Exception:
                if a["silent"]:
                    return None
                raise
        if not a["silent"]:
            self._known(a["source"])
        if a["source"] == a["target"]:
            return None
        moved = self._of(a["source"]).withColumn("g", F.lit(None if a["target"] == "DEFAULT" else "I" + a["target"]).cast("string"))
        dels = None
        if u.kind in ("COPY", "MOVE"):
            dels = self._of(a["target"])
            if u.kind == "MOVE":
                dels = dels.unionByName(self._of(a["source"]))
        return self.change(adds=materialized(moved), dels=dels)

    def _modify(self, a: dict) -> None:
        engine = self.engine()
        using, named = a["using"], a["using_named"]
        default = using or ([a["with"]] if a["with"] and not named else [])
        low = Lowering(self.spark, engine.source, default_graphs=default, named_graphs=named if (using or named) else None, options=engine.options)
        r = low(rewrite(a["where"]))
        # the pattern is evaluated once, before anything changes
        r.df = materialized(r.df if r.df.columns else r.df.select(F.lit(1).alias("__one")))
        home = A.IRI(a["with"]) if a["with"] else None
        make = lambda quads: instantiate(engine, r, [(t, g if g is not None else home) for t, g in quads])
        self.change(adds=make(a["insert"]) if a["insert"] else None, dels=make(a["delete"]) if a["delete"] else None)


# whole datasets


def cat(*datasets: DataFrame) -> DataFrame:
    """The union of quad sets."""
    out = datasets[0]
    for d in datasets[1:]:
        out = out.unionByName(d)
    return out.distinct()


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The quads of ``a`` that ``b`` doesn't have."""
    return a.join(b.select(*(F.col(c).alias(f"_{c}") for c in a.columns)), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in a.columns], "left_anti")


def diff_cat(a: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    return cat(diff(a, removed), added)


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two datasets hold the same quads."""
    return diff(a, b).isEmpty() and diff(b, a).isEmpty()


def statistics(quads: DataFrame) -> DataFrame:
    """Counts of a dataset: triples, distinct subjects, predicates, objects, graphs."""
    return quads.agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"), F.count_distinct("g").alias("graphs"))
