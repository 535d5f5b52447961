"""RDF files as encoded quads (s, p, o, g), g null in the default graph, and back.

N-Triples and N-Quads are split into lines and read by Spark's own functions; only lines with escapes go through Python. Turtle, TriG and
RDF/XML are read a file to a task. Compressed files (gz, bz2, xz, lzma, lz4, zst, and members of zip and tar archives) are opened by their suffix.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import RDF, XSD, Literal, Triple, Var
from ..plans.parser import ParseError, Parser, unescape
from ..terms import SEP, encode

QUADS = "s string, p string, o string, g string"
LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
NOTATIONS = {"nt": "ntriples", "nq": "nquads", "ttl": "turtle", "turtle": "turtle", "n3": "turtle", "trig": "trig", "rdf": "rdfxml", "owl": "rdfxml", "xml": "rdfxml", "parquet": "parquet", "zip": "archive", "tar": "archive", "tgz": "archive"}


def _framed(codec: str):
    return lambda data: pa.CompressedInputStream(pa.BufferReader(data), codec).read()


OPENERS = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".xz": lzma.decompress, ".lzma": lzma.decompress, ".lz4": _framed("lz4"), ".zst": _framed("zstd")}


def notation(path: str) -> str:
    """The notation of a file by its suffix, compression aside."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for end in OPENERS:
        name = name.removesuffix(end)
    return NOTATIONS.get(name.rsplit(".", 1)[-1].rstrip("*"), "ntriples")


def _term(c: Column) -> Column:
    """An N-Triples term without escapes as an encoded term."""
    quote = F.length(c) - F.instr(F.reverse(c), '"') + 1
    lex, rest = F.substring(c, F.lit(2), quote - 2), F.substring(c, quote + 1, F.lit(1 << 30))
    datatype = F.substring(rest, F.lit(4), F.length(rest) - 4)
    tag = F.when(rest == "", "xsd:string").when(rest.startswith("@"), F.lower(rest)).when(datatype.startswith(XSD), F.concat(F.lit("xsd:"), F.substring(datatype, len(XSD) + 1, 1 << 30))).otherwise(datatype)
    return F.when(c.startswith('"'), F.concat(F.lit("L"), tag, F.lit(SEP), lex)).otherwise(_resource(c))


def _resource(c: Column) -> Column:
    return F.when(c.startswith("<"), F.concat(F.lit("I"), F.substring(c, F.lit(2), F.length(c) - 2))).when(c.startswith("_:"), F.concat(F.lit("B"), F.substring(c, 3, 1 << 30)))


def encoded_line(x: Column) -> Column:
    """The terms of a line without escapes, from the array of its parts, as a struct (s, p, o, g)."""
    return F.struct(_resource(F.get(x, 1)).alias("s"), _resource(F.get(x, 2)).alias("p"), _term(F.get(x, 3)).alias("o"), _resource(F.get(x, 4)).alias("g"))


def _python_term(text: str) -> str | None:
    if not text:
        return None
    if text.startswith("<"):
        return "I" + unescape(text[1:-1])
    if text.startswith("_:"):
        return "B" + text[2:]
    end = text.rindex('"')
    rest, lex = text[end + 1 :], unescape(text[1:end])
    return encode(Literal(lex, RDF + "langString", rest[1:].lower()) if rest.startswith("@") else Literal(lex, rest[3:-1] if rest else XSD + "string"))


def _escaped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({c: [_python_term(x) for x in pdf[c]] for c in "spog"}, columns=list("spog"), dtype=object)


def split_line(line: Column) -> Column:
    """The four terms of a line (the last one may be empty) as an array; null for a line that is none."""
    marked = F.regexp_replace(line, LINE, "\x1e$1\x1e$2\x1e$3\x1e$4")
    return F.when(marked.startswith("\x1e"), F.split(marked, "\x1e"))


def read_lines(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """N-Triples or N-Quads. Blank lines and comments are skipped; so are bad lines, unless ``strict``."""
    lines = spark.read.text(path).filter(~F.regexp_like("value", F.lit(r"^\s*(#.*)?$")))
    if strict:
        lines = lines.withColumn("value", F.when(F.regexp_like("value", F.lit(LINE)), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), "value"))))
    parts = lines.select(F.contains("value", F.lit("\\")).alias("escaped"), split_line(F.col("value")).alias("x")).filter("x is not null")
    # the generator keeps later filters from being pushed into, and repeated over, the pattern
    simple = parts.filter("not escaped").select(F.inline(F.array(encoded_line(F.col("x")))))
    return simple.unionByName(parts.filter("escaped").select(*(F.get("x", i + 1).alias(c) for i, c in enumerate("spog"))).mapInPandas(_escaped, QUADS))


def changed_lines(lines: DataFrame) -> DataFrame:
    """(operation, s, p, o, g) of lines: those that open with ``-`` remove, others add."""
    body = F.regexp_replace("value", r"^\s*[+-]\s*", "")
    parts = lines.select(F.when(F.regexp_like("value", F.lit(r"^\s*-")), "remove").otherwise("add").alias("operation"), split_line(body).alias("x")).filter("x is not null")
    return parts.select("operation", F.inline(F.array(encoded_line(F.col("x")))))


def read_changes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The changes in files of lines, as ``streaming.ingest`` takes them from a folder."""
    return changed_lines(spark.read.text(path))


class TurtleParser(Parser):
    """Turtle and TriG on the query parser's terms: triples with their graph."""

    def __init__(self, text: str, base: str = "", file: str = ""):
        super().__init__(text, {}, base)
        self.file = file

    def directive(self) -> bool:
        kind, text = self.peek()
        if kind == "lang" and text in ("@prefix", "@base") or self.at("PREFIX", "BASE"):
            self.i += 1
            if text.lower().endswith("prefix"):
                name = self.next()[1][:-1]
                self.prefixes[name] = urljoin(self.base, self.next()[1][1:-1])
            else:
                self.base = urljoin(self.base, self.next()[1][1:-1])
            self.take(".")
            return True
        return False

    def document(self) -> Iterator[tuple[Triple, object]]:
        while self.peek()[0] != "end":
            if self.directive():
                continue
            graph = None
            if self.take("GRAPH"):
                graph = self.term()
            elif self.peek(1) == ("op", "{") and self.peek()[0] in ("iri", "pname", "bnode"):
                graph = self.term()
            out: list[Triple] = []
            if self.at("{"):
                out = self.template()
                self.take(".")
            else:
                self.triples(out)
                self.need(".")
            yield from ((t, graph) for t in out)

    def quads(self) -> list[tuple]:
        def cell(x):
            return None if x is None else f"B{self.file}{x.name}" if isinstance(x, Var) else encode(x)

        return [(cell(t.s), cell(t.p), cell(t.o), cell(g)) for t, g in self.document()]


def rdfxml(data: bytes, base: str = "", file: str = "") -> list[tuple]:
    """Quads of an RDF/XML document: typed nodes, rdf:about/ID/nodeID, resource, datatype, xml:lang, parseType and property attributes."""
    out: list[tuple] = []
    count = iter(range(1 << 60))
    R, X = "{" + RDF + "}", "{http://www.w3.org/XML/1998/namespace}"
    name = lambda t: t[1:].replace("}", "")

    def node(e: ET.Element, lang: str | None, at: str) -> str:
        at, lang = e.get(X + "base", at), e.get(X + "lang", lang)
        if e.get(R + "about") is not None:
            s = "I" + urljoin(at, e.get(R + "about"))
        elif e.get(R + "ID") is not None:
            s = "I" + urljoin(at, "#" + e.get(R + "ID"))
        else:
            s = f"B{file}" + (e.get(R + "nodeID") or f"x{next(count)}")
        if e.tag != R + "Description":
            out.append((s, "I" + RDF + "type", "I" + name(e.tag), None))
        for k, v in e.attrib.items():
            if not k.startswith((X, R)) and k.startswith("{"):
                out.append((s, "I" + name(k), encode(Literal(v, RDF + "langString", lang.lower()) if lang else Literal(v)), None))
            elif k == R + "type":
                out.append((s, "I" + RDF + "type", "I" + urljoin(at, v), None))
        li = 0
        for p in e:
            inner = p.get(X + "lang", lang)
            pred = name(p.tag)
            if p.tag == R + "li":
                li += 1
                pred = f"{RDF}_{li}"
            kind = p.get(R + "parseType")
            if p.get(R + "resource") is not None:
                o = "I" + urljoin(at, p.get(R + "resource"))
            elif p.get(R + "nodeID") is not None:
                o = f"B{file}{p.get(R + 'nodeID')}"
            elif kind == "Resource":
                o = f"B{file}x{next(count)}"
                holder = ET.Element(R + "Description", {R + "nodeID": o[1 + len(file) :]})
                holder.extend(list(p))
                node(holder, inner, at)
            elif kind == "Collection":
                items = [node(x, inner, at) for x in p]
                o = "I" + RDF + "nil"
                for x in reversed(items):
                    cell = f"B{file}x{next(count)}"
                    out.extend([(cell, "I" + RDF + "first", x, None), (cell, "I" + RDF + "rest", o, None)])
                    o = cell
            elif kind == "Literal":
                o = encode(Literal((p.text or "") + "".join(ET.tostring(x, "unicode") for x in p), RDF + "XMLLiteral"))
            elif len(p):
                o = node(p[0], inner, at)
            elif p.get(R + "datatype"):
                o = encode(Literal(p.text or "", urljoin(at, p.get(R + "datatype"))))
            else:
                o = encode(Literal(p.text or "", RDF + "langString", inner.lower()) if inner else Literal(p.text or ""))
            out.append((s, "I" + pred, o, None))
        return s

    root = ET.fromstring(data)
    for e in root if root.tag == R + "RDF" else [root]:
        node(e, root.get(X + "lang"), root.get(X + "base", base))
    return out


def parse_bytes(data: bytes, path: str, base: str = "") -> list[tuple]:
    """Quads of one file's bytes, by its suffixes."""
    low = path.lower()
    for end, opener in OPENERS.items():
        if low.endswith(end) and not low.endswith(".tar" + end):
            return parse_bytes(opener(data), path[: -len(end)], base)
    if low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [q for n in z.namelist() if not n.endswith("/") for q in parse_bytes(z.read(n), n, base)]
    if ".tar" in low or low.endswith(".tgz"):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [q for m in t.getmembers() if m.isfile() for q in parse_bytes(t.extractfile(m).read(), m.name, base)]
    import hashlib

    file = hashlib.md5(path.encode()).hexdigest()[:8] + "_"
    kind = notation(path)
    if kind == "rdfxml":
        return rdfxml(data, base, file)
    text = data.decode("utf-8")
    if kind in ("ntriples", "nquads"):
        import re

        return [tuple(_python_term(x or "") for x in m.groups()) for m in (re.match(LINE, line) for line in text.splitlines()) if m]
    try:
        return TurtleParser(text, base, file).quads()
    except ParseError as e:
        raise ParseError(f"{path}: {e}") from None


def read_rdf(spark: SparkSession, path: str | list[str], kind: str | None = None, base: str = "") -> DataFrame:
    """Quads of files, folders or globs in any notation known here."""
    kind = kind or notation(path if isinstance(path, str) else path[0])
    packed = [p for p in ([path] if isinstance(path, str) else path) if p.lower().endswith((".xz", ".lzma", ".lz4", ".zst"))]
    if kind in ("ntriples", "nquads") and not packed:  # Spark opens the other suffixes itself
        return read_lines(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    suffix = {"turtle": ".ttl", "trig": ".trig", "rdfxml": ".rdf"}.get(kind, "")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, data in zip(pdf["path"], pdf["content"]):
                name = file if notation(file) != "ntriples" or not suffix else file + suffix
                yield pd.DataFrame(parse_bytes(data, name, base), columns=list("spog"), dtype=object)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, QUADS)


def nt_term(c: Column) -> Column:
    """An encoded term in N-Triples form."""
    lex = F.substring(c, F.instr(c, SEP) + 1, F.lit(1 << 30))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    tag = F.substring_index(F.substring(c, 2, 1 << 30), SEP, 1)
    full = F.when(tag.startswith("xsd:"), F.concat(F.lit(XSD), F.substring(tag, 5, 1 << 30))).otherwise(tag)
    end = F.when(tag == "xsd:string", "").when(tag.startswith("@"), tag).otherwise(F.concat(F.lit("^^<"), full, F.lit(">")))
    return F.when(c.startswith("I"), F.concat(F.lit("<"), F.substring(c, 2, 1 << 30), F.lit(">"))).when(c.startswith("B"), F.concat(F.lit("_:"), F.substring(c, 2, 1 << 30))).when(c.startswith("L"), F.concat(F.lit('"'), lex, F.lit('"'), end))


def nt_lines(df: DataFrame) -> DataFrame:
    cols = [nt_term(F.col(c)) for c in ("s", "p", "o")] + ([nt_term(F.col("g"))] if "g" in df.columns else [])
    return df.select(F.concat(F.concat_ws(" ", *cols), F.lit(" .")).alias("value"))


def write_ntriples(df: DataFrame, path: str, mode: str = "error") -> None:
    """Triples or quads as N-Triples / N-Quads files."""
    nt_lines(df).write.mode(mode).text(path)


