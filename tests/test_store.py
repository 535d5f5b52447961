import bz2
import zipfile

import pytest

from quillstone.sources.rdf import QUADS, TurtleParser, nt_lines, parse_bytes, read_lines, read_rdf, rdfxml
from quillstone.store import Store, cat, diff, same, statistics
from quillstone.streaming.ingest import ingest, line_stream

DATA = '@prefix : <http://x/> . :a :p 1 ; :q "tab\\t\\"q\\"" . :b :p :a . :g { :a :p 2 }'


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store", prefixes={"": "http://x/"})
    out.add(spark.createDataFrame(TurtleParser(DATA).quads(), QUADS))
    return out


def found(store, text):
    return sorted(tuple(r) for r in store.engine().select(text).collect())


def test_quads_are_a_set(store):
    assert store.size() == 4
    store.update("INSERT DATA { :a :p 1 . :a :p 1.0 }")
    assert store.size() == 5


def test_delete_add_again_and_merge(store):
    v = store.version()
    store.update("DELETE DATA { :a :p 1 }")
    assert found(store, "SELECT ?v { :a :p ?v }") == []
    store.update("INSERT DATA { :a :p 1 }")
    assert found(store, "SELECT ?v { :a :p ?v }") == [("1",)]
    before = store.quads()
    store.merge()
    assert same(before, store.quads()) and len(store.manifest()["base"]) == 1
    assert store.quads(v).count() == 4  # an old version is still there
    store.vacuum()
    assert store.size() == 4


def test_transactions(store):
    store.begin()
    store.update("DELETE WHERE { ?s :p ?o } ; INSERT DATA { :z :p 9 }")
    assert found(store, "SELECT ?s { ?s :p ?o }") == [("http://x/z",)]
    store.rollback()
    assert len(found(store, "SELECT ?s { ?s :p ?o }")) == 2
    store.begin()
    store.update("INSERT DATA { :z :p 9 } ; DELETE DATA { :z :p 9 } ; INSERT DATA { :y :p 8 }")
    v = store.version()
    store.commit()
    assert store.version() == v + 1 and found(store, "SELECT ?s { ?s :p 8 }") == [("http://x/y",)] and found(store, "SELECT ?s { ?s :p 9 }") == []


def test_concurrent_writers_collide(store):
    with pytest.raises(RuntimeError):
        store._publish(store.version(), {})


def test_threshold_merges_and_listeners_hear(spark, tmp_path):
    heard = []
    st = Store(spark, f"file://{tmp_path}/s2", threshold=2, prefixes={"": "http://x/"})
    st.listeners.append(lambda adds, dels: heard.append((adds.count(), dels.count())))
    st.update("INSERT DATA { :a :p 1 } ; INSERT DATA { :a :p 2 } ; DELETE DATA { :a :p 1 }")
    assert heard == [(1, 0), (1, 0), (0, 1)] and len(st.manifest()["base"]) == 1


def test_graph_operations(store):
    store.update("COPY :g TO DEFAULT")
    assert found(store, "SELECT ?v { :a :p ?v }") == [("2",)]
    store.update("MOVE :g TO :h ; ADD :h TO :i ; CLEAR NAMED")
    assert store.size() == 1
    store.update("CREATE GRAPH :new ; DROP SILENT GRAPH :none ; CLEAR ALL ; LOAD SILENT <file:///no/such.ttl>")
    assert store.size() == 0


def test_delete_insert_is_evaluated_once(store):
    store.update("DELETE { ?s :p ?o } INSERT { ?o :p ?s } WHERE { ?s :p ?o FILTER isIRI(?o) }")
    assert ("http://x/a", "http://x/b") in found(store, "SELECT ?s ?o { ?s :p ?o }")
    store.update("INSERT { ?s :new [ :of ?s ] } WHERE { ?s :q ?o } ; WITH :g INSERT { ?s :seen true } WHERE { ?s :p ?o }")
    assert found(store, "SELECT ?s { ?s :new/:of ?s }") == [("http://x/a",)] and found(store, "SELECT ?s { GRAPH :g { ?s :seen true } }") == [("http://x/a",)]


def test_line_round_trip(spark, store, tmp_path):
    store.dump(f"{tmp_path}/dump.nq", "ntriples")
    again = read_lines(spark, f"{tmp_path}/dump.nq")
    assert same(again, store.quads())
    assert any("tab\\t\\\"q\\\"" in r[0] for r in nt_lines(again).collect())


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<a:a> <a:b> "c" .\n# note\n\nnonsense\n_:x <a:b> <a:c> . # end\n')
    assert read_lines(spark, f"{tmp_path}/x.nt").count() == 2
    with pytest.raises(Exception, match="bad line"):
        read_lines(spark, f"{tmp_path}/x.nt", strict=True).collect()


def test_files_archives_and_xml(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <http://x/> . :a :p ( 1 2 ) .")
    (tmp_path / "b.trig.bz2").write_bytes(bz2.compress(b"@prefix : <http://x/> . :g { :a :p :b }"))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("in/x.nt", "<a:a> <a:b> <a:c> .\n")
        z.writestr("y.ttl", "<a:d> <a:b> 4 .")
    assert read_rdf(spark, f"{tmp_path}/a.ttl").count() == 5
    assert read_rdf(spark, f"{tmp_path}/b.trig.bz2").collect()[0].g == "Ihttp://x/g"
    assert read_rdf(spark, f"{tmp_path}/c.zip").count() == 2
    xml = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://x/"><C rdf:about="http://x/a" xmlns:y="http://y/" y:n="v"><p xml:lang="en">hi</p><q rdf:resource="b"/>
      <r rdf:parseType="Resource"><s rdf:datatype="http://www.w3.org/2001/XMLSchema#int">3</s></r></C></rdf:RDF>"""
    got = rdfxml(xml, "http://x/")
    assert ("Ihttp://x/a", "Ihttp://x/q", "Ihttp://x/b", None) in got and len(got) == 6
    assert len(parse_bytes(xml, "x.rdf")) == 6


def test_datasets(spark, store):
    q = store.quads()
    assert same(cat(q, q), q) and diff(q, q).isEmpty()
    assert statistics(q).first().triples == 4


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.nt").write_text("<a:a> <a:b> <a:c> .\n<a:a> <a:b> <a:d> .\n")
    st = Store(spark, f"file://{tmp_path}/s3")
    ingest(st, line_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/cp", available_now=True).awaitTermination(60)
    assert st.size() == 2
    (tmp_path / "in" / "2.nt").write_text("- <a:a> <a:b> <a:c> .\n+ <a:a> <a:b> <a:e> .\n")
    ingest(st, line_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/cp", available_now=True).awaitTermination(60)
    assert sorted(r.o for r in st.quads().collect()) == ["Ia:d", "Ia:e"]


def test_operations_on_missing_graphs_fail_unless_silent(store):
    for text in ("DROP {} GRAPH :none", "MOVE {} :none TO :z", "ADD {} :none TO :z", "COPY {} :none TO :z", "CREATE {} GRAPH :g"):
        with pytest.raises(LookupError):
            store.update(text.format(""))
        store.update(text.format("SILENT"))
    assert store.size() == 4


@pytest.mark.parametrize("end", [".xz", ".lzma", ".lz4", ".zst"])
def test_compressed_lines(spark, tmp_path, end):
    import lzma

    import pyarrow as pa

    data = b"<a:a> <a:b> <a:c> .\n"
    sink = pa.BufferOutputStream()
    if end in (".lz4", ".zst"):
        with pa.CompressedOutputStream(sink, {".lz4": "lz4", ".zst": "zstd"}[end]) as out:
            out.write(data)
    packed = {".xz": lambda: lzma.compress(data), ".lzma": lambda: lzma.compress(data, lzma.FORMAT_ALONE)}.get(end, lambda: sink.getvalue().to_pybytes())()
    (tmp_path / f"x.nt{end}").write_bytes(packed)
    assert read_rdf(spark, f"{tmp_path}/x.nt{end}").collect()[0].o == "Ia:c"
