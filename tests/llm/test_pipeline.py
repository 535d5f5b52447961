"""The pipeline's stages over the smallest tables, each held against brute force on its own input."""

import itertools
import os
import re

import pytest

import corpus_pipeline
from quillstone.llm import packing, source_mix, toxicity
from quillstone.llm.scratch import keep

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(keep(stage(spark, docs[-1], SF), name))
    columns = docs[0].columns
    assert all(d.columns == columns for d in docs[:-1])
    rows = [{r.doc_id: r for r in d.select("doc_id", "text").collect()} for d in docs[:4]]
    # toxicity: exactly the documents that score under the threshold
    model = toxicity.fit(docs[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(rows[1]) == {r.doc_id for r in toxicity.score(docs[0], model).collect() if r.score < toxicity.THRESHOLD}
    # exact dedup: the largest id of equal texts
    last = {}
    for i, r in rows[1].items():
        last[lower(r.text)] = max(i, last.get(lower(r.text), i))
    assert set(rows[2]) == set(last.values())
    # near dedup: the smallest id of each component
    sets = {}
    for i, r in rows[2].items():
        w = lower(r.text).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert set(rows[3]) == {i for i in sets if find(i) == i}
    # mixing: as often as the mix says
    want = {r.doc_id: r.taken // r["size"] for r in source_mix.mix(docs[3]).collect() if r["size"] and r.taken}
    assert {r.doc_id: r["count"] for r in docs[4].groupBy("doc_id").count().collect()} == want
    # packing: every id of every copy is in one place
    encode = packing.Encoder(packing.default_tokenizer())
    tokens = {i: len(encode(r.text or "")) // 4 + 1 for i, r in rows[3].items()}
    packed = docs[5].toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: n * tokens[i] for i, n in want.items()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
