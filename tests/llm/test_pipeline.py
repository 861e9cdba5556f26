"""The pipeline's stages against brute force on the smallest table."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline
    from octetlens.llm.common import store
    from octetlens.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(store(stage(spark, frames[-1], SF), name))
    assert all(f.columns == docs.columns for f in frames[1:-1])
    clean, exact, near, mixed = (f.collect() for f in frames[1:-1])
    assert {r.doc_id for r in clean} < {r.doc_id for r in docs.collect()} and len(clean) > 0.8 * docs.count()
    squeeze = lambda r: re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")
    least = {}
    for r in clean:
        least[squeeze(r)] = min(least.get(squeeze(r), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(least.values())
    sets = {}
    for r in exact:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in near) == sorted({find(i) for i in sets})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in mixed}
    rows = frames[-1].collect()
    assert len(rows) == len(mixed)
    for r in rows[:50]:
        assert r.ids == [1, *library.encode(text[r.doc_id] or ""), 2] and r.decoded == library.decode(r.ids)
