"""The registered queries beside their SQL, the pipeline beside its stages by hand, and the guard of the entry."""

import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, duck

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from fleetlens.llm.queries import QUERIES, tokenizer_path
from test_dedup import brute_bytes, brute_components


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    assert compare(spark, duck(small), small, name, queries()[name], oracle_sql().get(name)) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()


def test_entry_without_the_package(tmp_path):
    """With both folders gone the entry still imports and lists the other queries."""
    code = "import sys; sys.modules['fleetlens.llm'] = None; sys.path.insert(0, '.')\nimport __spark_entry__ as e\nassert len(e.queries()) > 100 and not any(n.startswith('op') for n in e.queries()), 1"
    gone = code.replace("sys.modules['fleetlens.llm'] = None", "import importlib.abc\nclass G(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p, t=None):\n        if n.startswith(('fleetlens.llm', 'corpus_pipeline')): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, G())")
    subprocess.run([sys.executable, "-c", gone], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])


def test_pipeline_stages(make, prose, spark, small):
    docs = make([(i, t, "en", s) for i, t, _, s in prose])
    rows = {i: t for i, t, *_ in prose}
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        out[name] = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {i: t for i, t in rows.items() if t and any(ch.isalpha() for ch in t)}
    assert dict(out["language_id"]) == kept
    first = {i: t for i, t in kept.items() if brute_components(list(kept.items()))[i][1] == i}
    assert dict(out["ngram_join"]) == first
    cut = {i: v[3].decode("utf-8", "ignore") for i, v in brute_bytes(list(first.items())).items()}
    assert dict(out["suffix_dedup"]) == cut
    copies = Counter(i for i, _ in out["mix_sources"])
    assert set(copies) <= set(cut) and max(copies.values()) <= 2 and all(cut[i] == t for i, t in out["mix_sources"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text in out["mix_sources"]:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], np.uint32)
        for at in range(0, len(ids), 4096):
            want[i, at // 4096, zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want
