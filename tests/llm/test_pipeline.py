"""The pipeline against a brute-force version of its stages, and its edges."""

import hashlib
import os
import re
import sys

import numpy as np
import pytest
from test_native import brute_hits
from test_text import brute_fingerprint, brute_spans
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidemark.llm.common import store, table
from tidemark.llm.queries import QUERIES, SQL, tokenizer_file

SF = "/root/testdata/sf0.001"


def brute(docs, items, languages):
    """Rows of the result for (doc_id, text) rows, the language decisions given."""
    kept = [(d, t) for d, t in docs if languages.get(d)]
    fps = {d: brute_fingerprint(t) for d, t in kept}
    root = {d: d for d, _ in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = [(d, t) for d, t in kept if find(d) == d]
    before = dict(kept)
    after = brute_spans(sorted(kept))
    kept = [(d, t) for d, t in after.items() if t == before[d] or t.strip()]
    kept = [(d, t) for d, t in kept if not brute_hits(t, items)[4]]
    codec, out = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), []
    for d, t in kept:
        ids = codec.encode(t, add_special_tokens=False).ids
        out.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(codec.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    first = {r.doc_id for r in cp.language_id(spark, docs, SF).select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    lettered = {d for d, t in rows if t and re.search(r"[^\W\d_]", t)}
    assert first <= lettered and len(first) > 0.97 * len(lettered)  # clean documents stay
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    got = sorted(tuple(r) for r in cp.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == brute(rows, items, dict.fromkeys(first, True))


@pytest.fixture
def odd(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words + ".", "en", "s", 3, "x"), (1, words + ".", "en", "s", 3, "x"), (2, None, "en", "s", None, "x"), (3, "", "en", None, 0, "x"), (4, "123 456", None, "s", 7, "x"),
            (None, "no id here but words", "en", "s", 20, "x"), (5, "the of and " * 40_000, "en", "s", 9, "x"), (6, words + ". tail", "en", "s", 9, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stages_on_odd_and_empty_rows(spark, odd, name, stage):
    for docs in (odd, odd.limit(0)):
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert len(rows) <= odd.count()
        if stage is not cp.encoding:
            assert out.columns == odd.columns and out.dtypes == odd.dtypes
            kept = [r.doc_id for r in rows]
            if docs is odd:
                assert 5 in kept and None in kept and kept.count(1) == 2  # clean, without id, repeated


def test_near_dedup_with_repeated_and_missing_ids(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(80)) for x in ("word", "other"))
    rows = [(1, one), (1, two), (2, one), (3, two), (None, one), (None, two), (None, "alone and without any id at all here"), (None, None), (None, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, df, SF).collect()), key=repr)
    alone = [x for x in kept if x[0] is None]
    assert [x for x in kept if x[0] is not None] == sorted([(1, one), (1, two)], key=repr)
    assert len(alone) == 2 and (None, "alone and without any id at all here") in alone  # null and empty texts share a fingerprint


def test_stage_order_and_registration():
    import __spark_entry__ as entry

    assert [f for _, f in cp.STAGES] == [cp.language_id, cp.near_dedup, cp.span_dedup, cp.decontamination, cp.encoding]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_native_queries_equal_duckdb(spark):
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    from check import compare, connect

    con = connect(SF)
    for name, sql in SQL.items():
        text, good = compare(spark, con, name, QUERIES[name], sql, SF)
        assert good, text


def test_every_query_gives_all_rows(spark):
    for name, base in {"op3": "documents", "op5": "documents", "op6": "documents", "op7": "pages", "op8": "documents", "op9": "documents", "op10": "documents", "op12": "documents"}.items():
        fn = next(f for n, f in QUERIES.items() if n.startswith(name + "_"))
        assert store(fn(spark, SF), "all").count() == table(spark, SF, base).count()
