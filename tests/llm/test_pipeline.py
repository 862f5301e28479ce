import zlib

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from cellforge.llm import decontaminate as dec
from cellforge.llm import packing
from test_decontaminate import plain_overlaps
from test_line_dedup import plain_dedup
from test_simhash_packing import plain_components, plain_fingerprint, plain_similar


def test_pipeline_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: dec.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    left = {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}
    left = {d: x[0] for d, x in plain_dedup(left, 8).items() if x}
    root = plain_components({d: plain_fingerprint(t, 5) for d, t in left.items()})
    left = {d: t for d, t in left.items() if root[d] == d}
    root = plain_similar(left)
    left = {d: t for d, t in left.items() if root[d] == d}
    hit = {d for d, _ in plain_overlaps(left, bench)}
    assert hit
    left = {d: t for d, t in left.items() if d not in hit}
    rows = pipeline.run(spark, sf).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(left) and len(left) < len(docs)
    for d, pieces in got.items():
        ids = np.array([*packing.token_ids(left[d]), 0], "<u4")
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in pieces) == len(ids)


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(30), sf)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf).count() == 0


LONG = "\n".join(f"line {i} of a long text with words {i * 7919 % 100003} in it, and {i}x more of them." for i in range(5000))
COPY = "a text of some length that is here more than once, word by word, for the stages to find, in full and with its id."
ROWS = [
    (1, LONG, "en", 1), (2, COPY, "en", 2), (2, COPY, "en", 3), (3, COPY, "en", 4), (None, COPY, None, 5), (4, None, "en", 6), (4, None, "en", 6), (5, "", "de", 7), (6, " \t\n\x0b", None, 8),
    (None, None, None, 9), (7, "12 34 %%", "en", 10), (8, "only these words stand here and nowhere else, as far as one can see in this table, no?", "en", None), (8, "another text of the same id, which differs in nearly all of the words that it has, yes.", None, 12),
]


def test_stages_on_nulls_ties_repeats_and_clashing_columns(spark, sf):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n_chars long")
    extra = ["__lang", "__score", "__id", "__hash", "__node", "node", "k", "k2", "root", "cand", "fp", "h", "text_hash", "score", "source"]
    docs = docs.selectExpr("*", *(f"'und' as `{c}`" for c in extra))
    key = lambda rows: sorted((str(r.doc_id), str(r.text)) for r in rows)
    stage = dict(pipeline.STAGES)
    got = {}
    for name in ("language_id", "line_dedup", "simhash_near_dedup", "decontamination"):
        out = stage[name](spark, docs, sf)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert all(r[c] == "und" for r in rows for c in extra)
        got[name] = key(rows)
    every = sorted((str(d), str(t)) for d, t, *_ in ROWS)
    assert got["language_id"] == [x for x in every if any(c.isalpha() for c in x[1]) and x[1] != "None"]
    # the null id comes first, so its copy is the one that stays; texts without a word stay as they are
    assert got["line_dedup"] == [x for x in every if x[1] != COPY or x[0] == "None"]
    # of the copies the least id stays, with its repeated row; null and word-less texts are one group, of least id 4
    assert got["simhash_near_dedup"] == [x for x in every if x[1] == COPY and x[0] == "2" or x[1] == "None" and x[0] == "4" or any(c.isalnum() for c in x[1]) and x[1] not in (COPY, "None")]
    assert got["decontamination"] == every
    pieces = stage["packing"](spark, docs, sf).collect()
    assert sorted({(str(r.doc_id), r.doc_tokens) for r in pieces}) == sorted({(str(d), len(packing.token_ids(t)) + 1) for d, t, *_ in ROWS})
    assert sum(r.start == 0 for r in pieces) == len(ROWS)
