"""Hard negatives, divergence of sources and byte-pair encoding against brute force, the library and SQL."""

import hashlib
import math
import random
import struct
from collections import Counter
from fractions import Fraction
import re

import duckdb
import pytest

from cellforge.llm import bpe, divergence, hard_negatives

CASES = [
    None, "", "  \t\n", "Plain words, don't stop; it's 12 o'clock.", "<|startoftext|>In<|endoftext|><|endoftext|> text", "<|ENDOFTEXT|> <|endoftext |>", "ΣΑΣ İstanbul ſ ẞ ǅ",
    "é résumé 각 한국", "日本語のテキスト、と記号。", "  　 \x85\x1c\x1f", "\U0001F600‍\U0001F468 🇩🇪", "\u0000 nul ￾", "ab" * 30_000, "!" * 5_000 + "?" * 5_000,
]


def naive_merge(symbols, ranks):
    symbols = list(symbols)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks), default=None)
        if best is None:
            return symbols
        symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]


def test_merges_equal_a_plain_search():
    random.seed(3)
    for _ in range(400):
        letters = "abc"[: random.randint(1, 3)]
        parts = [*letters]
        ranks = {}
        for _ in range(12):
            pair = random.choice(parts), random.choice(parts)
            if pair not in ranks:
                ranks[pair] = len(ranks)
                parts.append("".join(pair))
        word = random.choices(letters, k=random.randint(1, 40))
        assert bpe.bpe_merge(word, ranks) == naive_merge(word, ranks)


def library(text):
    own = bpe.codec().whole
    ids = own.encode(text or "", add_special_tokens=False).ids
    return ids, own.decode(ids, skip_special_tokens=False)


def test_every_simple_character_equals_the_library():
    own = bpe.codec()
    for n in range(0x2100):
        c = chr(n)
        if bpe.SIMPLE.fullmatch(c):
            text = f"a{c}b {c}{c}1{c}"
            assert own.encode(text) == library(text)[0], hex(n)


def test_op13_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op13_bpe_encoding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids, text = library(texts[r.doc_id])
        digests = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digests)


def test_encoding_of_odd_texts_ids_and_columns(spark):
    random.seed(5)
    odd = ["".join(chr(random.choice([*range(32, 0x250), *range(0x300, 0x3100)])) for _ in range(random.randrange(60))) for _ in range(60)]
    texts = [*CASES, *odd, odd[0], odd[0]]
    docs = spark.createDataFrame([(str(i % 7) if i % 5 else None, t) for i, t in enumerate(texts)], "doc_id string, text string").selectExpr("*", "1 as ids", "'x' as decoded", "2 as n_tokens")
    got = Counter((r.id, bytes(r.ids), r.n_tokens, r.decoded) for r in bpe.bpe_encode(docs, decoded=True).collect())
    want = Counter()
    for i, t in enumerate(texts):
        ids, text = library(t)
        want[(str(i % 7) if i % 5 else None, struct.pack(f"<{len(ids)}I", *ids), len(ids), text)] += 1
    assert got == want
    back = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert Counter((r.id, r.text) for r in back) == Counter({k: n for k, n in Counter((i, t) for (i, _, _, t) in want.elements()).items()})
    assert bpe.bpe_encode(docs.limit(0)).count() == 0


def plain_audit(rows, least, top):
    """The audit of (text, lang, source) rows by its definition, every cell by itself."""
    words = [([w.decode() for w in re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").encode().lower())], l or "", s or "") for t, l, s in rows]
    out = set()
    for lang in {l for _, l, _ in words}:
        own = [(w, s) for w, l, s in words if l == lang]
        df = Counter(t for w, _ in own for t in set(w))
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        count = {s: Counter(t for w, x in own if x == s for t in w if df[t] >= least) for s in {s for _, s in own}}
        count[None] = sum(count.values(), Counter())
        p = {s: {t: 1 + math.floor(Fraction(10**9 * (c[t] + 2), sum(c.values()) + 2 * len(kept))) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in set(count) - {None}:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in set(count) - {None, s}]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)}
    return out


@pytest.mark.parametrize("blocks", [4, divergence.BLOCK_COUNTS])
def test_audit_equals_its_definition(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", blocks)
    random.seed(blocks)
    vocabulary = ["der", "Straße", "ÉTÉ", "été", "zz", "Ab", "日本", "\U0001F600x", "q1q", "a-b", "tie", "eit", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(random.choices(vocabulary, k=random.randrange(25))), random.choice(["en", "de", None]), random.choice(["s1", "s2", None, "é", "z"])) for _ in range(150)]
    rows += [(None, "en", "s1"), ("", "en", "quiet"), ("12 34 !", None, None), ("lonely words", "fr", "one"), ("other words", "fr", "two"), (None, "xx", "only"), ("same " * 40_000 + "tie eit", "en", "long")]
    rows += [rows[0]] * 5
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as n", "'t' as term", "2 as docs")
    for least in (1, 10):
        got = [tuple(r) for r in divergence.audit_sources(docs, least_docs=least, top=3).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least, 3)
    assert divergence.audit_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [0, divergence.SENT_ROWS])
def test_audit_sends_no_counts_through_the_driver(spark, sf, monkeypatch, sent):
    """Counts lie in a small file of compressed arrays, so their estimated size is far below what they unfold to."""
    monkeypatch.setattr(divergence, "SENT_ROWS", sent)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = divergence.op12_source_divergence(spark, sf)
        joins, open_ = [], [got._jdf.queryExecution().sparkPlan()]
        while open_:
            node = open_.pop()
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
            if node.nodeName() == "BroadcastHashJoin":
                joins.append((node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [j for j in joins if "FileScan" in j] and (sent == 0 or len(joins) >= 4)
    with monkeypatch.context() as m:
        m.setattr(divergence, "SENT_ROWS", 1 << 15)
        assert set(got.collect()) == set(divergence.op12_source_divergence(spark, sf).collect())


def plain_negatives(rows, positives=5, negatives=10):
    """The result for (vec_id, vector, label) rows, all pairs by themselves."""
    fit = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    order = lambda b: (-b[0], b[1] is None, b[1] or 0)
    for a, (i, v, y) in enumerate(fit):
        if i is None or i % 100:
            continue
        scores = [(sum(x * z for x, z in zip(v, w)), j, y == u) for b, (j, w, u) in enumerate(fit) if b != a]
        for s, j, _ in sorted((x for x in scores if x[2]), key=order)[:positives]:
            near = sorted((x for x in scores if not x[2] and 30 * s <= 100 * x[0] <= 90 * s), key=order)[:negatives]
            for r, (t, k, _) in enumerate(near):
                out[(i, j, r + 1, k, s, t)] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    random.seed(8)
    middles = [[random.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        m = random.choice(middles)
        rows.append((i, [x + random.gauss(0, 0.3) for x in m], random.randrange(3)))
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.125, 0.5], i % 2) for i in range(300)]  # copies
    rows += [(100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (None, [0.5] * 6, 2), (None, [0.25] * 6, 0), (2000, [0.0] * 6, 1), (2100, [1.0], 1), (2101, [1.0, 2.0], 2), (2200, [], 0)]
    rows += [(2300, None, 1), (2301, [0.1] * 6, None), (2302, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (2303, [float("nan")] * 6, 1), (2304, [float("inf")] * 6, 1), (2400, [1e30] * 6, 1)]
    return rows


@pytest.mark.parametrize("tree_rows,queries", [(40, 3), (10_000, 10_000)])
def test_negatives_equal_all_pairs(spark, monkeypatch, vectors, tree_rows, queries):
    monkeypatch.setattr(hard_negatives, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(hard_negatives, "TREE_QUERIES", queries)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as v", "2 as key", "3 as region", "4 as norm")
    from pyspark.sql import functions as F

    got = Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    assert got == plain_negatives([r for r in vectors if r[0] != 2400])
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine_hard_negatives(df.where("label is null"), F.lit(True)).count() == 0


def test_large_norms_stay_exact(spark):
    random.seed(2)
    rows = [(i, [random.randrange(-(1 << 20), 1 << 20) + 0.5 for _ in range(3)], i % 2) for i in range(0, 20_000, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    from pyspark.sql import functions as F

    got = Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0).collect())
    assert got == plain_negatives(rows)


@pytest.mark.parametrize("module", [hard_negatives, divergence])
def test_queries_equal_sql(spark, sf, module):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, f in module.QUERIES.items():
        df = f(spark, sf)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({module.ORACLES[name]})").fetchall()
        assert Counter(map(tuple, df.collect())) == Counter(want) and want
