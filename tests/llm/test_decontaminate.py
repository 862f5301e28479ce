import itertools
import random

import numpy as np

from cellforge.llm import decontaminate as dec


def test_exact_passages_against_brute_force(spark, sf):
    bench = {r.item_id: " ".join(dec.tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, b in bench.items() if f" {b} " in f" {' '.join(dec.tokens(t))} "}
    rows = dec.op6_benchmark_decontamination(spark, sf).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        cut = dec.tokens(docs[r.doc_id][r.start : r.end])
        item = bench[r.item_id].split()[r.item_start : r.item_end]
        assert len(cut) == len(item) and sum(map(str.__eq__, cut, item)) == r.equal_tokens >= 0.8 * len(item)


def test_substitutions_blocks_and_edges(spark):
    random.seed(6)
    vocab = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: [random.choice(vocab) for _ in range(n)]
    items = [(i, text(40)) for i in range(30)]
    docs, want = [], set()
    for d in range(60):
        body = text(200)
        if d % 2:
            i = d % 30
            leak = list(items[i][1])
            for k in range(9, 40, 10):
                leak[k] = "changed"
            body[50:50] = leak
            want.add((d, i))
        docs.append((d, " ".join(body).upper(), d))
    seven = " ".join(items[3][1][:7])  # short items count as a whole only
    docs += [(100, None, 0), (101, "", 0), (None, "İ " + " ".join(items[0][1]), 0), (102, f"xx {seven} yy", 0), (103, f"xx {seven[:-6]} zzzzz yy", 0)]
    want |= {(None, 0), (102, 97)}
    ddf = spark.createDataFrame(docs, "doc_id long, text string, item_id long").selectExpr("*", "1 as __id", "2 as __hash", "3 as start")
    bdf = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(97, seven), (98, None), (99, "short"), (96, "!")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dec.contaminated(ddf, bdf).collect()]
    assert set(got) - {(d, 97) for d, _ in want} >= want - {(102, 97)} and (102, 97) in got and 103 not in {d for d, _ in got}
    want = set(got)
    assert all(i == 97 for _, i in want - {(d, d % 30) for d in range(1, 60, 2)} - {(None, 0)})
    names = bdf.selectExpr("cast(item_id as double) as item_id", "text")
    assert sorted(map(str, ((r.doc_id, int(r.item_id)) for r in dec.contaminated(ddf, names.union(names)).collect()))) == sorted(map(str, got + got))
    left = dec.decontaminate(ddf, bdf)
    assert left.columns == ddf.columns and {r.doc_id for r in left.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}
    assert dec.contaminated(ddf.limit(0), bdf).count() == 0 and dec.contaminated(ddf, bdf.limit(0)).count() == 0


def plain_overlaps(docs, bench, identity=0.8, share=0.5, least=8, long=50):
    """(document, item) pairs by all diagonals and all runs; diagonals with too few equal tokens in all are left out."""
    places = {}
    for i, w in bench.items():
        for k, x in enumerate(w):
            places.setdefault(x, []).append((i, k))
    out = set()
    for d, t in docs.items():
        w = dec.tokens(t or "")
        count = {}
        for p, x in enumerate(w):
            for i, k in places.get(x, ()):
                count[i, p - k] = count.get((i, p - k), 0) + 1
        for (i, shift), n in count.items():
            b = bench[i]
            need = len(b) if len(b) < 8 else min(max(least, share * len(b)), long)
            if (d, i) in out or n < identity * need:
                continue
            same = [0 <= shift + k < len(w) and w[shift + k] == x for k, x in enumerate(b)]
            for s in range(len(b)):
                for e in range(s + 1, len(b) + 1):
                    if e - s >= need and same[s] and same[e - 1] and sum(same[s:e]) >= (1 if len(b) < 8 else identity) * (e - s):
                        out.add((d, i))
    return out


def test_all_diagonals_of_the_fixed_documents(spark):
    sf = "/root/testdata/sf0.01"
    bench = {r.item_id: dec.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_overlaps(docs, bench)
    got = {(r.doc_id, r.item_id) for r in dec.op6_benchmark_decontamination(spark, sf).collect()}
    assert want and got == want


def test_longest_run_against_all_runs():
    random.seed(8)
    for _ in range(300):
        same = np.array([random.random() < random.choice([0.3, 0.8, 0.95]) for _ in range(random.randint(0, 40))], bool)
        runs = [(e - s, int(same[s:e].sum()), -s) for s in range(len(same)) for e in range(s + 1, len(same) + 1) if same[s] and same[e - 1] and same[s:e].sum() >= 0.8 * (e - s) - 1e-9]
        got = dec.longest_run(same, 0.8)
        assert (got is None) == (not runs) and (not runs or (got[1] - got[0], got[2], -got[0]) == max(runs))


def test_repetitive_texts_and_excerpts(spark):
    import time

    h = dec.TokenHashes().of("word " * 3000)
    began = time.time()
    zero = np.zeros(len(h), np.int8)
    kept = [len(dec.run_ends(zero[: len(x)], x, at)) for x, at in dec.seeds(h, zero, dec.masks_for([]))]
    assert kept == [2] * len(dec.MASKS) and time.time() - began < 0.5
    random.seed(12)
    item = [f"t{random.randrange(10**6)}" for _ in range(400)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "word " * 2000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(item[100:250])), (2, "a b c " + " ".join(item[300:340])), (3, "word " * 3000), (4, "word " * 30)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.equal_tokens for r in dec.contaminated(docs, bench).collect()}
    assert got == {(1, 1): 150, (3, 2): 2000}


def met_by_a_mask(n, changed):
    return any(all(m[p - o] == "0" for p in changed if o <= p < o + len(m)) for m in dec.MASKS for o in range(n - len(m) + 1))


def test_recall_of_short_runs_by_length_and_substitutions(spark):
    """Every placing of up to a fifth of substitutions within runs of 8 to 19 tokens, by the masks; some through the operator."""
    share = {}
    for n in range(8, 20):
        for k in range(1, n // 5 + 1):
            placings = list(itertools.combinations(range(1, n - 1), k))
            share[n, k] = sum(met_by_a_mask(n, p) for p in placings) / len(placings)
    assert min(share.values()) >= 0.9 and min(v for (n, _), v in share.items() if n >= 16) > 0.999, share
    random.seed(30)
    items, docs = [], []
    for n in (8, 9, 10, 12, 15):
        for p in itertools.combinations(range(1, n - 1), n // 5):
            item = [f"t{random.randrange(10**6)}" for _ in range(n)]
            copy = [f"x{random.randrange(10**6)}" if i in p else w for i, w in enumerate(item)]
            items.append((len(items), " ".join(item)))
            docs.append((len(docs), " ".join([*(f"y{random.randrange(10**6)}" for _ in range(30)), *copy, *(f"y{random.randrange(10**6)}" for _ in range(30))])))
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(d == i for d, i in got) and len(got) >= 0.95 * len(docs)
