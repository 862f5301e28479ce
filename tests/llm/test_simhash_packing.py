import random
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from cellforge.llm import packing, simhash


def plain_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """ids -> least id reachable over links of 3 bits, by all pairs."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    random.seed(1)
    texts = [None, "", " \t\n", "One", "One two", "A b\x0bc\x0cd", "é À b c", "x " * 300, "a b c d e"]
    texts += [" ".join(random.choice(["the", "cat", "Sat", "on", "é"]) for _ in range(random.randint(1, 200))) for _ in range(60)]
    assert [simhash.simhash64(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_op2_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = plain_components(fps)
    got = simhash.op2_simhash_near_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_of_hot_groups(spark):
    """Groups over the limit go through narrower blocks and lose no component."""
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(3)]
    fps = set()
    for b in base:
        for _ in range(150):
            f = b
            for bit in random.sample(range(64), random.choice([1, 2, 3, 6])):
                f ^= 1 << bit
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.near_links(df, "fp", limit=20).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in links)
    want = plain_components({f: f & (2**64 - 1) for f in signed})
    parts = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({f: parts.get(f, f) for f in signed}) == groups(want)


def test_near_dedup_edge_cases(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, None), (3, "", "z"), (4, "q r s t u v", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr("*", "1 as __id", "2 as __hash", "3 as component_id")
    kept = sorted((str(r.doc_id), r.text, r.fp) for r in simhash.dedup_near(docs).collect())
    assert kept == sorted([("1", "a b c d e f", "x"), ("1", "a b c d e f", "x"), ("2", None, None), ("4", "q r s t u v", "w")], key=str)
    assert simhash.dedup_near(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_packing_round_trip(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    docs |= {-1: "hello <|endoftext|> world", -2: "<|endoftext|>" * 1500, -3: "no < |endoftext|> here", -4: " " * 3000 + "<|endoftext|>x"}
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(d, t_) for d, t_ in docs.items() if d < 0], table.schema)
    rows = packing.pack_documents(table.union(extra), groups=3).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids = [i for p in sorted(pieces, key=lambda p: p.start) for i in p.ids]
        assert ids == [*t.encode(docs[d] or "", add_special_tokens=False).ids, 0]
        assert all(p.doc_tokens == len(ids) for p in pieces)
    pad = 0
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:i]) for i in range(len(s))]
        assert sum(p.length for p in s) <= 1024
        pad += 1024 - sum(p.length for p in s)
    assert pad < 0.06 * 1024 * len(by_seq)


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "x " * 5000 + "<|endoftext|>")], "doc_id long, text string").selectExpr("*", "1 as start", "2 as length")
    rows = packing.pack_documents(docs, keep_ids=False).collect()
    assert sorted(r.doc_tokens for r in rows if r.start == 0)[:4] == [1, 1, 1, 3]
    assert sum(r.length for r in rows if r.doc_id == 3) == [r.doc_tokens for r in rows if r.doc_id == 3][0]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_first_fit_decreasing_matches_plain_search():
    random.seed(3)
    for _ in range(20):
        n = random.randint(0, 60)
        lengths = np.array([random.randint(1, 100) for _ in range(n)], np.int64)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in np.argsort(-lengths, kind="stable").tolist():
            b = next((k for k, r in enumerate(room) if r >= lengths[i]), None)
            if b is None:
                b = len(room)
                room.append(100)
            room[b] -= int(lengths[i])
            want[i] = b
        assert [want[i] for i in range(n)] == bins.tolist()


def test_pipeline_stage_drops_similar_documents_beyond_three_bits(spark):
    import corpus_pipeline

    random.seed(9)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(200)]
    rows = [(1, " ".join(base)), (9, " ".join(f"v{i}" for i in range(200))), (10, None), (None, "")]
    for d in range(2, 9):  # two or three words changed: 5-word similarity of 0.85 or more
        w = list(base)
        for i in random.sample(range(10, 190), 3):
            w[i] = f"x{d}{i}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    far = [d for d, t in rows if d in range(2, 9) and (simhash.simhash64(t) ^ simhash.simhash64(rows[0][1])).bit_count() > 3]
    close = [d for d, t in rows if d in range(2, 9) and simhash.jaccard(simhash.shingles(t), simhash.shingles(rows[0][1])) >= 0.8]
    assert far and len(close) == 7
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert got >= {1, 9} and not got & set(range(2, 9))
    assert corpus_pipeline.simhash_near_dedup(spark, docs.limit(0), "").count() == 0


def test_large_groups_are_linked_at_other_bits(spark):
    random.seed(11)
    base = random.getrandbits(62)
    fps = sorted({base} | {base ^ (1 << random.randrange(8)) ^ (1 << random.randrange(20)) for _ in range(60)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bits in (2, 4):
        root = {x: x for x in fps}
        for _ in fps:
            for x in fps:
                root[x] = min(root[y] for y in fps if (x ^ y).bit_count() <= bits)
        links = simhash.near_links(df, "fp", bits=bits, limit=8)
        got = {r.node: r.root for r in simhash.connected_components(links).collect()}
        assert got and {x: got.get(x, x) for x in fps} == root


def plain_similar(texts, least=0.8):
    """ids -> least id reachable over pairs at similarity `least` of their 5-word shingles, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_large_groups_of_similar_texts_are_not_expanded(spark):
    """A chain and a large group of near copies: the components of all pairs, from far fewer checks."""
    random.seed(21)
    texts, k = {}, 0
    base = [f"w{i}" for i in range(120)]
    for _ in range(250):
        w = list(base)
        w[random.randrange(120)] = f"x{k}"
        texts[k], k = " ".join(w), k + 1
    chain = [f"c{i}" for i in range(200)]
    for step in range(30):
        texts[k], k = " ".join(chain[step * 4 :] + [f"d{i}" for i in range(step * 4)]), k + 1
    for _ in range(20):
        texts[k], k = " ".join(f"z{random.randrange(10**6)}" for _ in range(80)), k + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links = simhash.similar_links(docs).collect()
    assert len(links) < 20 * len(texts)
    kept = {r.doc_id for r in simhash.dedup_similar(docs).collect()}
    want = plain_similar(texts)
    assert kept == {i for i in texts if want[i] == i} and len(kept) < 40
