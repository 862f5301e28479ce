import math
import random
import re

import pytest

from cellforge.llm import quality_rules, sharding, substring_dedup


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    marked = {i + k for i, s in enumerate(spans) if spans.count(s) > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_base_counts_match_definition():
    random.seed(2)
    texts = ["", " \n\t", "a b c d e a b c d e", "x x x x x x x", "é|<>\na b\na b\n \n \nA b\x0bc d e"]
    texts += ["".join(random.choice(["a ", "b ", "c\n", "d# ", "é\t"]) for _ in range(random.randint(0, 80))) for _ in range(150)]
    for t in texts:
        assert quality_rules.base_counts(t) == plain_counts(t), t


def test_quality_rules_keep_clean_and_reject_junk(spark):
    random.seed(4)
    prose = " ".join("".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 9))) for _ in range(700))
    noise = " ".join("".join(chr(random.randint(33, 0x2FFF)) for _ in range(30)) for _ in range(200))
    rows = [(1, prose, 1), (2, "word " * 500, 2), (3, noise, 3), (4, None, 4), (5, "", 5), (6, "few words here", 6), (6, "few words here", 7)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == 7 and kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_verdicts_against_a_plain_version(spark, sf):
    import zstandard

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, sf).collect()}
    assert set(got) == set(docs)
    rate = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    typical = lambda n: 0.36 + 3.5 / n**0.4
    inside = lambda b: 0.8 * typical(len(b)) <= rate(b) <= max(0.7, 1.35 * typical(len(b)))
    for d, t in docs.items():
        n, chars, symbols, lines, repeat = plain_counts(t or "")
        failed = n < 10 or 100 * repeat > 20 * n
        raw = (t or "").encode()
        chunks = [raw[i : i + 2048] for i in range(0, len(raw), 2048) if i + 2048 <= len(raw)]
        kept = not failed and inside(raw) and 4 * sum(not inside(c) for c in chunks) <= len(chunks)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (n, chars, symbols, lines, repeat, failed, kept), d


def test_texts_of_other_kinds(spark):
    """Short text in a script of three bytes a letter is kept, encoded noise and repeated text are not."""
    import base64

    random.seed(6)
    chinese = "".join(chr(random.choice(range(0x4E00, 0x4E00 + 700))) + (" " if i % 9 == 8 else "") for i in range(102))
    noise = base64.b64encode(random.randbytes(3000)).decode()
    noise = " ".join(noise[i : i + 60] for i in range(0, len(noise), 60))
    half = " ".join(f"{random.randrange(10**5)}" for _ in range(400))
    rows = [(1, chinese), (2, noise), (3, " ".join([half] * 8))]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_good_documents_are_kept(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality_rules.op5_quality_rules(spark, sf).collect()}
    good = [got[d] for d, q in labels.items() if q == 1 and not got[d].base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)


def test_shards_fit_and_follow_prefixes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    limit = 20_000
    rows = sharding.shard(docs, limit=limit).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard_id, []).append(r)
    ids = list(by)
    assert not any(a != b and b.startswith(a) for a in ids for b in ids)
    for s, group in by.items():
        assert len(s) == group[0].shard_depth and group[0].shard_bytes == sum(r.n_bytes for r in group) and group[0].shard_docs == len(group)
        assert group[0].shard_bytes <= limit or len(group) == 1
        if s:  # the parent had to be split
            assert sum(r.n_bytes for x, g in by.items() if x.startswith(s[:-1]) for r in g) > limit


def test_shard_edge_cases(spark):
    docs = spark.createDataFrame([(None, "aé"), (1, None), (1, "x" * 50), (1, "y" * 50), (2, "")], "doc_id long, text string").selectExpr("*", "1 as h", "2 as slot")
    rows = sharding.shard(docs, limit=10).collect()
    assert len(rows) == 5 and len({r.shard_id for r in rows if r.n_bytes == 50}) == 2
    assert sorted(r.n_bytes for r in rows) == [0, 0, 3, 50, 50]
    assert sharding.shard(docs.limit(0)).count() == 0


def test_rows_of_one_id_and_equal_rows_part(spark):
    """Rows without id, and rows equal in id and text: no shard is over the limit unless it holds one row."""
    rows = [(None, f"{i:03}" + "x" * 97) for i in range(500)] + [(7, "y" * 100)] * 300 + [(8, "z" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shard(docs, limit=1000).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard_id, []).append(r)
    assert len(out) == len(rows)
    assert all(sum(r.n_bytes for r in g) == g[0].shard_bytes <= 1000 or len(g) == 1 for g in by.values())


def test_shards_are_written_with_all_columns(spark, tmp_path):
    rows = [(i % 40 if i % 7 else None, "t" * (i % 60), f"a{i}") for i in range(300)] + [(5, "same" * 30, "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard_id string").selectExpr("*", "1 as __id", "2 as h", "3 as n_bytes", "4 as `a.b`", "5 as slot", "6 as depth")
    sharding.write_shards(docs, str(tmp_path / "out"), limit=1000)
    back = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "shard_id_"}
    assert sorted(map(str, back.select(*(f"`{c}`" for c in docs.columns)).collect())) == sorted(map(str, docs.collect()))
    sizes = back.groupBy("shard_id_").agg({"text": "count"}).count()
    assert sizes > 10
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))


def plain_units(text):
    """(start, end, words) of the units, character by character, for scripts that put spaces between words."""
    out, at = [], 0
    for line in text.split("\n"):
        pieces, now, i = [], "", 0
        while i < len(line):
            now += line[i]
            i += 1
            if now[-1] in ".!?…" and i < len(line) and line[i] in " \t\x0b\x0c\r":
                while i < len(line) and line[i] in " \t\x0b\x0c\r":
                    now += line[i]
                    i += 1
                if len(re.findall(r"[^\x20\x09-\x0D]+", now)) >= 5:
                    pieces.append(now)
                    now = ""
        start = at
        for p in [*pieces, now]:
            if w := re.findall(r"[^\x20\x09-\x0D]+", p.lower()):
                out.append((start, start + len(p), " ".join(w)))
            start += len(p)
        at += len(line) + 1
    return out


def test_repeated_spans_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    first, want = {}, []
    for d in sorted(texts):
        run = None
        for k, (i, j, norm) in enumerate(plain_units(texts[d])):
            if norm in first:
                n = len(norm.split())
                if run and run[0] == k - 1:
                    run[0], run[2], run[3], run[4] = k, j, run[3] + n, run[4] + 1
                else:
                    run = [k, i, j, n, 1, *first[norm]]
                    want.append((d, run))
            else:
                first[norm] = (d, i)
                run = None
    want = sorted((d, *r[1:]) for d, r in want if r[3] >= 20)
    got = sorted((r.doc_id, r.start, r.end, r.n_words, r.n_units, r.kept_doc_id, r.kept_start) for r in substring_dedup.repeated_spans(docs, min_words=20).collect())
    assert got == want and got


def test_substring_edge_cases(spark):
    line = "É" + " ".join(f"Word{i}" for i in range(60)) + "."
    rows = [(1, f"start here now\n{line}\nend"), (2, f"other\n{line.upper()}\r\ntail é"), (3, None), (4, ""), (None, "short"), (5, "short"), (6, f"{line} {line}"), (1, f"start here now\n{line}\nend")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as removed", "7 as start", "1 as __id", "2 as __hash", "3 as __spans")
    got = {(r.doc_id, r.text): r for r in substring_dedup.dedup_substrings(docs, min_words=20).collect()}
    assert sum(1 for _ in substring_dedup.dedup_substrings(docs, min_words=20).collect()) == 8
    every = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(docs).collect()}
    assert every[5] == "" and every[None] == "short"  # short repeats go where no limit is set
    out = {d: t for d, t in got}
    assert out[1] == rows[0][1] and out[2] == "other\n\ntail é" and out[3] is None and out[4] == "" and out[5] == "short"
    assert out[6] in ("", line, line + " ", " " + line) or len(out[6]) <= len(line) + 1
    assert substring_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_passages_that_start_and_end_inside_sentences(spark):
    w = [f"word{i}" for i in range(60)]
    inside = " ".join(w[:12]) + ". " + " ".join(w[12:20]) + ". " + " ".join(w[20:32])  # the whole sentence has 8 words
    rows = [(1, f"Some words before {inside} and other words behind."), (2, f"Here begins {inside.upper()} then it goes on."), (3, f"Short. {' '.join(w[12:20])}. Tail.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.extended_spans(docs, min_words=20).collect()
    assert [(r.doc_id, r.n_words, r.n_units, r.kept_doc_id, r.kept_start) for r in got] == [(2, 32, 1, 1, 18)]
    assert rows[1][1][got[0].start : got[0].end].strip() == inside.upper()
    out = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(docs, min_words=20).collect()}
    assert out == {1: rows[0][1], 2: "Here begins then it goes on.", 3: rows[2][1]}


def test_runs_that_meet_and_sentences_without_ascii_ends(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(9)) + ". " for c in "ab")
    rows = [(1, f"{a}m1 m2 m3 m4 m5. "), (2, f"z1 z2 z3 y4 y5. {b}"), (3, f"{a}m1 m2 m3 x y5. {b}"), (4, f"{a}m1 m2 m3 y4 y5. {b}")]
    got = substring_dedup.extended_spans(spark.createDataFrame(rows[:2] + rows[3:], "doc_id long, text string"), min_words=10).collect()
    assert [(r.doc_id, r.start, r.end, r.n_words, r.kept_doc_id) for r in got if r.doc_id == 4] == [(4, 0, len(rows[3][1]), 23, 1)]
    got = substring_dedup.extended_spans(spark.createDataFrame(rows[:3], "doc_id long, text string"), min_words=10).collect()
    assert sorted(r.n_words for r in got if r.doc_id == 3) == [10, 12]
    assert len(substring_dedup.units("यह पहला लंबा वाक्य है। यह दूसरा लंबा वाक्य है।")) == 2
    assert len(substring_dedup.units("今日は天気がいいです。明日も天気がいい。")) == 2
