"""Every operator on one table of nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import random

import pytest

from cellforge.llm import decontaminate, html_extract, language_id, line_dedup, packing, quality_classifier, quality_rules, sharding, simhash, substring_dedup

random.seed(11)
ONE_LINE = " ".join(f"w{random.randrange(40_000)}x{i % 97}" for i in range(150_000))
MANY_LINES = "\n".join(f"line {i} of a long text with words {i * 7919 % 1000} in it." for i in range(20_000))
SPACES = " " * 300_000 + "\n" * 300_000
ROWS = [
    (1, ONE_LINE, "en"), (2, MANY_LINES, "en"), (3, SPACES, None), (4, None, None), (4, None, None), (5, "", "de"), (6, " \t\r\n\x0b\x0c", "fr"),
    (7, "the same text, twice over and over again, here.", "en"), (7, "the same text, twice over and over again, here.", "en"), (8, "the same text, twice over and over again, here.", None),
    (None, "no id but some text", "en"), (None, None, None), (9, "\u0000 null ￾ and \U0001F600 signs", "en"), (9, "another text of the same id", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.selectExpr("*", "'a' as __id", "'b' as __hash", "1 as score", "2 as start", "3 as kept", "array(1) as removed").cache()


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    assert out.columns == docs.columns and ids == sorted(map(str, [1, 2, 3, 4, 4, 5, 6, 7, 7, None, None, 9, 9]))


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    empty = {r.component_id for r in rows if r.fp == 0}
    assert empty == {3}
    assert {r.component_id for r in rows if r.id in (7, 8)} == {7}
    assert simhash.dedup_near(docs).columns == docs.columns


def test_packing(docs):
    rows = packing.pack_documents(docs, keep_ids=False, groups=2).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in rows}) == len({(d, t or "") for d, t, _ in ROWS})
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= 1024


def test_sharding(docs):
    rows = sharding.shard(docs, limit=100_000).collect()
    assert len(rows) == len(ROWS) and sum(r.n_bytes for r in rows) == sum(len((t or "").encode()) for _, t, _ in ROWS)


def test_quality_rules(docs):
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == len(ROWS) and {r.n_words for r in rows if r.doc_id in (3, 4, 5, 6)} == {0}
    assert {r.n_words for r in rows if r.doc_id == 1} == {150_000}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, ONE_LINE[5000:5400]), (2, None), (2, ""), (None, "x"), (3, "zzz " * 50)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1)}
    assert decontaminate.decontaminate(docs, bench).count() == len(ROWS) - 1


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>" + ONE_LINE), (1, None, None), (None, "v", SPACES), (2, "w", "<" * 20_000), (3, "x", "<div>" * 20_000 + "deep, text"), (4, "y", "a<b " * 20_000)], "page_id long, url string, html string")
    got = {(r.page_id, r.url): r for r in html_extract.extract_main_text(pages).collect()}
    assert len(got) == 6 and got[(1, "u")].text == ONE_LINE and got[(None, "v")].text == got[(1, None)].text == ""
    assert got[(3, "x")].text == "deep, text" and all(r.n_chars == len(r.text) for r in got.values())


def test_language(docs):
    model = language_id.fit_language_model(docs)
    rows = language_id.identify_languages(docs, model).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 6)} == {"und"}
    assert all(r.score == 1 and 0 <= r.score_ <= 1 for r in rows)


def test_substrings(docs):
    spans = substring_dedup.repeated_spans(docs, min_words=5).collect()
    assert {r.doc_id for r in spans} == {8}
    assert substring_dedup.dedup_substrings(docs, min_words=5).count() == len(ROWS)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (9, 0), (9, 0), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    model = quality_classifier.fit_quality_model(docs, labels)
    rows = quality_classifier.score_quality(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score_ <= 1 for r in rows)


def test_written_tables_have_data_files_only(spark):
    from cellforge.llm.common import written

    table = written(spark.range(100))
    files = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent()
    names = [x.getPath().getName() for x in files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files)]
    assert table.count() == 100 and all(n.startswith("part-") for n in names)


def test_written_tables_start_no_process_for_their_folders(spark, tmp_path):
    from cellforge.llm.common import written

    jvm = spark._jvm
    record = jvm.jdk.jfr.Recording()
    record.enable("jdk.ProcessStart")
    record.start()
    spark.range(100).write.parquet(f"{tmp_path}/plain")
    table = written(spark.range(100))
    record.stop()
    record.dump(jvm.java.nio.file.Paths.get(jvm.java.net.URI(f"file://{tmp_path}/record.jfr")))
    record.close()
    events = jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(jvm.java.nio.file.Paths.get(jvm.java.net.URI(f"file://{tmp_path}/record.jfr")))
    commands = [e.getString("command") for e in events]
    # what lies in /0 is made by tasks, which run in the driver only here
    made = [c for c in commands if c.startswith("chmod 0755") and "/0/" not in c]
    assert any(f"{tmp_path}/plain" in c for c in made) and not any("/table-" in c for c in made), made
    assert table.count() == 100


def test_written_tables_give_free_memory_of_the_driver_back(spark, tmp_path):
    from pathlib import Path

    from cellforge.llm.common import written

    jvm = spark._jvm
    memory, status = jvm.org.apache.spark.unsafe.Platform, Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/statm")
    resident = lambda: int(status.read_text().split()[1]) * 4096 / 1e6
    spark.range(100).write.parquet(f"{tmp_path}/first")
    held = []
    for _ in range(4000):
        held.append(memory.allocateMemory(64_000))
        memory.setMemory(held[-1], 1, 64_000)
    for n, at in enumerate(held):  # what stays makes the allocator keep what lies between
        if n % 50:
            memory.freeMemory(at)
    jvm.System.gc()
    before = resident()
    assert written(spark.range(100)).count() == 100
    after = resident()
    for at in held[::50]:
        memory.freeMemory(at)
    assert after < before - 150, (before, after)
