"""Tables of intermediate results, and rows without ids or under one id in the line dedup."""

import os
import random
import time

import pytest

from cellforge.llm import common, line_dedup


def test_settled_keeps_its_result_alone(spark):
    made = []

    def write(n):
        made.append(common.written(spark.range(n)).inputFiles()[0].split("://")[-1])
        return spark.read.parquet(os.path.dirname(made[-1]))

    out = common.settled(spark, lambda: write(3).union(common.settled(spark, lambda: write(4).union(write(5)))))
    assert out.count() == 12 and not any(map(os.path.exists, made))
    free = common.written(spark.range(2))
    assert free.count() == 2 and common._CLEAN not in {k for k in (common._CLEAN,) if spark.conf.get(k, None) == "true"}
    with pytest.raises(ZeroDivisionError):
        common.settled(spark, lambda: 1 / 0)
    assert common._open.paths == []


def plain(rows):
    """Remaining texts where lines go that repeat an earlier one or are a word edit away from it."""
    first, kept = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    earlier = []
    for doc, text, h in order:
        lines = []
        for line in text.split("\n"):
            w = tuple(line.split())
            gone = w and (w in first or any(near(w, v) for v in earlier))
            if w and w not in first:
                first[w] = 1
                earlier.append(w)
            if not gone:
                lines.append(line)
        kept[(doc, h)] = "\n".join(lines) if any(x.split() for x in lines) else None
    return kept


def near(a, b):
    """Whether two lines of two words or more are one word edit apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(b) < 2 and len(a) < 2 or len(a) - len(b) > 1 or a == b or len(b) < 2:
        return False
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_texts_under_one_id(spark, doc_id):
    from pyspark.sql import functions as F

    random.seed(6)
    words = [f"w{i}" for i in range(9)]
    texts = ["\n".join(" ".join(random.choices(words, k=random.randint(2, 5))) for _ in range(random.randint(1, 3))) for _ in range(200)]
    docs = spark.createDataFrame([(doc_id, t) for t in texts + texts[:20]], "doc_id long, text string")
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = plain([(doc_id, t, hashes[t]) for t in texts])
    got = sorted(r.text for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted(w for t in texts + texts[:20] if (w := want[(doc_id, hashes[t])]) is not None)


def test_rows_without_ids_take_time_in_proportion(spark):
    """100,000 rows without id; all rows of one id in one row, or joined with each other, would not end."""
    n = 100_000
    docs = spark.range(n, numPartitions=4).selectExpr("cast(null as long) as doc_id", "concat('line ', id % 1000, ' of many words\nrow number ', id, ' x', id * 7919 % 100003, ' alone') as text")
    began = time.time()
    out = line_dedup.dedup_lines(docs, fuzzy_words=8)
    assert out.count() == n and out.where("text like 'line%'").count() == 1000
    assert time.time() - began < 240
