import random
import re

from pyspark.sql import functions as F

from cellforge.llm import line_dedup

GAP = re.compile(r"[\x20\x09-\x0D]+")


def word_list(line):
    return [w for w in GAP.split(line) if w]


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_dedup(docs, least=2):
    """docs: {id: text}. Texts after brute-force removal, None for documents that go."""
    first = {}
    for d in sorted(docs):
        for k, line in enumerate(docs[d].split("\n")):
            w = tuple(word_list(line))
            if w and w not in first:
                first[w] = (d, k)
    order = sorted(first, key=first.get)
    gone = set()
    long = [w for w in order if len(w) >= least]
    for i, w in enumerate(long):
        if any(within_one(w, v) for v in long[:i]):
            gone.add(w)
    out = {}
    for d, t in docs.items():
        kept, lost = [], 0
        for k, line in enumerate(t.split("\n")):
            w = tuple(word_list(line))
            if w and (first[w] != (d, k) or w in gone):
                lost += 1
            else:
                kept.append(line)
        out[d] = ("\n".join(kept), lost) if not lost or any(word_list(x) for x in kept) else None
    return out


def test_against_brute_force(spark):
    random.seed(9)
    vocab = "a b c d e f g".split()
    docs = {}
    base = [[random.choice(vocab) for _ in range(random.randint(1, 12))] for _ in range(25)]
    for d in range(120):
        lines = []
        for _ in range(random.randint(1, 6)):
            w = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                op, at = random.choice("sid"), random.randrange(len(w))
                if op == "s":
                    w[at] = random.choice(vocab + ["zz"])
                elif op == "i":
                    w.insert(at, random.choice(vocab))
                elif len(w) > 1:
                    del w[at]
            lines.append(random.choice(["", "  "]) + " ".join(w) + random.choice(["", "\t"]))
        if random.random() < 0.3:
            lines.insert(0, "")
        docs[d] = "\n".join(lines)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df, count_col="n_removed").collect()}
    want = {d: x for d, x in plain_dedup(docs).items() if x}
    assert got == want
    assert sum(n for _, n in want.values()) > 50


def test_fixed_documents_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.op1_line_dedup(spark, sf).collect()}
    assert got == {d: x for d, x in plain_dedup(docs).items() if x}


def test_edges(spark):
    line = "one two three four five six seven eight"
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, 1), (2, "", 2), (3, f"{line}\n\nshort line", 3), (4, "short line", 4), (5, "Short line\n" + line.replace("four", "4"), 5), (None, "\n \n", 6), (6, long, 7), (7, long + " more", 8), (7, long + " more", 9), (7, "other words here", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int").withColumn("pos", F.lit("p")).withColumn("line_no", F.lit(0)).withColumn("__gone", F.lit(1)).withColumn("__hash", F.lit("h")).withColumn("__id", F.lit(2)).withColumn("Text_hash", F.lit(3))
    got = line_dedup.dedup_lines(df, count_col="n_removed")
    assert got.columns == [*df.columns, "n_removed_"]
    assert all((r["__gone"], r["__hash"], r["__id"], r["Text_hash"]) == (1, "h", 2, 3) for r in got.collect())
    out = sorted((str(r.doc_id), r.text) for r in got.collect())
    want = [("1", None), ("2", ""), ("3", f"{line}\n\nshort line"), ("None", "\n \n"), ("6", long), ("7", "other words here")]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    assert ("5", "Short line") in [(str(r.doc_id), r.text) for r in line_dedup.dedup_lines(df, fuzzy_words=8).collect()]


def test_template_lines_of_one_key_are_split(spark):
    """A template line with one changing word, which all its lines share a key of: Spark parts them among tasks."""
    n = 20_000
    body = " ".join(f"w{i}" for i in range(9))
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"first line\n{body} "), F.col("id").cast("string"), F.lit(" tail")).alias("text"))
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    settings |= {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1MB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = line_dedup.dedup_lines(df, count_col="n_removed")
        rows = out.collect()
        decided = line_dedup.line_decisions(df)
        decided.collect()
        plan = decided._jdf.queryExecution().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [(r.doc_id, r.n_removed) for r in rows] == [(0, 0)]
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"Join\(skew=true\) \[before#\d+L, after#\d+L, again", final)) >= 2


def test_plan_has_no_python(spark, sf):
    plan = line_dedup.op1_line_dedup(spark, sf)._jdf.queryExecution().toString()
    plan += line_dedup.line_decisions(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
