import random

import numpy as np

from cellforge.llm import language_id as lid
from cellforge.llm import quality_classifier as qc


def plain_phrases(text, train):
    """Greedy cross-parsing by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        n += 1
        i = max(i + 1, j - 1)
    return n


def test_automaton_reads_the_substrings():
    random.seed(1)
    for _ in range(20):
        t = "".join(random.choice("abc") for _ in range(random.randint(0, 40)))
        go = lid.suffix_automaton(np.array([ord(c) - 97 for c in t], np.int64), 3)
        assert len(go) <= max(1, 2 * len(t))
        for _ in range(60):
            s = "".join(random.choice("abc") for _ in range(random.randint(1, 6)))
            at = 0
            for c in s:
                at = go[at, ord(c) - 97] if at >= 0 else -1
            assert (at >= 0) == (s in t)


def test_phrases_match_substring_search():
    random.seed(2)
    make = lambda abc, n: "".join(random.choice(abc) for _ in range(n))
    train = {"x": [make("abcd ", 3000)], "y": [make("abce ", 3000)]}
    model = lid.Model.fit(train, chars=2500)
    used = {k: "".join(map(chr, np.concatenate([lid.normalise(t[0]), [32]])))[:2500] for k, t in train.items()}
    texts = [make("abcdefé ", n) for n in (1, 2, 7, 50, 300, 1024, 1025, 3000, 7000)] + ["d", "dad", "zzdzz", "a"]
    got = model.phrases([lid.normalise(t) for t in texts])
    for row, t in zip(got, texts):
        norm = "".join(map(chr, lid.normalise(t)))
        assert row.tolist() == [plain_phrases(norm, used[k]) if norm else 0 for k in ("x", "y")]


def test_language_accuracy_and_edges(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lid.op8_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    docs = spark.createDataFrame([(1, None, "en"), (1, "", "en"), (2, "12 %% 34", None), (None, "The end of it", None)], "doc_id long, text string, score string")
    model = lid.fit_language_model(spark.read.parquet(f"{sf}/documents.parquet"))
    got = lid.identify_languages(docs, model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en"] and got[0].score == "en" and all(0 <= r.score_ <= 1 for r in got)
    assert lid.identify_languages(docs.limit(0), model).count() == 0
    nothing = lid.fit_language_model(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert [r.lang_pred for r in lid.identify_languages(docs.drop("score"), nothing).collect()] == ["und"] * 4


def test_pieces_carry_their_state():
    """The count of a long text is that of one walk through it, also where two parses do not meet within a piece."""
    random.seed(5)
    make = lambda abc, n: "".join(random.choice(abc) for _ in range(n))
    model = lid.Model.fit({"x": [make("abcdef ", 6000)], "y": [make("defgh ", 6000)], "z": ["ab" * 5000], "few": ["abc"]})
    assert model.languages[0] == "few" and model.bits[0] < model.bits[1]
    texts = ["ab" * 4000, "z" * 5000, "", make("abcdefgh ", 9000), make("ab", 6000), "abc " * 900]
    got = model.phrases([lid.normalise(t) for t in texts])
    for row, t in zip(got, texts):
        n = lid.normalise(t)
        at = np.minimum(np.searchsorted(model.alphabet, n), len(model.alphabet) - 1)
        for k in range(len(model.languages)):
            state, count = int(model.starts[k]), 0
            for x in np.where(model.alphabet[at] == n, at, len(model.alphabet)).tolist():
                v = int(model.table[state + x])
                count, state = count + (v >> 30), v & (lid.PHRASE_START - 1)
            assert row[k] == count


def test_long_texts_count_whole():
    model = lid.Model.fit({"x": ["abcd " * 1000]}, chars=2048)
    t = "abcdz " * 50_000
    assert model.phrases([lid.normalise(t)])[0, 0] >= 90_000


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = qc.FactorisationMachine(np.zeros(len(qc.STATS)), np.ones(len(qc.STATS)), rng.normal(size=qc.BUCKETS + len(qc.STATS)), rng.normal(size=(qc.BUCKETS + len(qc.STATS), 4)))
    texts = ["One two three two.", "", None, "a\nb\na " * 9]
    idx, val, start = m.rows([qc.features(t) for t in texts])
    got, _ = m.margins(idx, val, start)
    for r, (a, b) in enumerate(zip(start, [*start[1:], len(idx)])):
        i, x = idx[a:b], val[a:b]
        want = m.w[i] @ x + sum(m.v[i[p]] @ m.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(got[r] - want) < 1e-8


def test_quality_held_out_accuracy_and_edges(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = qc.op10_quality_classifier(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x " * 100_000)], "doc_id long, text string").selectExpr("*", "1 as quality", "'s' as __x")
    none = qc.fit_quality_model(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    got = qc.score_quality(docs, none).collect()
    assert [r.score for r in got] == [0.5] * 3
    assert qc.score_quality(docs.limit(0), none).count() == 0
    many = spark.createDataFrame([(1, "good words here"), (1, "good words here"), (2, "#### $$$$ %%%%"), (2, "other")] * 20, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    one, two = (qc.fit_quality_model(x, marks) for x in (many, many.repartition(7).orderBy("text")))
    assert (one.w == two.w).all() and (one.v == two.v).all()  # repeated rows count once, in whatever order


def test_capitals_count_alike_at_every_length():
    at = qc.STATS.index("upper")
    for word in ("Слово ", "Λόγος ", "Łódź Ąę ", "Word "):
        for n in (4999, 5000, 5001):
            t = (word * 2000)[:n]
            assert qc.features(t)[2][at] == sum(x.isupper() for x in t) / n > 0


def test_one_id_on_all_rows_and_any_part_of_a_text(spark):
    """A model of rows that all have one id, two texts of which are on most rows; the telling part of a text is at its end."""
    from cellforge.llm import language_id

    rows = [(5, "der die das und nicht mit einer " * 40, "de")] * 3000 + [(5, "the and with of not that which " * 40, "en")] * 3000
    rows += [(5, "0 1 2 3 " * 20_000 + f"qq{chr(97 + i)} zx{chr(98 + i)} wvw " * 9_000, "xx") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit_language_model(docs)
    assert model.languages == ["de", "en", "xx"]
    got = [k for k, _, _ in model.predict(["das ist nicht mit der", "that which is not of the", "wvw qqa zxb wvw qqb"])]
    assert got == ["de", "en", "xx"]
    assert language_id.fit_language_model(docs.limit(0)).languages == []
