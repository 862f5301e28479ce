"""Language identification by cross-parsing with suffix automata (operator 8)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, give_back, small_batches, table

UNKNOWN = "und"
#: Bounds of the labelled sample: documents of each language, and code points of each language and of all together.
SAMPLE_DOCS = 48
SAMPLE_CHARS = 32_768
SAMPLE_TOTAL = 196_608
#: Code points of the pieces that the sample is made of.
SAMPLE_PIECE = 1024
#: Texts are parsed in pieces of this length, many at a time.
PIECE = 1024
#: Added to a table entry on whose symbol a new phrase starts.
PHRASE_START = 1 << 30


@cache
def _letters() -> np.ndarray:
    """True for code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normalise(text: str) -> np.ndarray:
    """Code points of a text in lower case, each run of other things than letters as one space."""
    if not text:
        return np.zeros(0, np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    c = np.where(letter, c, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return c[keep]


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the automaton that reads the substrings of `text`; -1 where none.

    Symbols are below `size`. State 0 is the start. Built online in linear time, with at most two states a symbol.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), size), -1, np.int32)
    for s, d in enumerate(nxt):
        for c, t in d.items():
            out[s, c] = t
    return out


@dataclass
class Model:
    """Parsing tables of all languages in one array; entries are premultiplied offsets, with PHRASE_START where a phrase starts."""

    languages: list[str]
    alphabet: np.ndarray
    table: np.ndarray
    starts: np.ndarray
    bits: np.ndarray

    @staticmethod
    def fit(samples: dict[str, list[str]], chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> "Model":
        """`samples`: pieces of text by language, the first ones first. Each gives as much of its sample as the bounds allow; `bits`, the logarithm of its
        length, makes the phrases of samples of different lengths compare."""
        languages = sorted(samples)
        texts = {}
        for k in languages:
            parts = [normalise(t) for t in samples[k]]
            texts[k] = np.concatenate([np.concatenate([p, [32]]) for p in parts] or [np.zeros(0)]).astype(np.uint32)
        size = min(chars, total // max(1, len(languages)))
        texts = {k: t[:size] for k, t in texts.items()}
        alphabet = np.unique(np.concatenate([np.array([32], np.uint32), *texts.values()]))
        width = len(alphabet) + 1
        tables, starts, at = [], [], 0
        for k in languages:
            go = suffix_automaton(np.searchsorted(alphabet, texts[k]), width)
            root = np.where(go[0] >= 0, go[0], 0)
            full = np.where(go >= 0, (go + at) * width, (root + at) * width + PHRASE_START)
            full[0] = (root + at) * width + PHRASE_START
            tables.append(full.astype(np.int32).ravel())
            starts.append(at * width)
            at += len(go)
        table_ = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        if len(table_) >= PHRASE_START:
            raise ValueError("the sample is too large for the parsing tables")
        bits = np.array([math.log2(max(2, len(texts[k]))) for k in languages])
        return Model(languages, alphabet, table_, np.array(starts, np.int32), bits)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language) -> phrases of the greedy parse into longest matches, whole texts.

        Texts are parsed in pieces of PIECE, many at a time, as if each piece began a phrase. A piece behind another is then
        parsed again from the state in which that one ended, until the two parses of it are in one state; from there on
        they are the same. So the count is that of one parse of the whole text.
        """
        pieces, owner = [], []
        for n, t in enumerate(texts):
            for i in range(0, len(t), PIECE):
                pieces.append(t[i : i + PIECE])
                owner.append(n)
        count = np.zeros((len(texts), len(self.languages)), np.int64)
        if not pieces:
            return count
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        size = np.array([len(pieces[i]) for i in order])
        grid = np.full((size[0], len(pieces)), len(self.alphabet), np.int32)
        for k, i in enumerate(order):
            at = np.searchsorted(self.alphabet, pieces[i])
            at = np.minimum(at, len(self.alphabet) - 1)
            grid[: size[k], k] = np.where(self.alphabet[at] == pieces[i], at, len(self.alphabet))
        state = np.tile(self.starts[:, None], (1, len(pieces)))
        ends = np.zeros((len(self.languages), len(pieces)), np.int32)
        active = np.searchsorted(-size, -np.arange(size[0]), "left")
        owners = np.array(owner)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        behind = np.flatnonzero(owners[1:] == owners[:-1]) + 1  # pieces that another one goes before, in the order of the texts
        late = np.sort(where[behind])  # their columns; columns go by length, so those that are still in a piece come first
        trace = np.empty((size[0], len(self.languages), len(late)), np.int32)  # entries of their first parse
        place = np.full(len(order), -1)
        place[late] = np.arange(len(late))
        for step in range(size[0]):
            n = active[step]
            v = self.table[state[:, :n] + grid[step, :n]]
            ends[:, :n] += v >> 30
            state[:, :n] = v & (PHRASE_START - 1)
            m = np.searchsorted(late, n, "left")
            trace[step, :, :m] = v[:, late[:m]]
        before = where[behind - 1]
        todo = np.repeat(np.arange(len(behind)), len(self.languages))
        lang = np.tile(np.arange(len(self.languages)), len(behind))
        while len(todo):
            column = where[behind[todo]]
            now = state[lang, before[todo]]
            slot = place[column]
            end = size[column]
            open_ = np.arange(len(todo))
            changed = np.zeros(len(todo), bool)
            step = 0
            while len(open_):
                c, k, s = column[open_], lang[open_], slot[open_]
                v = self.table[now[open_] + grid[step, c]]
                old = trace[step, k, s]
                np.add.at(ends, (k, c), (v >> 30) - (old >> 30))
                trace[step, k, s] = v
                now[open_] = v & (PHRASE_START - 1)
                step += 1
                apart = now[open_] != (old & (PHRASE_START - 1))
                done = apart & (end[open_] == step)
                state[lang[open_[done]], column[open_[done]]] = now[open_[done]]
                changed[open_[done]] = True
                open_ = open_[apart & ~done]
            # a piece that ended in another state changes the one behind it
            nxt = todo[changed] + 1
            ok = (nxt < len(behind)) & (behind[np.minimum(nxt, len(behind) - 1)] == behind[todo[changed]] + 1)
            todo, lang = nxt[ok], lang[changed][ok]
        np.add.at(count, owners[order], ends.T)
        return count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a code point of its parse) of each text."""
        normal = [normalise(t or "") for t in texts]
        has = [len(x) > 0 for x in normal]
        if not self.languages:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        out: list[tuple[str, float, float]] = []
        for n, found, ok in zip(normal, self.phrases(normal), has):
            if not ok:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            rate = found * self.bits / len(n)
            best = int(np.argmin(rate))
            weight = np.exp(-(rate - rate[best]) * min(len(n), 64) / 4)
            out.append((self.languages[best], float(1 / weight.sum()), float(rate[best])))
        return out


def held_out(id_col: str, of: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` by `of`; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == part, F.lit(False))


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on a bounded sample: pieces of SAMPLE_PIECE code points of the `sample_docs` documents of each language that come first
    by a hash of id and text.

    Documents equal in id, text and language count once, however often they appear. A document's pieces come in the order of a hash
    of their place, so any part of a text may be learned from; of a language first each document's first piece is taken,
    then each one's second, until there are three times `chars` code points (letters and single spaces between are fewer). Null languages,
    ids and texts are left out. An empty table gives a model that knows no language.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", "h"), "id", "h")
    chosen = known.select("lang", "id", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs).select("lang", "id", "h").collect()
    texts: dict[str, list[str]] = {}
    if chosen:
        part = known.where(F.col("id").isin([r["id"] for r in chosen]) & F.col("h").isin([r["h"] for r in chosen]))
        most = max(1, -(-3 * chars // SAMPLE_PIECE))
        places = F.sequence(F.lit(0), F.greatest(F.floor((F.length("text") - 1) / SAMPLE_PIECE), F.lit(0)))
        by_hash = F.slice(F.array_sort(F.transform(places, lambda k: F.struct(F.xxhash64("h", k).alias("rank"), k.alias("k")))), 1, most)
        pieces = part.select("lang", "id", "h", F.posexplode(F.transform(by_hash, lambda x: F.substring("text", (x["k"] * SAMPLE_PIECE + 1).cast("int"), F.lit(SAMPLE_PIECE)))).alias("r", "piece"))
        order = Window.partitionBy("lang").orderBy("r", F.xxhash64("id", "h"), "id", "h")
        pieces = pieces.dropDuplicates(["lang", "id", "h", "r"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
        for r in pieces.orderBy("lang", "n").select("lang", "piece").collect():
            texts.setdefault(r["lang"], []).append(r["piece"])
    return Model.fit(texts, chars)


def identify_languages(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "lang_bits")) -> DataFrame:
    """`docs` with the predicted language, its score and its parse's bits a code point; `und` for texts without a letter.

    Every text is parsed whole. Rows stay as they are, repeated ones included. Of languages that tie the first in the
    alphabet wins. With nothing learned all are `und`; an empty table gives no rows. A new column whose name is taken gets
    an underscore more.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    give_back(docs.sparkSession)

    @F.pandas_udf("lang string, score double, bits double")
    def of(texts):
        import pandas as pd

        found: list = []
        part: list = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > 2_000_000:
                found += held.value.predict(part)
                part, size = [], 0
        found += held.value.predict(part)
        return pd.DataFrame(found, columns=["lang", "score", "bits"])

    found = fresh(docs.columns, "__found")
    names = [fresh(docs.columns, n) for n in out]
    return small_batches(docs).withColumn(found, of(F.col(text_col))).select(*docs.columns, *(F.col(f"{found}.{a}").alias(b) for a, b in zip(("lang", "score", "bits"), names)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out("doc_id", 5, 0)))
    return identify_languages(docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text"), model).drop("text")


QUERIES = {"op8_language_id": op8_language_id}
