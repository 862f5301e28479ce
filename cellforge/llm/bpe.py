"""Byte-pair encoding with a queue of merges over a linked list of symbols, and decoding (operator 13)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a Python worker keeps, each of HELD_CHARS letters at most; beyond that the words before go, and those since
#: then are kept beside the new ones.
HELD_WORDS, HELD_CHARS = 1 << 17, 64
#: Tokens after which a batch of results is handed on; a text is never split.
BATCH_TOKENS = 1 << 20
#: Characters that Unicode's composed form keeps as they are, and that Python and the tokenizer's own library lower and
#: class alike (tested one by one): ASCII, Latin-1, Latin Extended A and B, and common punctuation.
SIMPLE = regex.compile("[\\x00-\\u024F\\u2010-\\u2027\\u2030-\\u203A\\u20AC]*")


def bpe_merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols left when the neighbours of least rank (ties: the leftmost) are joined as long as some may be.

    The symbols are a doubly linked list, and each joinable pair of neighbours is an entry (rank, left place) of a heap. An
    entry is stale if its left symbol is gone or has another rank with its right neighbour by now; stale entries are skipped,
    so n symbols take n log n steps.
    """
    n = len(symbols)
    n, rank_of = len(symbols), ranks.get
    symbols, after, before = list(symbols), [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if j == n or rank_of((symbols[i], symbols[j])) != rank:  # a joined symbol is None and has no rank
            continue
        whole = symbols[i] = symbols[i] + symbols[j]
        symbols[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of((whole, symbols[k]))) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank_of((symbols[h], whole))) is not None:
            heappush(heap, (r, h))
    return [s for s in symbols if s is not None]


class WordBpe:
    """Encoder and decoder of one vocabulary file of the `tokenizers` library whose words end in a suffix.

    Read from the file: vocabulary, ranks of merges, the pattern of words, the suffix and the strings of added tokens, which
    are ids of their own wherever they stand in the raw text. Text is composed, its white space made plain and lowered. For
    texts of SIMPLE characters Python does that; others go through the file's own normaliser and splitter, as Unicode versions
    of libraries differ.
    """

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.whole = Tokenizer.from_file(path)
        model = held["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.letters = self._byte_letters()

    def _byte_letters(self) -> list[str]:
        """The letter of each byte: printable bytes of Latin-1 are themselves, the others take the code points from 256 on."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        return [chr(b if b in printable else next(spare)) for b in range(256)]

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given in the letters of its bytes."""
        symbols = list(word)
        symbols[-1] += self.suffix
        return tuple(map(self.ids.__getitem__, bpe_merge(symbols, self.ranks)))

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        out = []
        if SIMPLE.fullmatch(text):
            known = self.known.get
            for word in self.words.findall(text.lower()):
                ids = known(word)
                out += self._ids(word) if ids is None else ids
        else:
            for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text)):
                out += self._word(word)
        return out

    def _ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word of SIMPLE characters, from the older words that are known or by merging; the word is known from now on."""
        ids = self.older.get(word)
        if ids is None:
            ids = self._word("".join([self.letters[b] for b in word.encode()]))
        if len(word) <= HELD_CHARS:
            if len(self.known) >= HELD_WORDS:
                self.older = self.known.copy()
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        if not text:
            return []
        if self.between is None or not self.between.search(text):
            return self._plain(text)
        out = []
        for part in self.between.split(text):
            out += [self.added[part]] if part in self.added else self._plain(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings with spaces between, as the file names no decoder that would turn them into text."""
        return " ".join(map(self.tokens.__getitem__, ids))


@cache
def codec(name: str = VOCABULARY) -> WordBpe:
    return WordBpe(name)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids) of every whole text: the ids as little-endian unsigned 32-bit numbers in one binary value, and with
    `decoded` also the text that they decode to.

    One pass without a shuffle; a row is encoded by itself, so lost tasks are run again. Null and empty texts have no ids and
    decode to the empty text. Repeated rows come out as often as they come in, rows of one id or of none are encoded each by
    itself; ids may be of any type. Columns of other names are not read. An empty table gives no rows. A worker holds
    one batch of texts and the results of some BATCH_TOKENS tokens.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)

        def result(rows: pa.Array, counts: list, ids: list, texts: list) -> pa.RecordBatch:
            more = [pa.array(texts, pa.string())] * decoded
            return pa.RecordBatch.from_arrays([rows, pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), *more], names[: 3 + decoded])

        for batch in batches:
            rows, texts = batch.column(0), batch.column(1)
            since, tokens, counts, packed, plain = 0, 0, [], [], []
            for i in range(batch.num_rows):
                ids = own.encode(texts[i].as_py())
                tokens += len(ids)
                counts.append(len(ids))
                packed.append(np.array(ids, "<u4").tobytes())
                if decoded:
                    plain.append(own.decode(ids))
                if tokens >= BATCH_TOKENS:
                    yield result(rows.slice(since, i + 1 - since), counts, packed, plain)
                    since, tokens, counts, packed, plain = i + 1, 0, [], [], []
            if counts:
                yield result(rows.slice(since), counts, packed, plain)

    names = ["id", "n_tokens", "ids", "decoded"]
    schema = f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    return small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of every row of ids as `bpe_encode` packs them; null or no ids give the empty text. An id that the vocabulary
    does not have is an error. Repeated rows stay; an empty table gives no rows."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return small_batches(encoded).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")


def op13_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of what they decode to."""
    found = bpe_encode(table(spark, sf_dir, "documents"), decoded=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op13_bpe_encoding": op13_bpe_encoding}
