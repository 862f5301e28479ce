"""First-fit-decreasing packing of token pieces (operator 3)."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, table, written

#: Documents that meet in one randomised group, on average; a group is packed by one task.
GROUP_DOCS = 4096
SEQUENCE = 1024


@cache
def _encoders(vocabulary: str) -> tuple[tiktoken.Encoding, Tokenizer, tuple[str, ...]]:
    """The fast encoder of plain text, the tokenizer itself, and the strings that the tokenizer takes for one added token."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb"))}
    plain = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    added = tuple(t.content for t in plain.get_added_tokens_decoder().values())
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), plain, added


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k") -> list[int]:
    """The ids that `tokenizers` gives with add_special_tokens=False; null and empty texts have none.

    The vocabulary's rank file encodes plain text to the same ids four times as fast, so it goes first. Texts that hold
    the string of an added token, and those that the fast encoder refuses (over-long runs of white space), go to
    `tokenizers` itself.
    """
    fast, plain, added = _encoders(vocabulary)
    if not text:
        return []
    if any(t in text for t in added):
        return plain.encode(text, add_special_tokens=False).ids
    try:
        return fast.encode_ordinary(text)
    except BaseException as e:  # the Rust side panics with a class that is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit)):
            raise
        return plain.encode(text, add_special_tokens=False).ids


class BinTree:
    """Tournament tree over bin capacities: the first bin that has room is found in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """Puts an item into the first bin that holds it; there must be one. Returns the bin."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < need:
                i += 1
        room[i] -= need
        at = i
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at - self.size


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Equal lengths keep their order."""
    order = np.argsort(-lengths, kind="stable")
    tree, used = BinTree(len(lengths), capacity), [0] * len(lengths)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        need = int(lengths[i])
        b = tree.place(need)
        bins[i], offsets[i] = b, used[b]
        used[b] += need
    return bins, offsets


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, vocabulary: str = "byte_bpe_50k", keep_ids: bool = True) -> DataFrame:
    """One row per piece of each document's tokens, the closing id 0 included; every piece but the last is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, start, length, crc, total, held = [], [], [], [], [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*token_ids(text, vocabulary), 0], "<u4")
                    for s in range(0, len(ids), capacity):
                        piece = ids[s : s + capacity]
                        row.append(r)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                        if keep_ids:
                            held.append(piece.astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, groups: int | None = None, seed: int = 0, vocabulary: str = "byte_bpe_50k", keep_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    A piece of full length is a sequence of its own and needs no group. The last piece of each document goes to a random
    group by a hash of its row, whatever the id, so a group holds GROUP_DOCS last pieces of less than `capacity` tokens
    on average and is packed by one task, first-fit decreasing; the number of groups grows with the table. Per piece:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id (below zero for full pieces), offset, and the token ids
    with keep_ids. Null and empty texts are the closing id alone. Rows repeated with one id are packed as often as they
    appear. Lengths that tie keep the order of id, length, checksum. Other columns are not read. An empty table gives no
    rows.
    """
    kind = dict(docs.dtypes)[id_col]
    groups = groups or max(1, -(-docs.count() // GROUP_DOCS))
    # written, so that texts are encoded once and a piece keeps its number if a task is run again
    pieces = written(token_pieces(docs, id_col, text_col, capacity, vocabulary, keep_ids).withColumn("piece", F.monotonically_increasing_id()))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]
    full = F.col("length") == capacity
    group = F.when(full, F.lit(-1) - F.col("piece")).otherwise(F.pmod(F.xxhash64(F.lit(seed), "piece", "doc_id", "ids_crc32"), F.lit(groups)))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, rows["offset"] = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        return rows[names]

    pieces = pieces.withColumn("grp", group)
    whole = pieces.where(full).withColumn("sequence_id", F.col("grp")).withColumn("offset", F.lit(0).cast("long")).select(*names)
    return whole.union(pieces.where(~full).groupBy("grp").applyInPandas(pack, schema))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)


QUERIES = {"op3_packing": op3_packing}
