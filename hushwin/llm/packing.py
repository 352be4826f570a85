"""Packing by power-of-two decomposition.

Every document becomes pieces of binary lengths: as many of ``max_length``
as fit, then the set bits of the remainder, longest first. A piece is a
sequence of its own, so no sequence crosses documents and nothing is
padded; sequences of one length form a bucket that a trainer batches.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushwin.llm.common import text_slices, words

MAX_LENGTH = 4096
END_ID = 2
#: Sub-buckets of a length bucket: a sub-bucket is numbered in one task.
SHARDS = 4096
#: Text bytes encoded at once: words that repeat within them are looked up once.
SLICE = 8 << 20
#: Distinct words kept per worker; the memo is emptied when full (speed only, never results).
MEMO_WORDS = 800_000

#: A word that is Latin letters up to U+024F, then simple punctuation. Such
#: letters are stable under NFC, and lower case maps them one to one (U+0130
#: is left out), so a lower-cased memo key encodes like the word itself.
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<tail>[.,;:!?|]*)$"


class WordEncoder:
    """Token ids of white-space-separated words, memoised.

    The tokenizer drops white space before its merges and never merges
    across it, so a text's ids are the ids of its words in order (tested
    against whole-text encoding)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a task has one core
        self._tok = Tokenizer.from_file(path)
        self._memo: dict[str, bytes] = {"": b""}

    def _encode(self, parts: list[str]) -> list[bytes]:
        found = [e.ids for e in self._tok.encode_batch_fast(parts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = np.cumsum([4 * len(ids) for ids in found]).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _looked_up(self, parts: pa.Array) -> pa.Array:
        """The ids of each part, as large binary."""
        memo, coded = self._memo, parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [p for p in distinct if p not in memo]
        for at in range(0, len(missing), 20_000):
            part = missing[at:at + 20_000]
            memo.update(zip(part, self._encode(part)))
        return pa.array([memo[p] for p in distinct], pa.large_binary()).take(coded.indices)

    def __call__(self, distinct: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each word, as large binary."""
        if len(self._memo) > MEMO_WORDS:
            self._memo.clear()
            self._memo[""] = b""
        plain = pc.extract_regex(distinct, _PLAIN)
        stem = pc.if_else(plain.is_valid(), pc.utf8_lower(plain.field("stem")), distinct)
        tail = pc.if_else(plain.is_valid(), plain.field("tail"), "")
        return pc.binary_join_element_wise(self._looked_up(stem), self._looked_up(tail), pa.scalar(b"", pa.large_binary()))


_ENCODERS: dict[str, WordEncoder] = {}


def encode_texts(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ids): ids of text ``i`` with the end id are ``ids[starts[i]:starts[i + 1]]``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    at, values = words(texts)
    coded = values.dictionary_encode()
    end = pa.array([np.uint32(end_id).astype("<u4").tobytes()], pa.large_binary())
    each = pa.concat_arrays([_ENCODERS[path](coded.dictionary), end])
    # The end id is one more word, after the last of each text.
    ends = at[1:] + np.arange(len(at) - 1)
    code = np.full(len(values) + len(ends), len(each) - 1, np.int32)
    inside = np.ones(len(code), bool)
    inside[ends] = False
    code[inside] = coded.indices.to_numpy(zero_copy_only=False)
    stream = each.take(pa.array(code))
    bounds = np.frombuffer(stream.buffers()[1], np.int64, len(code) + 1) >> 2
    starts = bounds[np.concatenate(([0], ends + 1))]
    ids = np.frombuffer(stream.buffers()[2] or b"", "<u4", int(bounds[-1])) if len(code) else np.zeros(0, "<u4")
    return starts, ids


def cut(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the binary pieces of ``n`` tokens; ``max_length`` is a power of two."""
    out, at = [], 0
    while n - at >= max_length:
        out.append((at, max_length))
        at += max_length
    bit = max_length >> 1
    while bit:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pieces(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    copies and, with ``keep_ids``, the token ids. Equal documents that meet
    in a batch are one with their number in ``copies``. A null text is empty: its one piece is
    the end id. Null, repeated doc_ids and repeated rows are documents of
    their own. No shuffle: a piece depends on its document alone."""
    if max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def run(batches):
        for batch in text_slices(batches, 1, SLICE):
            starts, ids = encode_texts(batch.column(1), tokenizer)
            # Of equal documents the first stands for all: a group of copies is one row a batch.
            first: dict[tuple, int] = {}
            copies = [0] * batch.num_rows
            doc_ids = batch.column(0).to_pylist()
            for row in range(batch.num_rows):
                copies[first.setdefault((doc_ids[row], ids[starts[row]:starts[row + 1]].tobytes()), row)] += 1
            rows, piece_ids = [], []
            for row in first.values():
                at, n = int(starts[row]), int(starts[row + 1] - starts[row])
                for start, length in cut(n, max_length):
                    piece = ids[at + start:at + start + length]
                    rows.append((row, start, length, zlib.crc32(piece), n, copies[row]))
                    piece_ids.append(piece)
            row, start, length, crc, n, number = (pa.array(x, pa.int64()) for x in zip(*rows))
            columns = [batch.column(0).take(row), start, length, crc, n, number]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copies"]
            if keep_ids:
                ends = np.concatenate(([0], np.cumsum([len(p) for p in piece_ids])))
                flat = pa.array(np.concatenate(piece_ids).view(np.int32))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copies long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def number(piece_rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row per copy with sequence_id and offset: pieces are numbered
    within their length bucket. A bucket is dealt over ``shards`` by a hash
    of the piece, each shard counts its own rows, and the shard and the
    length's bit are the low digits of the id, so ids are unique and no task
    sees a whole bucket. Equal pieces share a shard, but come as one row a
    batch with their number. The order is total up to equal rows, so reruns
    agree."""
    bit = F.round(F.log2(F.col("length"))).cast("long")
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))
    w = Window.partitionBy("length", "_shard").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    before = F.coalesce(F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (piece_rows.withColumn("_shard", shard).withColumn("_before", before)
            .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .withColumn("sequence_id", ((F.col("_before") + F.col("_copy")) * shards + F.col("_shard")) * 64 + bit)
            .withColumn("offset", F.lit(0).cast("long"))
            .drop("_shard", "_before", "_copy", "copies"))


def pack(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, keep_ids: bool = True) -> DataFrame:
    """Pieces with their sequences; with ``keep_ids`` each row is a whole training sequence."""
    return number(pieces(docs, tokenizer, max_length, keep_ids))
