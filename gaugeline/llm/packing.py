"""Packing documents into token sequences by best-fit decreasing.

A task tokenizes its rows, cuts every document of more than a window into full windows, which are
sequences of their own, and packs the rest of each block of rows, longest first, each piece into the
open sequence with the least room that still holds it. A segment tree indexed by remaining capacity
finds that sequence. A block is flushed at BLOCK_TOKENS, so a task's memory is bounded and no shuffle is
needed; a block holds some thousand sequences, of which the last few have padding.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
#: A block's token ids take four bytes each.
BLOCK_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open sequences by their remaining capacity: a complete binary tree whose inner nodes say whether a
    leaf below them is used. ``take(n)`` gives the sequence with the least capacity of n or more."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.used = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i, used = capacity + self.size, self.used
        while i and not used[i]:
            used[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        i, used, size = least + self.size, self.used, self.size
        if not used[i]:
            while True:  # up until a used right sibling, then down to its leftmost used leaf
                if i & (i + 1) == 0:  # the last of its level: nothing further right
                    return None
                if not i & 1 and used[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < size:
                i = 2 * i if used[2 * i] else 2 * i + 1
        capacity = i - size
        sequence = self.open[capacity].pop()
        if not self.open[capacity]:
            while i:
                used[i] = 0
                i >>= 1
                if not i or used[2 * i] or used[2 * i + 1]:
                    break
        return capacity, sequence


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[tuple[int, int]], int]:
    """For each length, in descending order already, its (sequence, offset); and the number of sequences."""
    tree, placed, n = CapacityTree(window), [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            capacity, sequence, n = window, n, n + 1
        else:
            capacity, sequence = found
        placed.append((sequence, window - capacity))
        if capacity > length:
            tree.put(capacity - length, sequence)
    return placed, n


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _plain(held: dict) -> bool:
    """Whether a vocabulary file has nothing that ranks by id don't say: a normaliser, another splitter than byte level, a
    post-processor that changes ids, dropout, flags of added tokens, or merges in another order than their ids."""
    model, split = held["model"], held.get("pre_tokenizer") or {}
    options = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    flags = any(t.get(k) for t in held.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["merges"]]
    ordered = all(a < b for a, b in zip(merged, merged[1:], strict=False)) and (not merged or merged[0] >= 0)
    return model.get("type") == "BPE" and not held.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not options and not flags and ordered


class ByteBpe:
    """The ids of a byte-level BPE vocabulary file, as little-endian bytes. The file is that of the
    tokenizers library; tiktoken gives the same ids several times as fast from one that has nothing but its merges in the order of their
    ids. Any other file is left to tokenizers itself."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self._whole = None
        if not _plain(held):
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(path)
            return
        byte = _byte_of_char()
        special = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self._encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)

    def __call__(self, text: str) -> bytes:
        if self._whole is not None:
            import numpy as np

            return np.asarray(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        allowed = set(self._special) if any(s in text for s in self._special) else set()
        return self._encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes()


_TOKENIZERS: dict[str | None, ByteBpe] = {}


def tokenizer(path: str | None) -> ByteBpe:
    """One for each worker, kept between tasks."""
    if path not in _TOKENIZERS:
        import public_tokenizers

        _TOKENIZERS[path] = ByteBpe(path or public_tokenizers.path("byte_bpe_50k.json"))
    return _TOKENIZERS[path]


def pack(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of SCHEMA, one for each piece: ``ids`` are its token ids as little-endian unsigned 32-bit numbers.

    A null or empty text is the end id alone. Equal rows are packed one by one. An empty table gives an
    empty one. Other columns than doc_id and text are not read. The rows should come from a table (a scan
    or a written stage): a task that runs again then sees its rows in the same order.
    """

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode = tokenizer(tokenizer_path)
        end = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.binary() if x.endswith("binary") else pa.int64() for x in SCHEMA.split(", ")]
        pieces: list[tuple] = []

        def flush() -> Iterator:
            nonlocal sequence, pieces
            pieces.sort(key=lambda p: -p[2])
            placed, n = best_fit_decreasing([p[2] for p in pieces], window)
            rows = [(*p, sequence + s, o) for p, (s, o) in zip(pieces, placed, strict=True)]
            sequence += n
            pieces = []
            for k in range(0, len(rows), 2000):
                columns = zip(*rows[k : k + 2000], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    pieces.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total))
                held += total
                if held >= block_tokens:
                    yield from flush()
                    held = 0
        if pieces:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
