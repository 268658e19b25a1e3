"""Packing of token sequences into windows: best-fit decreasing over a segment tree."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids_le binary"
TOKENIZER_FILE = "byte_bpe_50k.json"
WINDOW = 1024
#: Tokens of remainders that one packing group holds before it is packed and emitted.
GROUP_TOKENS = 8_000_000
#: Sequences are numbered within a task; the task's number stands in the higher bits.
TASK_SHIFT = 33


def vocabulary_path(name: str = TOKENIZER_FILE) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], str]:
    """Token bytes -> id of a byte-level BPE file, whose ids follow the order of its merges.

    The visible stand-ins of bytes are those of byte-level BPE: printable Latin-1 characters stand
    for themselves and the other bytes, in order, for the code points from 256 on.
    """
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    stand = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(stand[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, public_tokenizers.PATTERN


def added_tokens(path: str) -> dict[str, int]:
    """Content -> id of the file's added tokens, which must be plain: found anywhere, with nothing stripped around them."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what stands around them")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Ids of a byte-level BPE vocabulary; strings of the file's added tokens are these tokens if ``added``, else ordinary text."""

    def __init__(self, path: str | None = None, added: bool = False):
        import tiktoken

        ranks, pattern = byte_level_ranks(path or vocabulary_path())
        self.coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added_tokens(path or vocabulary_path()) if added else {})

    def __call__(self, text: str) -> list[int]:
        return self.coder.encode(text, allowed_special="all", disallowed_special=())


class CapacityTree:
    """Open windows by remaining capacity; finds the tightest that still takes a piece.

    A segment tree over the capacities 0..window counts the open windows below every node, so the
    search for the smallest capacity of at least ``need`` is one descent.
    """

    def __init__(self, window: int):
        self.size = 1
        while self.size <= window:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, window_no: int) -> None:
        self.open[capacity].append(window_no)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window that a piece of ``need`` fills best."""
        i, count = self.size + need, self.count
        if not count[i]:
            while True:  # up to the first ancestor with something to its right
                if i == 1:
                    return None
                if not i & 1 and count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        window_no = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, window_no


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of every piece; pieces longer than the window are an error."""
    tree, used, out = CapacityTree(window), 0, [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        if n > window:
            raise ValueError("cut overlong pieces first")
        found = tree.pop_tightest(n)
        if found is None:
            capacity, no = window, used
            used += 1
        else:
            capacity, no = found
        out[k] = (no, window - capacity)
        if capacity > n:
            tree.push(capacity - n, no)
    return out


def _packer(path: str | None, window: int, group_tokens: int, end_id: int, added: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ctx = Encoder(path, added), TaskContext.get()
        base, used = (ctx.partitionId() if ctx else 0) << TASK_SHIFT, 0
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids_le", pa.binary())])
        full: list[tuple] = []
        rest: list[tuple] = []
        pending = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal used, rest, pending
            places = best_fit_decreasing([r[2] for r in rest], window)
            for at in range(0, len(rest), 4096):
                yield batch([(*r[:4], base + used + no, off, r[4]) for r, (no, off) in zip(rest[at : at + 4096], places[at : at + 4096])])
            used += max((no for no, _ in places), default=-1) + 1
            rest, pending = [], 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                n, cut = len(ids), len(ids) - len(ids) % window
                for s in range(0, cut, window):
                    full.append((doc, s, window, n, base + used, 0, ids[s : s + window].tobytes()))
                    used += 1
                if cut < n:
                    rest.append((doc, cut, n - cut, n, ids[cut:].tobytes()))
                    pending += n - cut
                if len(full) >= 1024:
                    yield batch(full)
                    full = []
                if pending >= group_tokens:
                    yield from packed()
        if full:
            yield batch(full)
        if rest:
            yield from packed()

    return pack


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    group_tokens: int = GROUP_TOKENS,
    end_id: int = 0,
    added: bool = False,
) -> DataFrame:
    """One row per piece of a document, placed in a sequence of at most ``window`` tokens.

    Every document (null text: empty) becomes its token ids and ``end_id``. Full windows are cut off
    first and are sequences of their own; the remainders of a task are packed best-fit decreasing, in
    groups of ``group_tokens`` to bound memory. Nothing is shuffled: a task packs what it reads, and
    doing it again after a lost executor gives the same numbers. Repeated rows are packed each;
    null ids stay null; other columns are ignored; an empty table gives no rows.

    With ``added`` the strings of the tokenizer file's added tokens are these tokens, as for its own library; else they
    are ordinary text. ``ids_le`` holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer, window, group_tokens, end_id, added), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns: the ids of a piece stand as their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
