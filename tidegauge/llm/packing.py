"""Packing documents into sequences by harmonic classes.

Lengths from capacity / (k + 1) (exclusive) to capacity / k form class k, whose sequences take k pieces each. A document
is cut into whole sequences and a rest; from the rest, pieces of exactly capacity // k tokens are cut off, the longest
first, until less than ``least_cut`` tokens remain, so nearly all tokens lie in classes that fill their sequences.
Workers fill the classes of their own share of the pieces; what is left over in a worker's classes goes into common
sequences, first fit by decreasing length.
"""

from __future__ import annotations

import json
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint

#: Pieces that a worker's share aims at.
SHARE = 40_000
#: Chunks whose ids a worker remembers at most.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: a file for the library tokenizers; its path is the same on all machines."""

    tokenizer: str
    capacity: int = 2048
    end_id: int = 1
    least_cut: int = 128


#: Fixed: how a byte-level BPE cuts a text before it merges, and its stand-ins for bytes that are no printable
#: characters (the printable ones of Latin-1 stand for themselves, the others count up from 256).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
STANDINS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
PROBE = "It's 10 %%% naïve\nlines\n\n of\ttext , été 東京!? a\u00a0b \n c don't"


def _merger(path: str):
    """The encoder of the library tiktoken over the file's vocabulary, or None if its ids don't follow the order of
    its merges, which that library goes by."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    vocab, merges = own["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in own["model"]["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    back = {c: b for b, c in STANDINS.items()} | {chr(b): b for b in _PRINTABLE}
    special = {x["content"] for x in own.get("added_tokens", [])}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Chunks(dict):
    """From a text's chunk between two blanks, without them, to the ids of blank and chunk."""

    def __init__(self, encode):
        self.ids = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.ids(" " + chunk)).tobytes()
        if len(chunk) <= 32 and "\n" not in chunk:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class ChunkTokenizer:
    """Ids of whole texts, as the tokenizer's ``encode`` gives them. A byte-level BPE never joins what a single blank
    parts, so a text is cut at its blanks and the ids of the chunks, which repeat, are remembered; new chunks are merged
    over the same vocabulary by a faster library. Where that doesn't hold (two blanks in a row, a special token's name
    in the text, or a tokenizer of another kind, as its file and a probe show) the text is encoded as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = [x.content for x in self.inner.get_added_tokens_decoder().values()]
        try:
            merger = _merger(path)
        except (KeyError, ValueError, TypeError):  # a file of another kind
            merger = None
        self.chunks = _Chunks(merger.encode_ordinary) if merger else None
        self.chunked = bool(merger) and self._by_chunks(PROBE) == self._plain(PROBE)

    def _plain(self, text: str) -> bytes:
        return array("I", self.inner.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_chunks(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        return array("I", self.chunks.ids(first)).tobytes() + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """The ids, four little-endian bytes each."""
        if not text:
            return b""
        if not self.chunked or "  " in text or any(x in text for x in self.special):
            return self._plain(text)
        return self._by_chunks(text)


def cuts(n: int, settings: Settings) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    c = settings.capacity
    out, rest = [c] * (n // c), n % c
    while rest >= settings.least_cut:
        k = -(-(c + 1) // (rest + 1))  # the least k with c // k <= rest
        while c // k > rest:
            k += 1
        out.append(c // k)
        rest -= c // k
    return out + [rest] * (rest > 0)


def pieces(df: DataFrame, settings: Settings, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (doc, start, length, crc, total), each text tokenized once and whole."""
    kind = dict(df.select(F.col(id_col)).dtypes)[id_col]

    def apply(batches):
        tokenizer, end = ChunkTokenizer(settings.tokenizer), np.array([settings.end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs, rows = [], []
                for i, ids in enumerate(tokenizer.encode(x or "") for x in part.column(1).to_pylist()):
                    ids += end
                    start, total = 0, len(ids) // 4
                    for n in cuts(total, settings):
                        docs.append(i)
                        rows.append((start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total))
                        start += n
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs, pa.int64())), *(pa.array(x, pa.int64()) for x in zip(*rows))], names=["doc", "start", "length", "crc", "total"])

    return df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(apply, f"doc {kind}, start long, length long, crc long, total long")


def fill(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each of a worker's pieces (in their order)."""
    n = len(length)
    k = capacity // np.maximum(length, 1)
    order = np.argsort(k, kind="stable")
    ks, ls = k[order], length[order]
    first = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1]))) if n else np.zeros(0, np.int64)
    nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    fresh = nth % ks == 0 if n else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1  # pieces that share a sequence
    starts = np.flatnonzero(fresh)
    sums = np.add.reduceat(ls, starts) if n else np.zeros(0, np.int64)
    members = np.diff(np.append(starts, n))
    full = members == ks[starts]
    before = np.cumsum(ls) - ls
    offset = before - before[starts][group] if n else before
    # groups that their class leaves short share sequences
    target, shift = np.cumsum(full) - 1, np.zeros(len(starts), np.int64)
    bins: list[int] = []
    used = int(full.sum())
    for g in sorted(np.flatnonzero(~full).tolist(), key=lambda g: (-sums[g], g)):  # at most one for each class
        b = next((b for b, room in enumerate(bins) if room >= sums[g]), len(bins))
        if b == len(bins):
            bins.append(capacity)
        target[g], shift[g] = used + b, capacity - bins[b]
        bins[b] -= int(sums[g])
    sequence, place = np.empty(n, np.int64), np.empty(n, np.int64)
    sequence[order], place[order] = (target[group], offset + shift[group]) if n else (target, offset)
    return sequence, place


def pack(df: DataFrame, settings: Settings, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` (from 0,
    without gaps), ``offset``. Sequences have ``settings.capacity`` tokens, the unused ones are padding.

    Defined cases: null and empty texts have the end id alone; rows with the same id are packed each for itself, and
    equal rows fall into different workers' shares; an empty table gives an empty table; a null id stays null.
    """
    cut = shared_checkpoint(pieces(df, settings, text_col, id_col))  # texts are tokenized once
    shares = max(1, -(-cut.count() // SHARE))
    kind = dict(cut.dtypes)["doc"]

    def apply(share: pd.DataFrame) -> pd.DataFrame:
        share = share.sort_values(["doc", "start", "crc", "total"], kind="stable", ignore_index=True)
        sequence, offset = fill(share["length"].to_numpy(np.int64), settings.capacity)
        return share.assign(sequence=sequence, offset=offset)[["doc", "start", "length", "crc", "total", "share", "sequence", "offset"]]

    # equal pieces of repeated rows part by their places in the checkpoint, which fixes these
    dealt = cut.withColumn("share", F.pmod(F.xxhash64("doc", "start", "crc", F.monotonically_increasing_id()), F.lit(shares)))
    packed = shared_checkpoint(dealt.groupBy("share").applyInPandas(apply, f"doc {kind}, start long, length long, crc long, total long, share long, sequence long, offset long"))
    used = packed.groupBy("share").agg((F.max("sequence") + 1).alias("used"))
    first = used.select("share", (F.sum("used").over(Window.orderBy("share")) - F.col("used")).alias("first"))  # a row for SHARE pieces
    out = packed.join(first, "share")
    return out.select(F.col("doc").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset")
