"""Encoding of a corpus with a public byte-level BPE tokenizer.

Ordinary texts are encoded where they lie, one Arrow batch at a time, without a shuffle. A text with a very long stretch
that the split pattern leaves in one piece (cuneiform without spaces, base64, a row of dashes) goes another way: the
piece is cut into leaves of bytes that are encoded in parallel, and neighbouring results are joined as a tree. At each
join the tokens around the seam are re-encoded in a window that grows until both sides agree with it: the join is exact
as soon as the token pairs at both ends of the window are what the tokenizer gives for these two tokens' bytes, because a
sequence of tokens is the encoding of its bytes if and only if each neighbouring pair is.

Defined results
---------------
* a null and an empty text give an empty list; a blank text is encoded as it stands; special tokens are ordinary text;
* every row comes out once, whether its key or its text is repeated or not, and however long its pieces are; an empty table
  gives no rows; other columns are dropped.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellgrid.session import ship

#: Folder of the public vocabulary files, and the vocabulary by default.
FOLDER = os.environ.get("TELLGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a leaf; a stretch at least so long (in characters) sends its text the long way.
LEAF = 16_384

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Joiner:
    """Exact concatenation of encodings of neighbouring byte strings."""

    def __init__(self, enc) -> None:
        self.enc, self.pairs = enc, {}

    def piece(self, data: bytes) -> list[int]:
        return self.enc._encode_single_piece(data) if data else []

    def fits(self, a: int, b: int) -> bool:
        if (a, b) not in self.pairs:
            data = self.enc.decode_single_token_bytes(a) + self.enc.decode_single_token_bytes(b)
            self.pairs[a, b] = self.piece(data) == [a, b]
        return self.pairs[a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            seam = left[-reach:] + right[:reach]
            window = self.piece(b"".join(map(self.enc.decode_single_token_bytes, seam)))
            before, after = left[:-reach], right[reach:]
            if (not before or self.fits(before[-1], window[0])) and (not after or self.fits(window[-1], after[0])):
                return before + window + after
            reach *= 2

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            paired = [self.join(a, b) for a, b in zip(leaves[::2], leaves[1::2])]
            leaves = paired + leaves[len(leaves) & ~1 :]
        return leaves[0] if leaves else []


def _is_long(text: Column, leaf: int) -> Column:
    stretch = rf"\p{{L}}{{{leaf},}}|\p{{N}}{{{leaf},}}|[^\s\p{{L}}\p{{N}}]{{{leaf},}}|\s{{{leaf},}}"
    return (F.length(text) >= leaf) & text.rlike(stretch)


def _ids(path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            found = [enc.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(x) for x in found), np.int32, len(found))
            if count_only:
                values = pa.array(sizes)
            else:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["key", "ids"])

    return run


def _leaves(path: str, leaf: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        split = regex.compile(PATTERN)
        for batch in batches:
            for number, text in enumerate(batch["text"]):
                rows, plain = [], []
                segment = 0

                def close() -> None:
                    # white space before a long piece was split with that piece in view, so it must not end a joint text
                    nonlocal segment
                    spaces = []
                    while plain and plain[-1].isspace():
                        spaces.append(plain.pop())
                    if plain:
                        rows.append((segment, 0, False, "".join(plain).encode()))
                        plain.clear()
                        segment += 1
                    for space in reversed(spaces):
                        rows.append((segment, 0, True, space.encode()))
                        segment += 1

                for m in split.finditer(text):
                    if m.end() - m.start() < leaf // 4:
                        plain.append(m.group())
                        continue
                    close()
                    data = m.group().encode()
                    rows += [(segment, i, True, data[i * leaf : (i + 1) * leaf]) for i in range(-(-len(data) // leaf))]
                    segment += 1
                close()
                own = batch.iloc[[number] * len(rows)][["key", "mark", "times"]].reset_index(drop=True)
                yield pd.concat([own, pd.DataFrame(rows, columns=["segment", "leaf", "raw", "data"])], axis=1)

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            ids = [
                enc._encode_single_piece(bytes(data)) if raw else enc.encode_ordinary(bytes(data).decode())
                for raw, data in zip(batch["raw"], batch["data"])
            ]
            yield batch[["key", "mark", "times", "segment", "leaf"]].assign(ids=ids)

    return run


def _grow(path: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        joiner = Joiner(encoder(path))
        ids: list[int] = []
        for _, part in group.sort_values(["segment", "leaf"]).groupby("segment", sort=True):
            ids += joiner.tree([list(x) for x in part["ids"]])
        return group[["key", "times"]].iloc[:1].assign(ids=[ids])

    return run


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, leaf: int = LEAF, count_only: bool = False) -> DataFrame:
    """``key`` and the token ids of ``text`` as array<int> named ids (with ``count_only``: their number as int)."""
    ship(df.sparkSession)
    path = path or os.path.join(FOLDER, VOCABULARY)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    long = F.coalesce(_is_long(F.col("text"), leaf), F.lit(False))
    short = rows.filter(~long).mapInArrow(_ids(path, count_only), f"key {kind}, ids {'int' if count_only else 'array<int>'}")
    # a repeated key may have several long texts, and each may be there several times
    own, kept = f"key {kind}, mark string, times bigint", ["key", "mark", "segment", "leaf"]
    parts = (
        rows.filter(long).groupBy("key", "text").agg(F.count(F.lit(1)).alias("times"))
        .select("key", F.sha2("text", 256).alias("mark"), "times", "text")
        .mapInPandas(_leaves(path, leaf), f"{own}, segment int, leaf int, raw boolean, data binary")
        .repartition(*kept)
        .mapInPandas(_encode_leaves(path), f"{own}, segment int, leaf int, ids array<int>")
    )
    grown = parts.groupBy("key", "mark").applyInPandas(_grow(path), f"key {kind}, times bigint, ids array<int>")
    grown = grown.select("key", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("key", "ids")
    if count_only:
        grown = grown.select("key", F.size("ids").alias("ids"))
    return short.unionByName(grown).withColumnRenamed("key", key)
