"""Packing documents into token sequences by swap-based local search."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import bucket, materialize, with_package

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: What a tokenizer file must say for the fast path, and how it then parts texts (the pattern that use_regex stands for).
FAST = {
    "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_fast(spec: dict) -> bool:
    """The file is a plain byte-level BPE whose merges come in the order of their tokens' ids, so that ranks are ids."""
    model = spec["model"]
    if any(spec.get(k) != FAST[k] for k in ("normalizer", "pre_tokenizer")) or any(model.get(k, v) != v for k, v in FAST["model"].items()):
        return False
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return all(a < b for a, b in zip([-1, *made], made, strict=False))


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the tokenizer file at path, as the tokenizers library gives them.

    If is_fast(), vocabulary and merges are also run through tiktoken, which gives the same ids several times faster; a text that holds
    the string of an added token goes to tokenizers itself, as every text does for another kind of file.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not is_fast(spec):
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    added = [t["content"] for t in spec.get("added_tokens", [])]
    # Byte-level BPE writes a byte as itself where it is printable, else as the next code point from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(ids: list[int], capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; only the first may be shorter than the capacity."""
    data = np.asarray(ids, dtype="<u4")
    first = len(data) % capacity or min(capacity, len(data))
    start, end = 0, first
    while start < len(data):
        yield start, end - start, zlib.crc32(data[start:end].tobytes())
        start, end = end, end + capacity


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of each document (PIECES): its ids and end_id, cut only if longer than the capacity. Null text is empty."""
    with_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for batch in batches:
            out = [
                (doc, i, start, length, crc)
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                for i, (start, length, crc) in enumerate(cut([*encode(text), end_id], capacity))
            ]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes; longest first, each into the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r left
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + ((fitting & -fitting).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


def empty_bins(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: moves and swaps between underfull bins, each raising the sum of squared fills, until bins empty.

    From the emptiest bin on, a document moves into the fullest bin with room, else is exchanged for a shorter one, two
    of them for a shorter one, or one for two shorter ones together. Each step fills the other bin closer to the
    capacity and leaves less to place; the search ends when a round finds no step. What is tried is a neighbourhood (_best_step()):
    a search is no proof that fewer bins are impossible.
    """
    bins = [list(b) for b in bins]
    fill = np.array([sum(int(lengths[i]) for i in b) for b in bins], dtype=np.int64)
    steps = 1
    while steps:
        steps = 0
        for b in np.argsort(fill, kind="stable").tolist():
            if not 0 < fill[b] < capacity:
                continue
            while fill[b]:
                others = np.flatnonzero((fill < capacity) & (fill >= fill[b]) & (np.arange(len(bins)) != b))
                if not len(others):
                    break
                step = _best_step(b, others, bins, fill, lengths, capacity)
                if step is None:
                    break
                give, c, take = step
                gain = int(lengths[give].sum()) - int(lengths[take].sum() if take else 0)
                bins[b] = [i for i in bins[b] if i not in give] + take
                bins[c] = [i for i in bins[c] if i not in take] + give
                fill[b] -= gain
                fill[c] += gain
                steps += 1
    return [b for b in bins if b]


def _best_step(b: int, others: np.ndarray, bins: list[list[int]], fill: np.ndarray, lengths: np.ndarray, capacity: int):
    """The (given, other bin, taken) that leaves the other bin fullest. Since it is as full or fuller, squares grow.

    Every document of b is tried for a move, its 8 longest for an exchange, pairs of its 6 longest for two for one, and its 4 longest against
    pairs of another bin's 8 shortest.
    """
    room = capacity - fill[others]
    mine = sorted(bins[b], key=lambda i: -int(lengths[i]))
    for i in mine:  # move
        ok = np.flatnonzero(room >= lengths[i])
        if len(ok):
            return [i], int(others[ok[np.argmin(room[ok])]]), []
    item = np.array([i for c in others for i in bins[c]], dtype=np.int64)
    owner = np.array([k for k, c in enumerate(others) for _ in bins[c]], dtype=np.int64)
    size, slack = lengths[item], room[owner]

    def exchange(n: int):
        ok = np.flatnonzero((size < n) & (n - size <= slack))
        return (int(slack[k] - (n - size[k])), k) if len(ok) and (k := int(ok[np.argmin(slack[ok] - (n - size[ok]))])) >= 0 else None

    options = []
    for i in mine[:8]:  # one for one
        if found := exchange(int(lengths[i])):
            options.append((found[0], [i], found[1]))
    for x, i in enumerate(mine[:6]):  # two for one
        for j in mine[x + 1 : 6]:
            if found := exchange(int(lengths[i] + lengths[j])):
                options.append((found[0], [i, j], found[1]))
    if options:
        _, give, k = min(options, key=lambda o: (o[0], o[1]))
        return give, int(others[owner[k]]), [int(item[k])]
    for i in mine[:4]:  # one for two shorter ones of one bin
        for k, c in enumerate(others.tolist()):
            small = sorted((t for t in bins[c] if lengths[t] < lengths[i]), key=lambda t: int(lengths[t]))[:8]
            for x, s in enumerate(small):
                for t in small[x + 1 :]:
                    gain = int(lengths[i] - lengths[s] - lengths[t])
                    if 0 < gain <= room[k]:
                        return [i], c, [s, t]
    return None


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group_size: int = 8192) -> DataFrame:
    """Pack documents (doc_id, text) into as few sequences of at most capacity tokens as the search finds.

    Only documents longer than the capacity are cut. Full pieces are sequences alone. The others are dealt at random to
    groups of about group_size pieces; each group is packed by best fit, then by local search. The sequences of all groups that are
    less than 63/64 full are broken up, dealt to new groups and searched once more, so that no group keeps a poor remainder.
    A group's size does not depend on the input's, nor does any group hold equal keys together.

    Returns PIECES and sequence_id, offset. Null text: one piece of end_id alone; an empty table: no rows; repeated rows
    are documents of their own; other columns are ignored.
    """
    with_package(docs.sparkSession)
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
    schema = f"{PIECES}, uid long, sequence_id long, offset long, fill long"

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid", ignore_index=True)
        lengths = frame["length"].to_numpy(dtype=np.int64)
        bins = empty_bins(best_fit(lengths, capacity), lengths, capacity)
        order = np.array([i for b in bins for i in b], dtype=np.int64)
        out = frame.iloc[order].reset_index(drop=True)
        n = np.array([len(b) for b in bins])
        head = np.cumsum(n) - n
        at = np.cumsum(lengths[order]) - lengths[order]
        out["sequence_id"] = np.repeat(out["uid"].to_numpy()[head], n)
        out["offset"] = at - np.repeat(at[head], n)
        out["fill"] = np.repeat(np.add.reduceat(lengths[order], head), n)
        return out[[*columns, "sequence_id", "offset", "fill"]]

    def packed(rows: DataFrame, seed: int) -> DataFrame:
        n = max(1, -(-rows.count() // group_size))
        return materialize(rows.withColumn("group", bucket(n, "uid", seed=seed)).groupBy("group").applyInPandas(lambda f: search(f[columns]), schema))

    first = packed(pieces.where(F.col("length") < capacity), seed=1)
    poor = F.col("fill") < capacity - capacity // 64
    second = packed(first.where(poor).select(*columns), seed=2)
    full = pieces.where(F.col("length") == capacity).select(*columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = first.where(~poor).drop("fill").unionByName(second.drop("fill")).unionByName(full)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
