"""Suffix-array dedup: maximal repeats from the interval tree of common prefixes, in buckets of shared anchors.

A full suffix array of a corpus would ship every suffix. Here a repeat of at least `least` bytes is found by its anchors:
every window of that length picks one k-gram (the minimizer: least hash, leftmost), which depends on the window alone, so equal
windows in any two documents pick the same k-gram at the same place. Consecutive windows with one anchor form a
context. Contexts go to the bucket of their anchor's hash; all suffixes that can share a repeat meet there. In a bucket the
contexts' suffixes are sorted, adjacent common prefixes measured, and a stack scan walks the tree of intervals. Contexts of an
anchor that very many have are dealt by the hashes of their windows instead: equal windows meet, and the anchor is spread.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import materialize, with_package

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SENT = "task long, kind int, data binary"
KEYS, SPANS, CONTEXTS, WINDOWS, HOT_KEYS = 0, 1, 2, 3, 4
PLACE_BITS = 31  # of a place in a text; the bits above tell texts apart


@dataclass(frozen=True)
class Grain:
    """Lengths in bytes: of the least repeat, and of an anchor; a window holds least - anchor + 1 anchors. Contexts of an anchor are dealt by
    window if a batch has more than `often` different ones, or all batches together more than `hot`."""

    least: int = 50
    anchor: int = 20
    hot: int = 20_000
    often: int = 64

    @property
    def choices(self) -> int:
        return self.least - self.anchor + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of data[i : i + length] for every i that has so many bytes, by doubling."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, span, done = data.astype(np.uint64) + np.uint64(1), 1, 0
        out, base = None, BASE
        rest = length
        while rest:
            if rest & 1:
                part = power[done : done + n]
                out = part.copy() if out is None else out * base + part
                done += span
            rest >>= 1
            if rest:
                power = power[:-span] * base + power[span:]
                base, span = base * base, span * 2
    return out


def minimizers(h: np.ndarray, choices: int) -> np.ndarray:
    """For each run of `choices` hashes the index of the least, the leftmost if several are."""
    n = len(h) - choices + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    value, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while 2 * span <= choices:
        left = value[:-span] <= value[span:]
        value, at = np.where(left, value[:-span], value[span:]), np.where(left, at[:-span], at[span:])
        span *= 2
    shift = choices - span
    return np.where(value[:n] <= value[shift : shift + n], at[:n], at[shift : shift + n])


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, grain: Grain) -> dict[str, np.ndarray]:
    """Contexts of the documents data[starts : ends]: document index, lo (first byte, in data), hi (after the last), anchor (place in data),
    key of the anchor's bytes, and key of the whole context."""
    h = _mix(gram_hashes(data, grain.anchor))
    at = minimizers(h, grain.choices)
    ok = np.zeros(len(at) + 1, dtype=np.int32)
    long = ends - starts >= grain.least
    doc_of = np.flatnonzero(long)
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - grain.least + 1, -1)
    valid = np.cumsum(ok[:-1]) > 0
    first = np.zeros(len(at), dtype=bool)
    first[starts[long]] = True
    turn = valid & (first | np.append(True, at[1:] != at[:-1]))
    lo = np.flatnonzero(turn)
    if not len(lo):
        none = np.zeros(0, dtype=np.int64)
        return {"doc": none, "lo": none, "hi": none, "anchor": none, "key": none.astype(np.uint64), "whole": none.astype(np.uint64)}
    doc = doc_of[np.searchsorted(starts[long], lo, side="right") - 1]
    last = np.minimum(np.append(lo[1:], len(at)) - 1, ends[doc] - grain.least)
    window = gram_hashes(data, grain.least)
    with np.errstate(over="ignore"):
        whole = _mix(_mix(window[lo]) + _mix(window[last] + (last - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return {"doc": doc, "lo": lo, "hi": last + grain.least, "anchor": at[lo].astype(np.int64), "key": h[at[lo]], "whole": whole}


def text_tag(text: bytes) -> int:
    """What is added to places in a text: they then differ for different texts of rows that repeat a doc_id."""
    return zlib.crc32(text) << PLACE_BITS


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[0] .. starts[0] + lengths[0] - 1, then the next's, and so on."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    out = np.ones(int(lengths.sum()), dtype=np.int64)
    at = np.cumsum(lengths) - lengths
    out[at[0]] = starts[0]
    out[at[1:]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(out)


def planes(x: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers, all first bytes, then all second ones: small numbers and differences compress well so."""
    return np.ascontiguousarray(x).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8")[:, 0]


def pack(columns: list[np.ndarray], text: bytes = b"") -> bytes:
    """Integer columns of one length (the first as differences, so it should be sorted) and bytes, compressed."""
    first = np.diff(columns[0], prepend=0)
    head = np.array([len(first), len(columns)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(planes, [first, *columns[1:]])) + text)


def unpack(blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    n, width = raw[:16].view("<i8").tolist()
    columns = [unplanes(raw[16 + 8 * n * i :], n) for i in range(width)]
    columns[0] = np.cumsum(columns[0])
    return columns, raw[16 + 8 * n * width :]


def document_bucket(doc_id: np.ndarray, n: int) -> np.ndarray:
    """The same as document_bucket_column(), for numbers."""
    return np.mod(doc_id ^ (doc_id >> 16) ^ (doc_id >> 32), n)


def document_bucket_column(n: int) -> Column:
    """Where a document's rows meet; rows without doc_id are dealt by text."""
    d = F.col("doc_id").cast("long")
    own = F.pmod(d.bitwiseXOR(F.shiftright(d, 16)).bitwiseXOR(F.shiftright(d, 32)), F.lit(n))
    return F.coalesce(own, F.pmod(F.xxhash64("text"), F.lit(n)))


def span_rows(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> pd.DataFrame:
    """Spans as packed rows of SENT, one for each bucket of documents."""
    to = document_bucket(doc, n)
    order = np.lexsort((lo, doc, to))
    doc, lo, hi, to = doc[order], lo[order], hi[order], to[order]
    at = np.unique(to)
    cuts = np.searchsorted(to, at), np.searchsorted(to, at, side="right")
    return pd.DataFrame({"task": at, "kind": SPANS, "data": [pack([doc[i:j], lo[i:j], hi[i:j]]) for i, j in zip(*cuts, strict=True)]})


def merge(pairs: np.ndarray) -> np.ndarray:
    """Union of spans as sorted, disjoint, not touching ones."""
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > reach[:-1])
    begins = np.flatnonzero(new)
    return np.stack([pairs[begins, 0], reach[np.append(begins[1:], len(pairs)) - 1]], axis=1).astype(pairs.dtype)


def gather(ids: np.ndarray, texts: list[bytes], grain: Grain, wanted: np.ndarray | None = None, chunk: int = 1 << 18):
    """Contexts of a batch of documents (contexts()' columns and start, the document's place in data less its text_tag(); doc: its id), their
    bytes, and the spans settled here (doc, lo, hi; places with tags).

    A text, or a context, that a document of the batch with a smaller id has too is settled here: all of it is covered.
    Only those of the least id are returned, so whatever is frequent sends one row a batch. wanted: keep only contexts
    whose (document, short key) is among these numbers of pair_number().
    """
    seen: dict[bytes, int] = {}
    keep, settled = [], []
    for i in np.argsort(ids, kind="stable").tolist():
        if len(texts[i]) < grain.least:
            continue
        if seen.setdefault(texts[i], int(ids[i])) == ids[i]:
            keep.append(i)
        else:
            settled.append((ids[i], text_tag(texts[i]), text_tag(texts[i]) + len(texts[i])))
    seen.clear()
    found, pieces, part, base, size = [], [], [], 0, 0
    for i in [*keep, -1]:
        if part and (i < 0 or size + len(texts[i]) > chunk):
            joined = b"".join(texts[j] for j in part)
            lengths = np.array([len(texts[j]) for j in part], dtype=np.int64)
            ends = np.cumsum(lengths)
            c = contexts(np.frombuffer(joined, dtype=np.uint8), ends - lengths, ends, grain)
            tags = np.array([text_tag(texts[j]) for j in part], dtype=np.int64)
            c["start"] = (ends - lengths - tags)[c["doc"]]
            c["doc"] = ids[np.array(part)][c["doc"]]
            if wanted is not None:
                ok = np.isin(pair_number(c["doc"], short_key(c["key"])), wanted)
                c = {k: v[ok] for k, v in c.items()}
            for k in ("lo", "hi", "anchor", "start"):
                c[k] = c[k] + base
            found.append(c)
            if wanted is not None:
                pieces.append(joined)
                base += len(joined)
            part, size = [], 0
        if i >= 0:
            part.append(i)
            size += len(texts[i])
    done = np.array(settled, dtype=np.int64).reshape(-1, 3).T
    if not found:
        return None, b"", done
    c = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order = np.lexsort((c["doc"], c["whole"]))
    whole, doc = c["whole"][order], c["doc"][order]
    fresh = np.append(True, whole[1:] != whole[:-1])[: len(order)]
    least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    covered, send = order[doc != least], order[doc == least]
    done = np.hstack([done, np.stack([c["doc"][covered], (c["lo"] - c["start"])[covered], (c["hi"] - c["start"])[covered]])])
    return {k: v[send] for k, v in c.items()}, b"".join(pieces), done


def short_key(key: np.ndarray) -> np.ndarray:
    """40 of an anchor key's bits, others than those that choose its bucket; a clash only costs time."""
    return (key >> np.uint64(24)).astype(np.int64)


def pair_number(doc: np.ndarray, short: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + short.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def by_bucket(key: np.ndarray, n: int, *order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by bucket (key mod n), ordered inside it. The loop is over buckets that occur, never over all n, which grows with the input."""
    to = (key % np.uint64(n)).astype(np.int64)
    rows = np.lexsort((*order[::-1], to))
    at, begins = np.unique(to[rows], return_index=True)
    for b, i, j in zip(at.tolist(), begins, np.append(begins[1:], len(rows))[: len(at)], strict=True):
        yield b, rows[i:j]


def key_rows(ids: np.ndarray, texts: list[bytes], grain: Grain, n: int) -> Iterator[pd.DataFrame]:
    """SENT rows of a batch for the first round: documents and short keys of their anchors, for each bucket, and settled spans.

    An anchor that the batch alone shows to be hot is no question any more: its documents are told at once (HOT_KEYS), and its bucket
    gets one row for all of them (marked, which is 1). So a bucket gets at most grain.often rows of an anchor from a batch.
    """
    c, _, (doc, lo, hi) = gather(ids, texts, grain)
    if len(doc):
        yield span_rows(doc, lo, hi, n)
    if c is None:
        return
    doc, key = c["doc"], c["key"]
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(begins, len(key)))
    hot = np.repeat(times > grain.often, times)
    if hot.any():
        yield told_rows(doc[hot], short_key(key[hot]), (key[hot] % np.uint64(n)).astype(np.int64) + 1, n, HOT_KEYS)
    send = ~hot
    send[begins[times > grain.often]] = True
    doc, short, key, marked = doc[send], short_key(key[send]), key[send], hot[send].astype(np.int64)
    rows = [(b, KEYS, pack([doc[r], short[r], marked[r]])) for b, r in by_bucket(key, n, doc, short)]
    yield pd.DataFrame(rows, columns=["task", "kind", "data"])


def told_rows(doc: np.ndarray, short: np.ndarray, hot: np.ndarray, n: int, kind: int) -> pd.DataFrame:
    """SENT rows by bucket of documents: documents, short keys of their shared anchors, and 1 + bucket of hot anchors or 0."""
    to = document_bucket(doc, n)
    order = np.lexsort((short, doc, to))
    doc, short, hot, to = doc[order], short[order], hot[order], to[order]
    at = np.unique(to)
    cuts = np.searchsorted(to, at), np.searchsorted(to, at, side="right")
    return pd.DataFrame({"task": at, "kind": kind, "data": [pack([doc[i:j], short[i:j], hot[i:j]]) for i, j in zip(*cuts, strict=True)]})


def shared_keys(blobs: list[bytes], n: int, bucket: int, most: int) -> pd.DataFrame:
    """told_rows() for the documents that share an anchor with another one; an anchor is hot if it has more than `most` rows or a marked one."""
    parts = [unpack(b)[0] for b in blobs]
    doc, short, marked = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((doc, short))
    doc, short, marked = doc[order], short[order], marked[order]
    fresh = np.append(True, short[1:] != short[:-1])
    begins = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    told = np.maximum.reduceat(marked, begins) > 0
    several = (told | (doc[begins] != doc[np.append(begins[1:], len(doc)) - 1]))[of]
    hot = (told | (np.diff(np.append(begins, len(doc))) > most))[of]
    return told_rows(doc[several], short[several], hot[several] * (bucket + 1), n, KEYS)


def window_runs(doc: np.ndarray, where: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, lo, hi of the union of windows of `least` bytes."""
    order = np.lexsort((where, doc))
    doc, where = doc[order], where[order]
    begins = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (where[1:] - where[:-1] > least))[: len(doc)])
    return doc[begins], where[begins], where[np.append(begins[1:], len(doc))[: len(begins)] - 1] + least


def window_least(doc: np.ndarray, window: np.ndarray) -> np.ndarray:
    """For each row the least doc that has the same window."""
    _, index = np.unique(window, return_inverse=True)
    least = np.full(int(index.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, index, doc)
    return least[index]


def window_rows(doc: np.ndarray, where: np.ndarray, begin: np.ndarray, n_windows: np.ndarray, text: np.ndarray, grain: Grain, n: int) -> Iterator[pd.DataFrame]:
    """SENT rows of contexts of hot anchors (begin: place in text): windows by bucket, of each only the least document's, and settled spans."""
    inside = ragged(np.zeros(len(n_windows), dtype=np.int64), n_windows)
    window = _mix(gram_hashes(text, grain.least)[np.repeat(begin, n_windows) + inside])
    doc, where = np.repeat(doc, n_windows), np.repeat(where, n_windows) + inside
    again = doc > window_least(doc, window)
    if again.any():
        yield span_rows(*window_runs(doc[again], where[again], grain.least), n)
    doc, where, window = doc[~again], where[~again], window[~again]
    rows = [(b, WINDOWS, pack([doc[r], where[r], window[r].view(np.int64)])) for b, r in by_bucket(window, n, doc, where)]
    yield pd.DataFrame(rows, columns=["task", "kind", "data"])


def window_spans(blobs: list[bytes], grain: Grain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, lo, hi: windows of a bucket that documents of smaller ids have too."""
    parts = [unpack(b)[0] for b in blobs]
    doc, where, window = (np.concatenate([p[i] for p in parts]) for i in range(3))
    again = doc > window_least(doc, window)
    return window_runs(doc[again], where[again], grain.least)


def context_rows(ids: np.ndarray, texts: list[bytes], keys: list[bytes], grain: Grain, n: int) -> Iterator[pd.DataFrame]:
    """SENT rows of a bucket of documents for the second round: the contexts of their shared anchors (of hot ones the windows), and
    settled spans."""
    parts = [unpack(b)[0] for b in keys]
    doc, short, hot = (np.concatenate([p[i] for p in parts]) for i in range(3))
    has = np.isin(ids, doc)
    c, data, (done, lo, hi) = gather(ids[has], [t for t, ok in zip(texts, has, strict=True) if ok], grain, np.unique(pair_number(doc, short)))
    if len(done):
        yield span_rows(done, lo, hi, n)
    if c is not None and len(c["doc"]):
        text = np.frombuffer(data, dtype=np.uint8)
        if hot.any():
            pairs = pair_number(pair_number(doc, short)[hot > 0], hot[hot > 0])
            is_hot = np.isin(pair_number(pair_number(c["doc"], short_key(c["key"])), (c["key"] % np.uint64(n)).astype(np.int64) + 1), pairs)
            h, c = ({k: v[m] for k, v in c.items()} for m in (is_hot, ~is_hot))
            if len(h["doc"]):
                yield from window_rows(h["doc"], h["lo"] - h["start"], h["lo"], h["hi"] - h["lo"] - grain.least + 1, text, grain, n)
        where, length = c["lo"] - c["start"], c["hi"] - c["lo"]
        rows = [
            (b, CONTEXTS, pack([c["doc"][r], where[r], length[r], (c["anchor"] - c["lo"])[r]], text[ragged(c["lo"][r], length[r])].tobytes()))
            for b, r in by_bucket(c["key"], n, c["doc"], where)
        ]
        yield pd.DataFrame(rows, columns=["task", "kind", "data"])


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the maximal repeats of an enhanced suffix array, as ranges of suffixes, by a stack scan.

    lcp[i]: common prefix of suffixes i - 1 and i (lcp[0] = 0); left[i]: what stands before suffix i, or a number below 0 where it
    is not known, which differs from everything. An interval of the tree is a repeat that cannot be extended to the right; it is
    maximal if its suffixes differ on the left too. Equal left neighbours are passed up as one value, others as None.
    """
    n = len(lcp)
    stack: list[list] = []  # [length, first, left value or None if several]
    values, depths = left.tolist(), lcp.tolist()
    for i in range(1, n + 1):
        depth = depths[i] if i < n else 0
        first, carry = i - 1, values[i - 1] if values[i - 1] >= 0 else None
        while stack and stack[-1][0] > depth:
            length, begin, value = stack.pop()
            value = value if value == carry else None
            if value is None:
                yield length, begin, i - 1
            first, carry = begin, value
        if depth >= least:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != carry:
                    stack[-1][2] = None
            else:
                stack.append([depth, first, carry])
        else:
            stack.clear()


def bucket_repeats(blobs: list[bytes], grain: Grain) -> tuple[dict[str, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]]:
    """The contexts of a bucket that share an anchor with another document, and the repeat groups among them.

    contexts: doc, where (of the context in the document), length, same (number of the distinct context), least (least doc of it).
    groups: (length, distinct contexts, places in them) of each maximal repeat: all its occurrences.
    """
    parts = [unpack(b) for b in blobs]
    doc, where, length, anchor = (np.concatenate([p[0][i] for p in parts]) for i in range(4))
    text = np.concatenate([p[1] for p in parts])
    start = np.cumsum(length) - length
    none: dict[str, np.ndarray] = {k: np.zeros(0, dtype=np.int64) for k in ("doc", "where", "length", "same", "least")}
    gram = gram_hashes(text, grain.anchor)[start + anchor]
    # Contexts whose anchor a second document has.
    order = np.lexsort((doc, gram))
    g, d = gram[order], doc[order]
    fresh = np.append(True, g[1:] != g[:-1])
    group = np.cumsum(fresh) - 1
    begins = np.flatnonzero(fresh)
    several = d[begins] != d[np.append(begins[1:], len(d)) - 1]
    pick = order[several[group]]
    if not len(pick):
        return none, []
    # Of these, windows that a second document has; contexts without any are left out.
    n_windows = length[pick] - grain.least + 1
    window = gram_hashes(text, grain.least)[ragged(start[pick], n_windows)]
    owner = np.repeat(np.arange(len(pick)), n_windows)
    order = np.argsort(window, kind="stable")
    w, o = window[order], doc[pick][owner[order]]
    fresh = np.append(True, w[1:] != w[:-1])
    begins = np.flatnonzero(fresh)
    low, high = np.minimum.reduceat(o, begins), np.maximum.reduceat(o, begins)
    shared = np.empty(len(w), dtype=bool)
    shared[order] = (low != high)[np.cumsum(fresh) - 1]
    window_class = np.empty(len(w), dtype=np.int64)
    window_class[order] = np.cumsum(fresh) - 1
    useful = np.zeros(len(pick), dtype=bool)
    useful[owner[shared]] = True
    if not useful.any():
        return none, []
    # Distinct contexts.
    first_window = np.cumsum(n_windows) - n_windows
    last_window = first_window + n_windows - 1
    order = np.lexsort((doc[pick], window_class[last_window], window_class[first_window], n_windows))
    order = order[useful[order]]
    a, b, c = n_windows[order], window_class[first_window[order]], window_class[last_window[order]]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
    same = np.cumsum(fresh) - 1
    begins = np.flatnonzero(fresh)
    rows = pick[order]
    out = {"doc": doc[rows], "where": where[rows], "length": length[rows], "same": same, "least": doc[rows][begins][same]}
    lead = order[begins]  # a row of pick for each distinct context
    # Suffixes of distinct contexts that start a shared window, sorted by window, then by the bytes after it.
    many = ragged(first_window[lead], n_windows[lead])
    which = np.repeat(np.arange(len(lead)), n_windows[lead])
    inside = many - np.repeat(first_window[lead], n_windows[lead])
    ok = shared[many]
    many, which, inside = many[ok], which[ok], inside[ok]
    cls = window_class[many]
    times = np.bincount(cls, minlength=int(cls.max(initial=0)) + 1)
    ok = times[cls] > 1  # else the window's documents all share one context, which `least` settles
    which, inside, cls = which[ok], inside[ok], cls[ok]
    groups: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(cls):
        begin = start[pick[lead]][which] + inside
        tail = length[pick[lead]][which] - inside - grain.least
        width = int(tail.max()) if len(tail) else 0
        padded = np.append(text, np.zeros(grain.least + width + 8, dtype=np.uint8))
        after = np.zeros((len(cls), -(-max(width, 1) // 8) * 8), dtype=np.uint8)
        column = np.arange(width)
        for k in column:
            after[:, k] = np.where(tail > k, padded[begin + grain.least + k], 0)
        keys = after.view(">u8").astype(np.uint64)
        order = np.lexsort((tail, *[keys[:, i] for i in range(keys.shape[1] - 1, -1, -1)], cls))
        after, tail, cls, which, inside, begin = after[order], tail[order], cls[order], which[order], inside[order], begin[order]
        differ = after[1:] != after[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), after.shape[1])
        common = np.minimum(common, np.minimum(tail[1:], tail[:-1]))
        same_window = cls[1:] == cls[:-1]
        lcp = np.append(0, np.where(same_window, grain.least + common, 0))
        left = np.where(inside > 0, padded[begin - 1].astype(np.int64), -1)
        groups = [(n, which[i : j + 1], inside[i : j + 1]) for n, i, j in maximal_repeats(lcp, left, grain.least)]
    return out, groups


def bucket_spans(blobs: list[bytes], grain: Grain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, lo, hi: what the documents of a bucket share with documents of smaller ids."""
    c, groups = bucket_repeats(blobs, grain)
    docs, los, his = [], [], []
    again = c["doc"] > c["least"]  # the whole context stands in a smaller document
    docs.append(c["doc"][again]), los.append(c["where"][again]), his.append((c["where"] + c["length"])[again])
    if groups:
        n_same = int(c["same"].max()) + 1
        begins = np.searchsorted(c["same"], np.arange(n_same + 1))
        least = c["least"][begins[:-1]]
        size = np.array([len(g[1]) for g in groups])
        which, inside = np.concatenate([g[1] for g in groups]), np.concatenate([g[2] for g in groups])
        long = np.repeat([g[0] for g in groups], size)
        low = np.repeat(np.minimum.reduceat(least[which], np.cumsum(size) - size), size)
        n = (begins[1:] - begins[:-1])[which]
        row = ragged(begins[which], n)  # every occurrence of the distinct contexts
        lo = c["where"][row] + np.repeat(inside, n)
        hit = c["doc"][row] > np.repeat(low, n)
        docs.append(c["doc"][row][hit]), los.append(lo[hit]), his.append((lo + np.repeat(long, n))[hit])
    return np.concatenate(docs), np.concatenate(los), np.concatenate(his)


def repeated_spans(docs: DataFrame, grain: Grain, batch_bytes: int = 8 << 20, bucket_bytes: int = 5 << 20) -> tuple[DataFrame, int]:
    """task, data: packed spans of bytes that smaller documents have in repeats of grain.least or more, by bucket of documents; number of buckets.

    Two rounds. The first sends 40 bits for each anchor to the anchor's bucket and learns which ones two documents share. The second sends
    the contexts of those alone and works on their suffixes; those of hot anchors (Grain) go by window. Buckets grow in number with
    the input, not in size, but for the first round's numbers: at most grain.often pairs of numbers of an anchor from each batch.
    """
    with_package(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, total // bucket_bytes) | 1

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for frame in key_rows(np.array(ids, dtype=np.int64), texts, grain, n):
                yield pa.RecordBatch.from_arrays([pa.array(frame["task"], pa.int64()), pa.array(frame["kind"], pa.int32()), pa.array(frame["data"], pa.binary())], ["task", "kind", "data"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):  # one row at a time: a batch's texts are not copied as a whole
                ids.append(doc.as_py()), texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= batch_bytes:
                    yield from sent()
                    ids, texts, size = [], [], 0
        if ids:
            yield from sent()

    def first_round(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return shared_keys(frame["data"].tolist(), n, int(key[1]), grain.hot) if key[0] == KEYS else frame

    keyed = rows.where("doc_id is not null and text is not null").mapInArrow(send_keys, SENT)
    first = materialize(keyed.groupBy("kind", "task").applyInPandas(lambda k, f: first_round(k, f), SENT))

    def send_contexts(docs: pa.Table, keys: pa.Table) -> pa.Table:
        frames = []
        if len(keys) and len(docs):
            docs = docs.filter(pa.compute.and_(docs["doc_id"].is_valid(), docs["text"].is_valid()))
            ids, texts = docs["doc_id"].to_numpy(), [t.encode() for t in docs["text"].to_pylist()]
            frames = list(context_rows(ids, texts, keys["data"].to_pylist(), grain, n))
        frame = pd.concat(frames) if frames else pd.DataFrame({"task": [], "kind": [], "data": []})
        return pa.table({"task": pa.array(frame["task"], pa.int64()), "kind": pa.array(frame["kind"], pa.int32()), "data": pa.array(frame["data"], pa.binary())})

    def second_round(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] == SPANS:
            return frame
        return span_rows(*(bucket_spans if key[0] == CONTEXTS else window_spans)(frame["data"].tolist(), grain), n)

    placed = place(rows, n)
    sent = placed.groupBy("task").cogroup(first.where(F.col("kind").isin(KEYS, HOT_KEYS)).groupBy("task")).applyInArrow(send_contexts, SENT)
    second = sent.groupBy("kind", "task").applyInPandas(lambda k, f: second_round(k, f), SENT)
    spans = first.where(F.col("kind") == SPANS).unionByName(second)
    return spans.select("task", "data"), n


def place(docs: DataFrame, n: int) -> DataFrame:
    """docs with their bucket. Both uses in dedup() have this same plan, so that Spark shuffles the texts once and reads them twice."""
    return docs.select("doc_id", "text", document_bucket_column(n).alias("task"))


def _without(data: bytes, pairs: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of data, the number of bytes removed, and of maximal runs."""
    pairs = merge(np.minimum(pairs, len(data)))
    pairs = pairs[pairs[:, 1] > pairs[:, 0]]
    edges = [0, *pairs.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs)


def _cut(docs: pa.Table, spans: pa.Table) -> Iterator[tuple[bytes, int, int] | None]:
    """Of each document what _without() says; None if nothing is cut."""
    parts = [unpack(b)[0] for b in spans["data"].to_pylist()] if len(spans) else []
    if parts:
        doc, lo, hi = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(doc, kind="stable")
        doc, pairs = doc[order], np.stack([lo[order], hi[order]], axis=1)
    for d, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        i, j = (np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")) if parts and d is not None else (0, 0)
        if j == i or not text:
            yield None
            continue
        data = text.encode()
        own = pairs[i:j] - text_tag(data)
        own = own[(own[:, 0] >= 0) & (own[:, 1] <= len(data))]
        yield _without(data, own) if len(own) else None


def dedup(docs: DataFrame, grain: Grain = Grain()) -> DataFrame:
    """Cut from each text (as UTF-8 bytes) all that a document of smaller doc_id has too, in repeats of grain.least bytes or more.

    Every byte covered by a string of grain.least bytes that also starts in a document of smaller doc_id goes; strings are
    judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256.
    Null text counts as empty. Rows without doc_id keep all and cover nothing. Rows that repeat a doc_id cover nothing in each other; each is
    cut by its own text. Texts shorter than grain.least stay whole. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    spans, n = repeated_spans(rows, grain)

    def digest(docs: pa.Table, spans: pa.Table) -> pa.Table:
        out = []
        for text, cut in zip(docs["text"].to_pylist(), _cut(docs, spans), strict=True):
            data = (text or "").encode()
            kept, removed, runs = cut or (data, 0, 0)
            out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([docs["doc_id"].cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return place(rows, n).groupBy("task").cogroup(spans.groupBy("task")).applyInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, grain: Grain = Grain()) -> DataFrame:
    """docs, all columns, each text cut as dedup() says. Where a cut splits a character, its bytes that are left go too."""
    spans, n = repeated_spans(docs, grain)
    names = docs.columns

    def cut(rows: pa.Table, spans: pa.Table) -> pa.Table:
        docs = pa.Table.from_struct_array(rows["_row"])
        old = docs["text"].to_pylist()
        new = [text if c is None else c[0].decode("utf-8", "ignore") for text, c in zip(old, _cut(docs, spans), strict=True)]
        return docs.set_column(names.index("text"), "text", pa.array(new, pa.string()))

    placed = docs.select(document_bucket_column(n).alias("_bucket"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    return placed.groupBy("_bucket").cogroup(spans.withColumnRenamed("task", "_bucket").groupBy("_bucket")).applyInArrow(cut, docs.schema)
