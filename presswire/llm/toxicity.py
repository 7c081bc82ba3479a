"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores and offsets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import few, materialize, with_package

DOC_FEATURES = 3
PART = 400  # texts whose words a worker holds at once


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=50_000)
def token_features(token: str) -> tuple[str, ...]:
    """What a token (lower case, split at white space) is described by: its word and the word's beginnings."""
    word = "".join(c for c in token if c.isalnum())
    return (f"w{word}", f"4{word[:4]}", f"5{word[:5]}") if word else ()


@dataclass
class Tagger:
    """CRF weights (state toxic against clean) and the logistic layer over a document's marginals."""

    ids: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    extra: np.ndarray = field(default_factory=lambda: np.zeros(3))  # bias; a listed token before; one after
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(DOC_FEATURES + 1))
    empty: bool = True  # there was nothing to learn from

    def listed(self, token: str) -> list[int]:
        return [self.ids[f] for f in token_features(token) if f in self.ids]


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, pairwise marginals summed (2 x 2), and log Z, of many chains at once.

    emit, mask: (chains, steps); a chain is its first steps, where mask is true. Emissions are log odds; messages are
    kept normalised, so chains of any length stay in range.
    """
    n, steps = emit.shape
    e = np.clip(emit, -30, 30)
    odds = np.stack([1 / (1 + np.exp(e)), 1 / (1 + np.exp(-e))], axis=-1)  # normalised per step
    log_z = np.where(mask, np.logaddexp(0, e), 0).sum(axis=1)
    m = np.exp(trans)
    alpha = np.empty((n, steps, 2))
    for t in range(steps):
        a = odds[:, t] if t == 0 else (alpha[:, t - 1] @ m) * odds[:, t]
        if t:
            a = np.where(mask[:, t, None], a, alpha[:, t - 1])
        z = a.sum(axis=1, keepdims=True)
        log_z += np.where(mask[:, t], np.log(z[:, 0]), 0)
        alpha[:, t] = a / z
    beta = np.ones((n, 2))
    p = np.zeros((n, steps))
    pair = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        g = alpha[:, t] * beta
        p[:, t] = np.where(mask[:, t], g[:, 1] / g.sum(axis=1), 0)
        if t:
            right = odds[:, t] * beta
            both = alpha[:, t - 1, :, None] * m * right[:, None, :]
            both *= np.where(mask[:, t], 1 / both.sum(axis=(1, 2)), 0)[:, None, None]
            pair += both.sum(axis=0)
            b = right @ m.T
            beta = np.where(mask[:, t, None], b / b.sum(axis=1, keepdims=True), beta)
    return p, pair, log_z


def train_crf(features: np.ndarray, listed: np.ndarray, mask: np.ndarray, gold: np.ndarray, n_features: int, steps: int = 120, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conditional likelihood by Adam. features: (chains, steps, 3) feature ids or -1; listed, mask, gold: (chains, steps)."""
    before, after = np.zeros(mask.shape), np.zeros(mask.shape)
    before[:, 1:], after[:, :-1] = listed[:, :-1], listed[:, 1:]
    n_tokens = max(1, mask.sum())
    gold_pair = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(gold_pair, (gold[:, :-1][both].astype(int), gold[:, 1:][both].astype(int)), 1)
    w, flat = np.zeros(n_features + 3 + 4), np.where(features < 0, n_features, features)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        table = np.append(w[:n_features], 0.0)
        emit = table[flat].sum(axis=2) + w[n_features] + before * w[n_features + 1] + after * w[n_features + 2]
        p, pair, _ = forward_backward(emit, mask, w[-4:].reshape(2, 2))
        miss = np.where(mask, gold - p, 0)
        grad = np.concatenate(
            [
                np.bincount(flat.ravel(), weights=np.repeat(miss.ravel(), features.shape[2]), minlength=n_features + 1)[:n_features],
                [miss.sum(), (miss * before).sum(), (miss * after).sum()],
                (gold_pair - pair).ravel(),
            ]
        ) / n_tokens - l2 * w / 100
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w += 0.15 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.999**i)) + 1e-8)
    return w[:n_features], w[n_features : n_features + 3], w[-4:].reshape(2, 2)


def chains(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each token when documents are laid into chains of at most width tokens; number of chains."""
    n = -(-lengths // width)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.cumsum(n) - n, lengths) + inside // width, inside % width, int(n.sum())


def marginals(texts: list[str], tagger: Tagger, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The toxic marginal of every token of every text, one after the other, and each text's number of tokens."""
    tokens = [t.lower().split() for t in texts]
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    if not lengths.sum():
        return np.zeros(0), lengths
    codes, words = pd.factorize(np.array([w for t in tokens for w in t], dtype=object))
    ids = [tagger.listed(w) for w in words]
    weight = np.array([tagger.weights[i].sum() if i else 0.0 for i in ids])
    has = np.array([bool(i) for i in ids])
    row, col, n = chains(lengths, width)
    emit, listed, mask = np.zeros((n, width)), np.zeros((n, width)), np.zeros((n, width), dtype=bool)
    emit[row, col], listed[row, col], mask[row, col] = weight[codes], has[codes], True
    emit += tagger.extra[0]
    emit[:, 1:] += listed[:, :-1] * tagger.extra[1]
    emit[:, :-1] += listed[:, 1:] * tagger.extra[2]
    p, _, _ = forward_backward(emit, mask, tagger.trans)
    return p[row, col], lengths


def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), PART):
            yield batch.iloc[lo : lo + PART]


def document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: log odds that any token is toxic (noisy or), the highest marginal, expected toxic tokens (log)."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    clipped = np.clip(p, 0, 1 - 1e-9)
    none = np.bincount(owner, weights=np.log1p(-clipped), minlength=len(lengths))
    total = np.bincount(owner, weights=np.where(p > 0.05, p, 0), minlength=len(lengths))
    top = np.zeros(len(lengths))
    np.maximum.at(top, owner, p)
    return np.stack([np.minimum(-none, 20.0), top, np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 0.1) -> np.ndarray:
    """Newton's method; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - l2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def stretch_marginals(features: np.ndarray, listed: np.ndarray, mask: np.ndarray, tagger: Tagger) -> np.ndarray:
    """Marginals of train_crf()'s stretches under a tagger."""
    before, after = np.zeros(mask.shape), np.zeros(mask.shape)
    before[:, 1:], after[:, :-1] = listed[:, :-1], listed[:, 1:]
    emit = np.append(tagger.weights, 0.0)[features].sum(axis=2) + tagger.extra[0] + before * tagger.extra[1] + after * tagger.extra[2]
    return forward_backward(emit, mask, tagger.trans)[0]


def relabel(p: np.ndarray, kind: np.ndarray, likely: float = 0.2) -> np.ndarray:
    """Token labels from the tagger's own marginals p (chains, steps). kind, by chain: -1 of a clean text, where no token is toxic; 0 of a toxic
    text, where tokens of `likely` or more are; 1 of a toxic text and cut around a suspect token, where the likeliest is in any case."""
    out = (p >= likely) & (kind >= 0)[:, None]
    sure = np.flatnonzero(kind == 1)
    out[sure, p[sure].argmax(axis=1)] = True
    return out.astype(float)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, max_features: int = 4_000, max_chains: int = 20_000, width: int = 16, rounds: int = 2) -> Tagger:
    """Learn from at most fit_rows labelled documents that are not held out (those of least hash of doc_id).

    The tables label documents, not tokens, so token labels start from contrast: a feature (word, or beginning of words) that three or
    more toxic documents hold, and with far more different words than clean ones relative to their numbers, makes its tokens in toxic
    documents toxic; every other token is clean. (Words are counted since rare languages' toxic words share a beginning with clean ones: what
    tells is how many of them a text has.) The CRF is trained on stretches of width tokens of these documents, then relabels them: tokens that
    it finds likely in their context become toxic in toxic documents, others clean (relabel()), and is trained again, `rounds` times in all.
    The logistic layer is trained on the documents' marginals. Text is the only input.

    Labels that are null count as none; of labels that contradict each other toxic wins, also for equal texts. Of rows that repeat a
    labelled doc_id one text is learned from. Only features, stretches (max_chains + 2 fit_rows at most) and document sums of the bounded
    sample reach the driver.
    """
    with_package(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out())
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(materialize(few(known, fit_rows, "doc_id")))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = materialize(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(16))
    totals = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(True, 0), totals.get(False, 0)
    if not n1 or not n0:
        return Tagger()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            for toxic, texts in batch.groupby(batch["toxic"] > 0)["text"]:
                held, seen = Counter(), Counter()
                for t in texts:
                    own = Counter(f for fs in set(map(token_features, set(t.lower().split()))) for f in fs)
                    held.update(own.keys())
                    seen.update(own)
                yield pd.DataFrame({"feature": list(held), "toxic": int(toxic), "n": list(held.values()), "words": [seen[f] for f in held]})

    counts = rows.mapInPandas(count, "feature string, toxic int, n long, words long")
    counts = counts.groupBy("feature").agg(F.sum(F.col("n") * F.col("toxic")).alias("n1"), F.sum(F.col("words") * F.col("toxic")).alias("w1"), F.sum(F.col("words") * (1 - F.col("toxic"))).alias("w0"))
    ratio = ((F.col("w1") + 0.5) / (n1 + 1)) / ((F.col("w0") + 0.5) / (n0 + 1))
    strong = counts.where("n1 >= 3").withColumn("ratio", ratio).where("ratio >= 8").orderBy(F.desc(F.log("ratio") * F.sqrt("n1")), "feature").limit(max_features)
    ids = {r["feature"]: i for i, r in enumerate(strong.collect())}
    if not ids:
        return Tagger()
    tagger = Tagger(ids=ids, weights=np.zeros(len(ids)), empty=False)
    each = max(1, max_chains // (n1 + n0))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                tokens = text.lower().split()
                if not tokens:
                    continue
                found = [i for i, w in enumerate(tokens) if tagger.listed(w)]
                rng = np.random.default_rng(zlib.crc32(text.encode()))
                centres = [*rng.permutation(found)[:each], *rng.integers(len(tokens), size=1)]
                for k, c in enumerate(centres):
                    part = tokens[max(0, int(c) - width // 2) :][:width]
                    x = np.full((width, 3), -1, dtype=np.int32)
                    for j, w in enumerate(part):
                        f = tagger.listed(w)
                        x[j, : len(f)] = f
                    out.append((x.tobytes(), len(part), -1 if toxic <= 0 else int(k < len(centres) - 1)))
            yield pd.DataFrame(out, columns=["x", "n", "kind"])

    got = rows.mapInPandas(stretches, "x binary, n int, kind int").toPandas().sort_values(["x", "n", "kind"], ignore_index=True)
    x = np.stack([np.frombuffer(b, dtype=np.int32).reshape(width, 3) for b in got["x"]])
    mask, kind = np.arange(width)[None, :] < got["n"].to_numpy()[:, None], got["kind"].to_numpy()
    listed = (x >= 0).any(axis=2).astype(float)
    gold = listed * (kind >= 0)[:, None]
    for r in range(rounds):
        tagger.weights, tagger.extra, tagger.trans = train_crf(x, listed, mask, gold, len(ids))
        if r < rounds - 1:
            gold = relabel(stretch_marginals(x, listed, mask, tagger), kind)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            f = document_features(*marginals(batch["text"].tolist(), tagger))
            yield pd.DataFrame({"a": f[:, 0], "b": f[:, 1], "c": f[:, 2], "toxic": (batch["toxic"] > 0).to_numpy().astype(int)})

    seen = rows.mapInPandas(sums, "a double, b double, c double, toxic int").toPandas()  # fit_rows rows at most
    seen = seen.sort_values(["a", "b", "c", "toxic"])
    tagger.document = _logistic(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy().astype(float))
    return tagger


def scorer(tagger: Tagger, offset_from: float = 0.5, with_spans: bool = True):
    """A pandas UDF: text -> struct(score, spans), or the score alone. The tagger it carries has a bounded size (fit())."""
    token = re.compile(r"\S+")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, spans = [], []
            for lo in range(0, len(batch), PART):
                texts = batch.iloc[lo : lo + PART].tolist()
                if tagger.empty:
                    scores.append(np.zeros(len(texts)))
                    spans += [[] for _ in texts]
                    continue
                p, lengths = marginals(texts, tagger)
                z = document_features(p, lengths) @ tagger.document[:-1] + tagger.document[-1]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                start = 0
                for text, n in zip(texts, lengths.tolist(), strict=True) if with_spans else ():
                    hit = np.flatnonzero(p[start : start + n] >= offset_from)
                    at = [m.span() for m in token.finditer(text)] if len(hit) else []
                    spans.append([{"start": at[i][0], "end": at[i][1], "p": float(p[start + i])} for i in hit if i < len(at)])
                    start += n
            yield pd.DataFrame({"score": np.concatenate(scores) if scores else [], "spans": spans if with_spans else [[] for _ in range(len(batch))]})

    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in run(batches):
            yield frame["score"]

    return F.pandas_udf(run, "score double, spans array<struct<start:int,end:int,p:double>>") if with_spans else F.pandas_udf(plain, "double")


def score(docs: DataFrame, tagger: Tagger, offset_from: float = 0.5) -> DataFrame:
    """doc_id, score, spans: every whole text's score from 0 to 1 and its toxic tokens' offsets.

    A span has start and end in code points and the token's marginal, from offset_from on. Long texts are chains of 64 tokens
    one after the other, so memory is bounded by a batch of rows. Null and empty texts get the score of a text without toxic
    tokens and no spans; without training data of both classes every score is 0. Null doc_ids and repeated rows are rows
    like others; other columns are ignored. No shuffle.
    """
    with_package(docs.sparkSession)
    return docs.select("doc_id", scorer(tagger, offset_from)(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.score", "r.spans")


def drop_toxic(docs: DataFrame, tagger: Tagger, reject_from: float = 0.3) -> DataFrame:
    """docs, all columns, without the documents that score reject_from or more."""
    with_package(docs.sparkSession)
    return docs.where(scorer(tagger, with_spans=False)(F.coalesce("text", F.lit(""))) < reject_from)
