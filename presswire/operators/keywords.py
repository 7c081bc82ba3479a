"""Statistical keywords: the published unsupervised scorer that weighs a term's casing, place, frequency, spread and neighbours within one text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.operators.store import cut
from presswire.session import with_package

# Words that begin or end no keyword; terms of fewer than three letters count among them.
STOP = [
    "the", "and", "for", "with", "from", "that", "this", "are", "was", "were", "has", "have", "had", "not", "but", "his", "her", "its", "their", "they", "you", "our", "who", "which", "will", "would", "can", "could",
    "been", "than", "then", "there", "when", "what", "into", "also", "more", "over", "about", "after", "such",
]
NEVER = frozenset(STOP)
SENTENCES, WORDS = r"[.!?\n]+", r"[\p{L}\p{N}]+"


PART = 200  # texts that are counted at once
TERMS, FOUND = "terms array<struct<term string, tf long, score double>>", "found array<struct<keyword string, n long, score double>>"


def words(docs: DataFrame, key: str, text: str, few: int = 200_000) -> DataFrame:
    """key, texts (array of texts, each an array of sentences, each an array of words) of texts of 20 characters or more. A text is one row, so nothing is
    shuffled; only texts that share a key are brought together, and count as one text whose sentences have the numbers that they have in their own.
    Keys that texts share are sent to every task if they are few; else all texts are grouped. Either way a text is shuffled once at most."""
    long = docs.select(F.col(key), F.col(text).alias("t")).where(F.col(key).isNotNull() & (F.length("t") >= 20))
    again = cut(long.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    n_again, grouped = again.count(), lambda texts: texts.groupBy(key).agg(F.collect_list("t").alias("ts"))
    if n_again > few:
        rows = grouped(long)
    else:
        rows = long.select(key, F.array("t").alias("ts"))
        if n_again:
            again = F.broadcast(again)
            rows = rows.join(again, key, "left_anti").unionByName(grouped(long.join(again, key, "left_semi")))
    sentences = lambda t: F.transform(F.split(t, SENTENCES), lambda s: F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)))
    return rows.select(key, F.transform("ts", sentences).alias("texts"))


class Words(NamedTuple):
    """Words that stand one after the other: term (place in terms, which are in lower case), number of the sentence in its text, whether it is in upper
    case, begins with a capital inside a sentence, is valid to begin or end a keyword, is the first of its sentence."""

    terms: pa.Array
    term: np.ndarray
    sent: np.ndarray
    upper: np.ndarray
    capital: np.ndarray
    valid: np.ndarray
    first: np.ndarray


def is_number(word: str) -> bool:
    return word.isdigit() if word.isascii() else all(category(c)[0] == "N" for c in word)


def read_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of a column of words(), and how many each of its rows has. What depends on a word alone is asked once for each different one."""
    count = lambda a: pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    by_text = texts.flatten()
    by_sentence = by_text.flatten()
    n_texts, n_sentences, n_words = count(texts), count(by_text), count(by_sentence)
    some = n_words > 0  # only sentences that have words are numbered
    seen = np.append(0, np.cumsum(some))
    sent_no = seen[:-1] - np.repeat(seen[np.cumsum(n_sentences) - n_sentences], n_sentences)
    row = np.repeat(np.repeat(np.arange(len(texts)), n_texts), n_sentences)
    size = np.bincount(row, weights=n_words, minlength=len(texts)).astype(np.int64)
    first = np.zeros(n_words.sum(), dtype=bool)
    first[(np.cumsum(n_words) - n_words)[some]] = True
    codes = by_sentence.flatten().dictionary_encode()
    different, at = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
    lower = [w.lower() for w in different]
    upper = np.array([w.upper() == w and len(w) > 1 and not is_number(w) for w in different], dtype=bool)
    capital = np.array([category(w[0]) == "Lu" for w in different], dtype=bool) & ~upper
    valid = np.array([len(w) >= 3 and w not in NEVER and not is_number(w) for w in lower], dtype=bool)
    terms = pa.array(lower, pa.string()).dictionary_encode()
    term = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
    return Words(terms.dictionary, term, np.repeat(sent_no, n_words), upper[at], capital[at] & ~first, valid[at], first), size


def distinct(values: np.ndarray) -> np.ndarray:
    """Different values, ascending; np.unique hashes, which takes several times as long here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def score_words(words: Words, size: np.ndarray) -> tuple[tuple, tuple]:
    """Valid terms, and pairs of them that are neighbours, of texts whose words stand one after the other; size: words of each text, at least one.
    Both as: text (its number, ascending), strings, occurrences, score. A term's is that of term_scores(), a pair's that of keyword_scores()."""
    code, sent, n_codes = words.term, words.sent, len(words.terms)
    text = np.repeat(np.arange(len(size)), size)
    group, at, tf = np.unique(text * n_codes + code, return_inverse=True, return_counts=True)
    count = lambda which: np.bincount(at[which], minlength=len(group))
    different = lambda of, value, most: np.bincount(distinct(of * most + value) // most, minlength=len(group))
    order = np.lexsort((sent, at))
    start = np.cumsum(tf) - tf
    middle = (sent[order[start + (tf - 1) // 2]] + sent[order[start + tf // 2]]) / 2
    later = np.flatnonzero(~words.first)  # words with one before them in the sentence, which so has one after it
    before = later - 1
    both = words.valid[before] & words.valid[later]
    valid = np.zeros(len(group), dtype=bool)
    valid[at] = words.valid
    owner = group // n_codes
    n_valid = np.bincount(owner[valid], minlength=len(size))
    n = np.maximum(n_valid, 1)
    total, squares = (np.bincount(owner[valid], weights=tf[valid] ** k, minlength=len(size)) for k in (1, 2))
    most = np.zeros(len(size), dtype=np.int64)
    np.maximum.at(most, owner, tf)
    sentences = np.maximum.reduceat(sent, np.cumsum(size) - size) + 1
    share = lambda d, n: np.where(n > 0, d / np.maximum(n, 1), 0.0)
    casing = np.maximum(count(words.upper), count(words.capital)) / (1 + np.log(tf))
    left, right = share(different(at[later], code[before], n_codes), count(later)), share(different(at[before], code[later], n_codes), count(before))
    related = 1 + (left + right) * tf / most[owner]
    usual = total / n + np.sqrt(np.maximum(n * squares - total**2, 0)) / n  # mean and spread of the text's valid terms' occurrences
    frequency = tf / np.where(usual > 0, usual, 1)[owner]
    score = np.log(np.log(3 + middle)) * related / (casing + frequency / related + different(at, sent, sent.max() + 1) / sentences[owner] / related)
    pair, n_pair = np.unique(at[before[both]] * len(group) + at[later[both]], return_counts=True)
    a, b = pair // len(group), pair % len(group)
    string = lambda g: words.terms.take(pa.array(group[g] % n_codes))
    joint = score[a] * score[b] / (n_pair * (1 + score[a] + score[b]))
    return (owner[valid], string(valid), tf[valid], score[valid]), (owner[a], pc.binary_join_element_wise(string(a), string(b), " "), n_pair, joint)


def listed(n_texts: int, names: list[str], owner: np.ndarray, *columns) -> pa.Array:
    """A list of structs for each text; owner: the text of each struct, ascending."""
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=n_texts)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], names))


def term_lists(size: np.ndarray, terms: tuple, pairs: tuple) -> pa.Array:
    return listed(len(size), ["term", "tf", "score"], *terms)


def keyword_lists(size: np.ndarray, terms: tuple, pairs: tuple) -> pa.Array:
    """Terms and pairs of a text, one after the other."""
    owner, term, tf, score = terms
    order = np.argsort(np.concatenate([owner, pairs[0]]), kind="stable")
    both = [np.concatenate([x, y])[order] for x, y in ((owner, pairs[0]), (tf, pairs[2]), (score / (tf * (1 + score)), pairs[3]))]
    return listed(len(size), ["keyword", "n", "score"], both[0], pa.concat_arrays([term, pairs[1]]).take(pa.array(order)), *both[1:])


def scored(tokens: DataFrame, key: str, column: str, lists: Callable[..., pa.Array]) -> DataFrame:
    """key and the column that `lists` makes of score_words(), of each text of words() that has any."""
    names = ["key", column.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PART):
                part = batch.slice(lo, PART)
                found, size = read_words(part.column(1))
                if size.any():
                    some = size > 0
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)), lists(size[some], *score_words(found, size[some]))], names)

    with_package(tokens.sparkSession)
    return tokens.select(key, "texts").mapInArrow(run, f"`key` {tokens.schema[key].dataType.simpleString()}, {column}").withColumnRenamed("key", key)


def term_scores(tokens: DataFrame, key: str) -> DataFrame:
    """key, term, tf, score of the valid terms of words(): the lower, the more a term says about its text."""
    return scored(tokens, key, TERMS, term_lists).select(key, F.inline("terms"))


def keyword_scores(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, found (array of keyword, n (occurrences), score): the terms and pairs of neighbouring valid terms of each text; low scores are good."""
    return scored(words(docs, key, text), key, FOUND, keyword_lists)


def near_copy(a: Column, b: Column, same: float) -> Column:
    """Whether the similarity by edit distance is above `same`. Lengths alone rule out most."""
    longest = F.greatest(F.length(a), F.length(b))
    return (F.abs(F.length(a) - F.length(b)) < (1 - same) * longest + 1e-9) & (1 - F.levenshtein(a, b) / longest > same)


def keywords(docs: DataFrame, key: str, text: str, top_n: int = 10, most: int = 20, same: float = 0.9) -> DataFrame:
    """key, rank, keyword, relevance (1 - score, 0 from 1 on): the best `most` keywords that are no near copies of better ones, of these the
    first top_n (1 to `most`). Texts under 20 characters have none; texts need keys of their own.

    All keywords of a text are gone through in order of score until `most` are kept; each is compared with those kept.
    """
    found = keyword_scores(docs, key, text)
    found = found.select(key, F.sort_array(F.transform("found", lambda k: F.struct(F.round(k["score"], 12).alias("place"), k["keyword"].alias("keyword"), k["score"].alias("score")))).alias("all"))
    add = lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: near_copy(y["keyword"], x["keyword"], same)), acc).otherwise(F.concat(acc, F.array(x)))
    few = 2 * most  # most texts need no more than these
    found = found.select(key, "all", F.aggregate(F.slice("all", 1, few), F.slice("all", 1, 0), add).alias("first"))
    rest = F.slice("all", few + 1, F.greatest(F.size("all") - few, F.lit(0)))
    kept = F.when(F.size("first") >= most, F.col("first")).otherwise(F.aggregate(rest, F.col("first"), add))
    top = F.slice(kept, 1, min(max(1, top_n), most))
    return found.select(key, F.posexplode(top).alias("i", "k")).select(key, (F.col("i") + 1).alias("rank"), F.col("k.keyword").alias("keyword"), (1 - F.least(F.col("k.score"), F.lit(1.0))).alias("relevance"))


def keyword_lines(found: DataFrame, key: str) -> DataFrame:
    """key, text: keywords() as the tool prints them, with a bar of ten."""
    term = F.when(F.length("keyword") < 30, F.rpad("keyword", 30, " ")).otherwise(F.col("keyword"))
    line = F.concat(F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(". "), term, F.lit(" "), F.repeat(F.lit("█"), F.floor(F.col("relevance") * 10).cast("int")), F.format_string(" (%.2f)\n", "relevance"))
    rows = found.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("ls"))
    return rows.select(key, F.concat(F.format_string("Top %d Keywords:\n\n", "n"), F.array_join(F.transform("ls", lambda x: x["l"]), "")).alias("text"))
