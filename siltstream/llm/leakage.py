"""Held-out passages in training text, found with suffix arrays over the training shards.

Each shard of documents is an array of word numbers, the numbers of the held-out words (any other word is 0). Its
suffixes are sorted by prefix doubling together with those of the held-out items; every item suffix is placed in
the shard's suffix array by binary search. The suffixes around that place that share enough words with it are
the verbatim matches and their locations. From each of them the match is carried on in both directions with the
fewest replaced, left-out or added words, which decides whether a passage counts as leaked.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A leaked passage has at least this many consecutive words of an item, one edit allowed for each EDIT_EVERY.
PASSAGE_WORDS = 20
EDIT_EVERY = 10
#: Words of documents that make one shard.
SHARD_WORDS = 1_000_000
#: Items searched for in one pass over the documents.
BLOCK_ITEMS = 20_000
#: Doubling steps; suffixes are told apart by their first 2**DOUBLINGS words.
DOUBLINGS = 5

_TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&[#a-zA-Z0-9]{2,10};")


def words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup and Unicode forms: tags go, entities are read,
    letters are decomposed and lose their marks, invisible characters go."""
    if not text:
        return []
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))
    text = text.casefold().replace("*", "").replace("~~", "").replace("`", "")
    return _WORD.findall(text)


def least_run(passage: int = PASSAGE_WORDS, every: int = EDIT_EVERY) -> int:
    """Every passage has this many words in a row verbatim: edits part it into at most edits + 1 runs."""
    return min((n - n // every) // (n // every + 1) for n in range(passage, passage + 20 * every))


class Items:
    """Held-out items as one array of word numbers, each item closed by a 0."""

    def __init__(self, items: list[Row]):
        texts = [words(r["text"]) for r in items]
        self.ids = np.array([r["item_id"] for r in items], dtype=np.int64)
        self.number: dict[str, int] = {}
        flat = []
        for t in texts:
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in t] + [0]
        self.flat = np.array(flat, dtype=np.int64)
        self.owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        m = len(self.number) + 1
        self.pairs = np.unique(self.flat[:-1] * m + self.flat[1:]) if len(flat) > 1 else np.zeros(0, np.int64)


def _ranks(tokens: np.ndarray, length: int, doublings: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix by its first 2**doublings words, and group of each by its first length words."""
    rank, k, kept = tokens, 1, [(1, tokens)]
    for _ in range(doublings):
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        # a suffix ends at a 0, whatever stands behind
        whole = _whole(tokens, k)
        pair = rank * (int(rank.max()) + 1) + np.where(whole, ahead, 0)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64) + 1
        rank[tokens == 0] = 0
        k *= 2
        kept.append((k, rank))
    group, done = None, 0
    for k, r in reversed(kept):
        if done + k <= length:
            ahead = np.zeros_like(r)
            ahead[: len(r) - done] = r[done:]
            group = ahead if group is None else np.unique(group * (int(ahead.max()) + 1) + ahead, return_inverse=True)[1]
            done += k
    return rank, group


def _whole(tokens: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each place on are all words (no 0, no end)."""
    zeros = np.r_[0, np.cumsum(tokens == 0)]
    end = np.minimum(np.arange(len(tokens)) + k, len(tokens))
    return (zeros[end] == zeros[: len(tokens)]) & (np.arange(len(tokens)) + k <= len(tokens))


def verbatim_matches(shard: np.ndarray, items: Items, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item place, shard place, words): all matches of at least ``least`` words that can't be longer on the left,
    each as long as it goes on the right."""
    none = (np.zeros(0, np.int64),) * 3
    m = len(items.number) + 1
    if len(shard) < least or not len(items.flat):
        return none
    # a match has only pairs of neighbours that the items have; the rest can't take part
    pair = shard[:-1] * m + shard[1:]
    linked = np.isin(pair, items.pairs) & (shard[:-1] > 0) & (shard[1:] > 0)
    keep = np.zeros(len(shard), dtype=bool)
    edges = np.diff(np.r_[0, linked.astype(np.int8), 0])
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none
    lengths = ends - starts
    # the runs that remain, each closed by a 0, and where they stand in the shard
    offset = np.r_[0, np.cumsum(lengths + 1)]
    place = np.full(offset[-1], -1, dtype=np.int64)
    inner = np.arange(lengths.sum()) - np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    place[np.repeat(offset[:-1], lengths) + inner] = np.repeat(starts, lengths) + inner
    text = np.where(place >= 0, shard[place], 0)
    both = np.r_[text, items.flat]
    rank, group = _ranks(both, least, DOUBLINGS)
    whole = _whole(both, least)
    n = len(text)
    suffix = np.flatnonzero(whole[:n])
    suffix = suffix[np.argsort(rank[suffix], kind="stable")]  # the suffix array
    wanted = np.flatnonzero(whole[n:])
    # binary search: the suffixes with the same first words stand together in the array
    first = group[suffix]
    low, high = (np.searchsorted(first, group[n + wanted], side=side) for side in ("left", "right"))
    count = high - low
    item_at = np.repeat(wanted, count)
    shard_at = place[suffix[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)]] if len(count) else np.zeros(0, np.int64)
    left_item = np.where(item_at > 0, items.flat[item_at - 1], 0)
    left_shard = np.where(shard_at > 0, shard[shard_at - 1], 0)
    fresh = (left_item != left_shard) | (left_item == 0)
    item_at, shard_at = item_at[fresh], shard_at[fresh]
    size = np.full(len(item_at), least, dtype=np.int64)
    going = np.arange(len(item_at))
    while len(going):
        i, j = item_at[going] + size[going], shard_at[going] + size[going]
        ok = (i < len(items.flat)) & (j < len(shard))
        going, i, j = going[ok], i[ok], j[ok]
        going = going[(items.flat[i] == shard[j]) & (items.flat[i] > 0)]
        size[going] += 1
    return item_at, shard_at, size


def reach(item: np.ndarray, text: np.ndarray, edits: int) -> list[int]:
    """The most item words that a match from the start of both takes with 0, 1, ... edits, ending in a match."""

    def slide(i: int, j: int) -> int:
        k = 0
        while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and item[i + k]:
            k += 1
        return i + k

    far = {0: slide(0, 0)}
    best = [far[0]]
    for _ in range(edits):
        further: dict[int, int] = {}
        top = best[-1]
        for d, i in far.items():
            for e, start in ((d, i + 1), (d - 1, i + 1), (d + 1, i)):  # replaced, left out, added
                if start <= len(item) and 0 <= start + e <= len(text):
                    end = slide(start, start + e)
                    further[e] = max(further.get(e, -1), end)
                    top = max(top, end if end > start else 0)
        best.append(top)
        far = further
    return best


def passage(item: np.ndarray, text: np.ndarray, i: int, j: int, size: int) -> tuple[int, int]:
    """(words, edits) of the longest leaked passage around a verbatim match, or (0, 0)."""
    most = max(1, len(item) // EDIT_EVERY)
    right = reach(item[i + size :], text[j + size : j + size + 2 * len(item)], most)
    left = reach(item[:i][::-1], text[max(0, j - 2 * len(item)) : j][::-1], most)
    found = (0, 0)
    for a, x in enumerate(left):
        for b, y in enumerate(right):
            total = x + size + y
            if total >= PASSAGE_WORDS and (a + b) * EDIT_EVERY <= total and total > found[0]:
                found = (total, a + b)
    return found


LEAKS = "item_id bigint, doc_id bigint, verbatim_words int, doc_word bigint, item_word int, passage_words int, passage_edits int"


def _search(items: Items):
    least = least_run()
    starts = np.r_[0, np.flatnonzero(items.flat == 0) + 1]
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("verbatim_words", pa.int32()), ("doc_word", pa.int64()), ("item_word", pa.int32()), ("passage_words", pa.int32()), ("passage_edits", pa.int32())])

    def leaks(docs: list[int], shard: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        item_at, shard_at, size = verbatim_matches(shard, items, least)
        owner = np.searchsorted(bounds, shard_at, side="right") - 1
        best: dict[tuple[int, int], list] = {}
        for k in np.argsort(-size, kind="stable"):
            item, doc = int(items.owner[item_at[k]]), int(owner[k])
            i, j = int(item_at[k] - starts[item]), int(shard_at[k] - bounds[doc])
            row = best.setdefault((item, doc), [int(size[k]), j, i, 0, 0])
            if row[3]:
                continue
            row[3:] = passage(items.flat[starts[item] : starts[item + 1] - 1], shard[bounds[doc] : bounds[doc + 1] - 1], i, j, int(size[k]))
        rows = [(int(items.ids[i]), docs[d], *v) for (i, d), v in best.items() if v[3]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 7, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, numbers, total = [], [], 0

        def close():
            bounds = np.r_[0, np.cumsum([len(x) for x in numbers])]
            return leaks(docs, np.concatenate(numbers), bounds)

        get = items.number.get
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = words(text.as_py())
                docs.append(doc)
                numbers.append(np.array([get(w, 0) for w in found] + [0], dtype=np.int64))
                total += len(found) + 1
                if total >= SHARD_WORDS:
                    yield close()
                    docs, numbers, total = [], [], 0
        if docs:
            yield close()

    return run


def leaks(documents: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """LEAKS, one row per held-out item and document that holds a passage of it: the longest verbatim match with
    its word positions, and the words and edits of the longest passage found around the longest match that has one.

    The items, a stated set, are searched for in blocks against all documents. Null and empty texts match
    nothing; copies of a document or an item all count.
    """
    spark = documents.sparkSession
    known = items.select("item_id", "text").where("item_id is not null and text is not null")
    found, block = None, []

    def add(found: DataFrame | None, block: list[Row]) -> DataFrame:
        one = documents.select("doc_id", "text").mapInArrow(_search(Items(block)), LEAKS)
        return one if found is None else found.unionByName(one)

    for row in known.toLocalIterator():
        block.append(row)
        if len(block) == block_items:
            found, block = add(found, block), []
    if block or found is None:
        found = add(found, block)
    return found


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) of the leaks."""
    return leaks(documents, items).select("item_id", "doc_id").distinct()


def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a leaked passage."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per benchmark and split of the items: items, items leaked, documents affected."""
    found = leaks(documents, items).select("item_id", "doc_id")
    return items.select("item_id", "benchmark_name", "split").join(found, "item_id", "left").groupBy("benchmark_name", "split").agg(
        F.count_distinct("item_id").alias("n_items"),
        F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"),
        F.count_distinct("doc_id").alias("n_documents"),
    )
