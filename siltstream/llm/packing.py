"""Documents of any length in containers of a fixed number of tokens, by lexical retrieval packing.

Documents are tokenised once. A document beyond the capacity is cut into full containers and a rest; all else
stays whole. Items that are near in their words go into one shard: cells are fitted on a bounded sample of items, every
item is told to the cell nearest to it, and a cell beyond the size of a shard is spread over several by a hash of
doc_id. Each shard holds a BM25 inverted index over its items, with document frequencies of all documents. The longest unused item seeds a container, its unused neighbours
fill it in order of their score, and the last space is taken by the longest item that still fits, the
nearest of several. Containers that a shard's end leaves part empty are packed once more across shards.
"""

from __future__ import annotations

import base64
import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstream.session import materialise, sized

CAPACITY = 2048
SHARD_ITEMS = 2_000
#: The items on which the lexical cells are fitted, the most cells, and the rounds of fitting. Every item is told to a cell.
SAMPLE_ITEMS, MOST_CELLS, CELL_ROUNDS = 3_000, 64, 6
#: Containers filled below this share are emptied and packed again with those of other shards.
LOOSE = 0.97
#: Queries of one pass when the recall of neighbours is measured.
RECALL_QUERIES = 500
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into words before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
K1, B = 1.2, 0.75
#: Below this share of free space the longest item that fits is taken, not the nearest.
LAST_SPACE = 0.25

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


PIECES = "doc_id bigint, piece int, start_token bigint, n_tokens int, terms array<int>, counts array<int>"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array(encode(text.as_py() or ""), dtype=np.int32)
                for k, start in enumerate(range(0, max(len(ids), 1), capacity)):
                    part = ids[start : start + capacity]
                    terms, counts = np.unique(part, return_counts=True)
                    out.append((doc, k, start, len(part), terms, counts.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def tokenised(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, terms, counts): a document's pieces of at most capacity tokens.
    Null and empty texts are one piece of 0 tokens."""
    return documents.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity), PIECES)


class Index:
    """BM25 inverted index over the items of a shard."""

    def __init__(self, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], frequency: np.ndarray, documents: int, mean_length: float):
        self.terms = terms
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term, tf = (np.concatenate(x) if len(x) else np.zeros(0, np.int32) for x in (terms, counts))
        order = np.argsort(term, kind="stable")
        self.owner = owner[order]
        df = frequency[term[order]]
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths[self.owner] / max(mean_length, 1.0))
        tf = tf[order].astype(np.float64)
        self.weight = idf * tf * (K1 + 1) / (tf + norm)
        self.start = np.searchsorted(term[order], np.arange(len(frequency) + 1))

    def of(self, items: np.ndarray) -> Index:
        """The same index over some of its items only, numbered anew in their order. Weights stay."""
        number = np.full(len(self.terms), -1, dtype=np.int64)
        number[items] = np.arange(len(items))
        keep = number[self.owner] >= 0
        made = copy.copy(self)
        made.start = np.r_[0, np.cumsum(keep)][self.start]
        made.owner, made.weight, made.terms = number[self.owner[keep]], self.weight[keep], [self.terms[k] for k in items]
        return made

    def scores(self, item: int) -> np.ndarray:
        """The score of every item for all distinct terms of one."""
        return self.scores_of(self.terms[item])

    def scores_of(self, terms: np.ndarray) -> np.ndarray:
        spans = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist()) if a < b]
        if not spans:
            return np.zeros(len(self.terms))
        return np.bincount(np.concatenate([self.owner[x] for x in spans]), weights=np.concatenate([self.weight[x] for x in spans]), minlength=len(self.terms))


def pack_shard(lengths: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Items per container; every item is in one. Ties go to the earlier item."""
    unused = np.ones(len(lengths), dtype=bool)
    # the items of the index in use, those unused when it was made
    rows, place = np.arange(len(lengths)), np.arange(len(lengths))
    left = len(lengths)
    containers = []
    for seed in np.argsort(lengths, kind="stable")[::-1]:
        if not unused[seed]:
            continue
        if 2 * left <= len(rows):
            kept = np.flatnonzero(unused[rows])
            rows, index = rows[kept], index.of(kept)
            place[rows] = np.arange(len(rows))
        unused[seed] = False
        held, free = [int(seed)], capacity - int(lengths[seed])
        scores = None
        while True:
            near = rows[unused[rows] & (lengths[rows] <= free)]
            if not len(near):
                break
            whole = free > LAST_SPACE * capacity
            if not whole:
                near = near[lengths[near] == lengths[near].max()]
            if scores is None and len(near) > 1:
                scores = index.scores_of(index.terms[place[seed]])
            if whole:
                for item in near[np.argsort(-scores[place[near]], kind="stable")] if len(near) > 1 else near:
                    if free <= LAST_SPACE * capacity:
                        break
                    if lengths[item] <= free:
                        held.append(int(item))
                        unused[item] = False
                        free -= int(lengths[item])
            else:
                item = int(near[np.argmax(scores[place[near]])] if len(near) > 1 else near[0])
                held.append(item)
                unused[item] = False
                free -= int(lengths[item])
        left -= len(held)
        containers.append(held)
    return containers


def term_weights(terms: np.ndarray, counts: np.ndarray, length: int, frequency: np.ndarray, documents: int, mean_length: float) -> np.ndarray:
    """BM25 weights of an item's terms as they stand in the index."""
    df = frequency[terms]
    idf = np.log1p((documents - df + 0.5) / (df + 0.5))
    return (idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / max(mean_length, 1.0)))).astype(np.float32)


def lexical_cells(items: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, cells: int, seed: int = 42) -> np.ndarray:
    """(vocabulary, cells): centres of the items' weight vectors, each given as terms and weights, by spherical k-means."""
    rng = np.random.default_rng(seed)
    held = [(t, w / max(float(np.linalg.norm(w)), 1e-9)) for t, w in items if len(t)]
    centres = np.zeros((vocabulary, cells), dtype=np.float32)
    near = np.zeros(len(held))
    for k in range(min(cells, len(held))):
        # each further centre is likely to be far from those before
        far = (1 - near).clip(0) ** 2
        i = int(rng.choice(len(held), p=far / far.sum())) if far.sum() > 0 else k
        centres[held[i][0], k] = held[i][1]
        near = np.maximum(near, [float(w @ centres[t, k]) for t, w in held])
    for _ in range(CELL_ROUNDS):
        sums = np.zeros_like(centres)
        for t, w in held:
            sums[t, int((w @ centres[t]).argmax())] += w
        length = np.linalg.norm(sums, axis=0)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-9), centres)
    return centres


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column without copies."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    ends = whole.offsets.to_numpy()
    values = whole.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


@dataclass
class Collection:
    """What all shards share: document frequencies, documents, their mean length, and how items are told to shards."""

    frequency: np.ndarray
    documents: int
    mean_length: float
    centres: np.ndarray
    groups: np.ndarray

    def shards(self, doc: np.ndarray, lengths: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """The cell whose centre an item is nearest to, and within a large cell one of its shards by a hash of doc_id."""
        cell = [int((term_weights(t, c, n, self.frequency, self.documents, self.mean_length) @ self.centres[t]).argmax()) if len(t) else 0 for t, c, n in zip(terms, counts, lengths)]
        cell = np.array(cell, dtype=np.int64)
        mixed = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return cell * (1 << 32) + ((mixed >> np.uint64(32)) % self.groups[cell].astype(np.uint64)).astype(np.int64)


def collection(pieces: DataFrame, capacity: int, shard_items: int) -> Collection:
    """Statistics of all pieces, and cells fitted on SAMPLE_ITEMS of them, the first by a hash of doc_id."""
    items = pieces.where(F.col("n_tokens") < capacity)
    # of all documents; at most one row per entry of the vocabulary
    heads = pieces.agg(F.count_distinct("doc_id").alias("d"), F.sum("n_tokens").alias("n"), F.count(F.when(F.col("n_tokens") < capacity, 1)).alias("i")).first()
    terms = pieces.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    frequency = np.zeros(int(np.max(terms["term"].to_numpy(), initial=0)) + 1, dtype=np.int64)
    frequency[terms["term"].to_numpy()] = terms["df"].to_numpy()
    documents, mean = max(heads["d"], 1), (heads["n"] or 0) / max(heads["d"], 1)
    shards = max(1, -(-heads["i"] // shard_items))
    cells = min(shards, MOST_CELLS)
    if cells == 1:
        return Collection(frequency, documents, mean, np.zeros((len(frequency), 1), np.float32), np.array([shards]))
    sample = items.orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id", "piece").limit(SAMPLE_ITEMS).select("n_tokens", "terms", "counts").toArrow()
    rows = [(t, term_weights(t, c, n, frequency, documents, mean)) for n, t, c in zip(sample["n_tokens"].to_pylist(), _lists(sample["terms"]), _lists(sample["counts"]))]
    centres = lexical_cells(rows, len(frequency), cells)
    held = np.bincount([int((w @ centres[t]).argmax()) if len(t) else 0 for t, w in rows], minlength=cells)
    return Collection(frequency, documents, mean, centres, np.maximum(1, held * shards // len(rows)))


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, position, doc_id, piece, start_token, n_tokens): every piece of every document once.

    Only documents beyond the capacity have several pieces, all but the last full. Items of 0 tokens are packed
    like others. Copies are items of their own. Empty in, empty out.
    """
    pieces = materialise(tokenised(documents, tokenizer, capacity), "pieces")
    full = pieces.where(F.col("n_tokens") == capacity)
    items = pieces.where(F.col("n_tokens") < capacity)
    # the vocabulary's size bounds it
    known = documents.sparkSession.sparkContext.broadcast(collection(pieces, capacity, shard_items))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            shard = known.value.shards(t["doc_id"].to_numpy(), t["n_tokens"].to_numpy(), _lists(t["terms"]), _lists(t["counts"])) if t.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = group["n_tokens"].to_numpy().astype(np.int64)
        c = known.value
        held = pack_shard(lengths, Index(lengths, _lists(group["terms"]), _lists(group["counts"]), c.frequency, c.documents, c.mean_length), capacity)
        order = np.array([i for c in held for i in c], dtype=np.int64)
        names = [f"s{group['shard'][0]}-{k}" for k, c in enumerate(held) for _ in c]
        place = [p for c in held for p in range(len(c))]
        rows = group.select(["doc_id", "piece", "start_token", "n_tokens"]).take(pa.array(order))
        filled = np.repeat([int(lengths[c].sum()) for c in held], [len(c) for c in held])
        return pa.table({"container_id": pa.array(names, pa.string()), "position": pa.array(place, pa.int32()), **{c: rows[c] for c in rows.column_names}, "filled": pa.array(filled, pa.int64())})

    schema = "container_id string, position int, doc_id bigint, piece int, start_token bigint, n_tokens int, filled bigint"
    sharded = items.select("doc_id", "piece", "start_token", "n_tokens", "terms", "counts").mapInArrow(told, "doc_id bigint, piece int, start_token bigint, n_tokens int, terms array<int>, counts array<int>, shard bigint")
    first = materialise(sharded.groupBy("shard").applyInArrow(run, schema), "packed")
    # what the ends of the shards leave loose is packed once more, across shards
    loose = first.where(F.col("filled") < LOOSE * capacity)
    again = items.join(sized(loose.select("doc_id", "piece")), ["doc_id", "piece"])
    shards = max(1, -(-loose.count() // shard_items))
    again = again.select("doc_id", "piece", "start_token", "n_tokens", "terms", "counts", (-1 - F.pmod(F.xxhash64("doc_id"), F.lit(shards))).cast("bigint").alias("shard"))
    packed = first.where(F.col("filled") >= LOOSE * capacity).unionByName(again.groupBy("shard").applyInArrow(run, schema)).drop("filled")
    alone = full.select(F.concat_ws("-", F.lit("d"), "doc_id", "piece").alias("container_id"), F.lit(0).alias("position"), "doc_id", "piece", "start_token", "n_tokens")
    return packed.unionByName(alone)


def neighbour_recall(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, neighbours: int = 10) -> DataFrame:
    """(doc_id, piece, n_found): of the ``neighbours`` items with the best BM25 scores among all items, how many stand in the
    query's shard. Queries are the items of ids divisible by 50, scored against all items, a batch of items at a time."""
    pieces = materialise(tokenised(documents, tokenizer, capacity), "pieces")
    items = pieces.where(F.col("n_tokens") < capacity).select("doc_id", "piece", "n_tokens", "terms", "counts")
    spark = documents.sparkSession
    shared = collection(pieces, capacity, shard_items)
    known = spark.sparkContext.broadcast(shared)
    asked = items.where((F.col("doc_id") % 50 == 0) & (F.size("terms") > 0)).orderBy("doc_id", "piece")
    answers = None
    blocks = -(-asked.count() // RECALL_QUERIES)
    for block in range(blocks):
        queries = asked.offset(block * RECALL_QUERIES).limit(RECALL_QUERIES).toArrow()
        at = spark.sparkContext.broadcast(queries)

        def best(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            q, c = at.value, known.value
            words, ids, parts = _lists(q["terms"]), q["doc_id"].to_numpy(), q["piece"].to_numpy()
            shard = c.shards(ids, q["n_tokens"].to_numpy(), words, _lists(q["counts"]))
            for batch in batches:
                t = pa.Table.from_batches([batch])
                terms, counts, lengths = _lists(t["terms"]), _lists(t["counts"]), t["n_tokens"].to_numpy().astype(np.int64)
                own = c.shards(t["doc_id"].to_numpy(), lengths, terms, counts)
                index = Index(lengths, terms, counts, c.frequency, c.documents, c.mean_length)
                out = []
                for k in range(len(words)):
                    score = index.scores_of(words[k])
                    score[(t["doc_id"].to_numpy() == ids[k]) & (t["piece"].to_numpy() == parts[k])] = -1
                    for i in np.argsort(-score, kind="stable")[:neighbours]:
                        out.append((int(ids[k]), int(parts[k]), float(score[i]), int(t["doc_id"][int(i)].as_py()), bool(own[i] == shard[k])))
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_()))], ["doc_id", "piece", "score", "other", "is_near"])

        found = items.mapInArrow(best, "doc_id bigint, piece int, score double, other bigint, is_near boolean")
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        return spark.createDataFrame([], "doc_id bigint, piece int, n_found bigint")
    rank = F.row_number().over(Window.partitionBy("doc_id", "piece").orderBy(F.desc("score"), "other"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= neighbours).groupBy("doc_id", "piece").agg(F.count_if("is_near").alias("n_found"))


def oversized(documents: DataFrame, **options) -> DataFrame:
    """(doc_id) of the documents that the packing had to cut: those beyond one container."""
    return pack(documents, **options).where("piece > 0").select("doc_id").distinct()


def fill_report(documents: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row: documents, containers, tokens, the mean fill of the containers and those at least 95 % full."""
    packed = pack(documents, capacity=capacity, **options)
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("piece") == 0, 1)).alias("d"))
    return filled.agg(
        F.sum("d").alias("n_documents"),
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_tokens"),
        F.round(F.avg(F.col("n") / capacity), 6).alias("mean_fill"),
        F.count(F.when(F.col("n") >= 0.95 * capacity, 1)).alias("n_nearly_full"),
    )
