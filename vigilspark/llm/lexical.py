"""Ranked lexical search by dual trees.

Items and documents are vectors over the items' terms: an item has each term's weight, a document a
number that grows with the term's occurrences and falls with its length; a score is their inner
product. Both sides are parted into a hierarchy whose nodes hold each coordinate's largest value.
The product of two nodes' maxima bounds all scores between their members, so a pair of
nodes is left out, with all its members, where the bound is below the weakest k-th score of
the node's items. What is left at the leaves is scored exactly.

Items come in blocks of bounded size, each searched over all documents. A share of the documents,
searched first, gives every item a k-th score to begin with; the search itself takes all of them.
Whole numbers below 2 to the 53 are exact in doubles, so the products are too.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import per_document, texts_of

K = 50
#: A block of items ends before it exceeds so many items or (item, term) pairs; an item is never parted.
BLOCK_ITEMS, BLOCK_PAIRS = 512, 16_384
#: Numbers in the dense matrix of the documents searched together.
CELLS = 1 << 22
#: Members of a leaf, children of a node.
DOC_LEAF, ITEM_LEAF, FAN = 16, 8, 8
#: One document in so many, by hash, is searched first.
FIRST = 64
#: Texts are cut at blanks into pieces of about so many bytes.
PIECE = 1 << 20
#: Columns of the sketch by which members of a hierarchy are put side by side.
SKETCH = 64
#: Term bytes, A-Z lowered; other ASCII bytes part terms, bytes of other code points are terms' own.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` in pieces that end at a blank."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at, at + size)
        if cut < at:
            cut = data.find(b" ", at + size)
            if cut < 0:
                break
        yield data[at:cut]
        at = cut + 1
    yield data[at:]


def count_terms(text: str) -> Counter:
    found: Counter = Counter()
    for piece in pieces(text.encode().translate(LOWER)):
        found.update(piece.split())
    return found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id, term); rows with one id are one item."""

    def start():
        return lambda texts: {"terms": pa.array([[t.decode() for t in count_terms(x)] for x in texts], pa.list_(pa.string()))}

    found = per_document(texts_of(items, id_col, text_col), start, "terms array<string>")
    return found.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


def _blocks(pairs: DataFrame) -> Iterator[list[tuple[object, list[str]]]]:
    """Items with their terms, one block at a time."""
    block, size = [], 0
    for item, rows in groupby(pairs.orderBy("item_id", "term").toLocalIterator(), key=lambda r: r["item_id"]):
        terms = [r["term"] for r in rows]
        if block and (len(block) >= BLOCK_ITEMS or size + len(terms) > BLOCK_PAIRS):
            yield block
            block, size = [], 0
        block.append((item, terms))
        size += len(terms)
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, times) of each row with a term: all its terms, and those of the vocabulary with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        known = shared.value

        def of(texts: list[str]) -> dict:
            sizes, terms, times = [], [], []
            for text in texts:
                counts = count_terms(text)
                own = sorted((known[t], counts[t]) for t in counts.keys() & known.keys())
                sizes.append(sum(counts.values()))
                terms.append([t for t, _ in own])
                times.append([c for _, c in own])
            return {"n": pa.array(sizes, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "times": pa.array(times, pa.list_(pa.int64()))}

        return of

    found = per_document(texts_of(docs, id_col, text_col), start, "n bigint, terms array<int>, times array<bigint>")
    return found.where("n > 0")


def similar_order(sketch: np.ndarray, leaf: int) -> np.ndarray:
    """An order that puts like rows side by side: halves along the line between two far rows, again and again."""
    out: list[np.ndarray] = []
    waiting = [np.arange(len(sketch))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        own = sketch[rows]
        a = np.argmax(((own - own.mean(0)) ** 2).sum(1))
        b = np.argmax(((own - own[a]) ** 2).sum(1))
        rows = rows[np.argsort(own @ (own[a] - own[b]), kind="stable")]
        half = -(-len(rows) // (2 * leaf)) * leaf
        waiting += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, int)


def hierarchy(matrix: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes, from the one root to the leaves; every node has up to FAN children in a row."""
    levels = [np.maximum.reduceat(matrix, np.arange(0, len(matrix), leaf), axis=0)]
    while len(levels[0]) > 1:
        levels.insert(0, np.maximum.reduceat(levels[0], np.arange(0, len(levels[0]), FAN), axis=0))
    return levels


def _sketch(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows * SKETCH + cols % SKETCH, values, n * SKETCH).reshape(n, SKETCH)


class Items:
    """A block of items: their ids in the order of the leaves, their matrix, its hierarchy, and the numbers of the corpus."""

    def __init__(self, block: list[tuple[object, list[str]]], vocabulary: dict[bytes, int], weight: np.ndarray, n_docs: int, n_terms: int):
        rows = np.repeat(np.arange(len(block)), [len(t) for _, t in block])
        cols = np.array([vocabulary[t.encode()] for _, terms in block for t in terms], int)
        order = similar_order(_sketch(rows, cols, weight[cols], len(block)), ITEM_LEAF)
        matrix = np.zeros((len(block), len(vocabulary)))
        matrix[rows, cols] = weight[cols]
        self.matrix = matrix[order]
        self.ids = [block[i][0] for i in order]
        self.levels = hierarchy(self.matrix, ITEM_LEAF)
        self.columns = [np.flatnonzero(leaf) for leaf in self.levels[-1]]
        self.n_docs, self.n_terms, self.width = n_docs, n_terms, len(vocabulary)
        self.together = max(4 * DOC_LEAF, CELLS // max(1, self.width))


def _by_id(entry: tuple) -> tuple:
    return entry[0], entry[1] is None, entry[1]


class Search:
    """The best k of each item among the documents seen so far; ``floors`` are scores that k documents are known to reach."""

    def __init__(self, items: Items, k: int, floors: np.ndarray):
        self.items, self.k = items, k
        self.weakest = np.maximum(floors, 1).astype(float)
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.scored = 0

    def add(self, ids: list, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Documents: their ids and sizes, and how many terms each has, with all terms and occurrences one after the other."""
        items, n = self.items, len(ids)
        m = 50 + (50 * sizes * items.n_docs) // items.n_terms
        rows = np.repeat(np.arange(n), lengths)
        values = ((1_000_000_000 * times) // (1000 * times + 20 * m[rows])).astype(float)
        order = similar_order(_sketch(rows, terms, values, n), DOC_LEAF)
        place = np.empty(n, int)
        place[order] = np.arange(n)
        matrix = np.zeros((n, items.width))
        matrix[place[rows], terms] = values
        ids = [ids[i] for i in order]
        for leaf, chosen in self._leaves(hierarchy(matrix, DOC_LEAF)):
            self._score(leaf, (chosen[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel(), matrix, ids)

    def _leaves(self, docs: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf of items, leaves of documents) whose bounds, and those of all nodes above, reach the items' weakest score."""
        mine = self.items.levels
        alive = np.ones((1, 1), bool)
        for step in range(max(len(docs), len(mine))):
            d, i = docs[min(step, len(docs) - 1)], mine[min(step, len(mine) - 1)]
            if step:
                if step < len(docs):
                    alive = np.repeat(alive, FAN, 0)[: len(d)]
                if step < len(mine):
                    alive = np.repeat(alive, FAN, 1)[:, : len(i)]
            group = ITEM_LEAF * FAN ** max(0, len(mine) - 1 - step)
            weakest = np.minimum.reduceat(self.weakest, np.arange(0, len(self.weakest), group))
            some_d, some_i = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(some_d):
                return
            reach = np.zeros_like(alive)
            reach[np.ix_(some_d, some_i)] = d[some_d] @ i[some_i].T >= weakest[some_i]
            alive &= reach
        for leaf in np.flatnonzero(alive.any(0)):
            yield leaf, np.flatnonzero(alive[:, leaf])

    def _score(self, leaf: int, rows: np.ndarray, matrix: np.ndarray, ids: list) -> None:
        rows = rows[rows < len(matrix)]
        first = leaf * ITEM_LEAF
        columns = self.items.columns[leaf]
        scores = matrix[np.ix_(rows, columns)] @ self.items.matrix[first : first + ITEM_LEAF, columns].T
        self.scored += scores.size
        for j in range(scores.shape[1]):
            item, own = first + j, scores[:, j]
            near = np.flatnonzero(own >= self.weakest[item])
            if not len(near):
                continue
            if len(near) > self.k:
                cut = np.partition(own[near], -self.k)[-self.k]
                near = near[own[near] >= cut]
            entries = self.best[item] + [(-own[x], ids[rows[x]]) for x in near]
            self.best[item] = nsmallest(self.k, entries, key=_by_id)
            if len(self.best[item]) == self.k:
                self.weakest[item] = max(self.weakest[item], -self.best[item][-1][0])


def _search(found: DataFrame, items, k: int, floors: np.ndarray, id_type: str, item_type: str) -> DataFrame:
    """(item_id, doc_id, score): the best k of each item in each task that may be among the best of all."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in (item_type, id_type)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        search = Search(block, k, floors)
        held, n = [], 0

        def hand_over() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, sizes = table.column(0).to_pylist(), table.column(1).to_numpy()
            lists, times = (table.column(c).combine_chunks() for c in (2, 3))
            lists, times = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (lists, times))
            search.add(ids, sizes, lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), times.flatten().to_numpy())

        for batch in batches:
            for at in range(0, batch.num_rows, block.together):
                part = batch.slice(at, block.together)
                if n + part.num_rows > block.together:
                    hand_over()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            hand_over()
        rows = [(block.ids[i], doc, int(-score)) for i, best in enumerate(search.best) for score, doc in best]
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate([*kinds, pa.int64()])]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    schema = f"item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score bigint"
    return found.select("doc_id", "n", "terms", "times").mapInArrow(run, schema)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Every row of ``docs`` is a document: repeated ids are ranked as often as they come, null ids after the
    others of their score. Rows of ``items`` with one id (null is one) are one item with the terms of all.
    Null texts have no term; an item without terms, an empty table or a corpus without terms gives no
    rows. Other columns are ignored. Each block of items reads the documents once; their vectors
    over the block's terms are written and searched from there.
    """
    spark = docs.sparkSession
    parts: list[DataFrame] = []
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    for block in _blocks(stage(item_terms(items, item_col, item_text_col), "items")):
        names = sorted({t for _, terms in block for t in terms})
        vocabulary = {t.encode(): i for i, t in enumerate(names)}
        found = stage(vectors(docs, vocabulary, id_col, text_col), "vectors")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        seen = dict(found.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row a term of the block
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen.get(i, 0) + 1))) for i in range(len(names))], float)
        shared = spark.sparkContext.broadcast(Items(block, vocabulary, weight, n_docs, n_terms))
        first = found.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(FIRST)) == 0)
        early = _best(_search(first, shared, k, np.zeros(len(block)), id_type, item_type), k).where(F.col("rank") == k)
        known = {r["item_id"]: r["score"] for r in early.collect()}  # a row an item of the block
        floors = np.array([known.get(i, 0) for i in shared.value.ids], float)
        best = _best(_search(found, shared, k, floors, id_type, item_type), k)
        parts.append(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score bigint")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
