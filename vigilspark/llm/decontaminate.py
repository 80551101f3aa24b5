"""Benchmark decontamination by spaced-seed hashing, in built-in functions only.

A seed is a fixed mask over consecutive words; only its marked places are hashed, so a substituted
word under an unmarked place doesn't hide a hit. Hashes of all places of the benchmark's items and
of the documents are joined; a hit fixes how the item lies along the document, and there the words
are compared one by one. The overlap counts if some run of words has enough equal ones.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import row_key, small_side, texts_of
from .winnowing import words

#: Masks of weight 6. Whichever 2 of 13 words are substituted, some place of one of the masks is whole (all 78 pairs tried in the tests),
#: so every run of 13 words with 11 equal ones is found.
SEEDS = ("1111011", "1110010011")
#: Words of the run that is verified, and the equal ones among them.
RUN = 13
ALIKE = 0.8


def _hashes(hashed: Column, seed: str) -> Column:
    """Seed hash at each place of an array of word hashes; shorter texts have none."""
    places = [j for j, mark in enumerate(seed) if mark == "1"]
    fit = F.slice(hashed, 1, F.greatest(F.size(hashed) - (len(seed) - 1), F.lit(0)))
    return F.transform(fit, lambda x, i: F.xxhash64(F.lit(seed), x, *[F.get(hashed, i + F.lit(j)) for j in places[1:]]))


def masks_of(size: int, seeds: tuple[str, ...] = SEEDS, run: int = RUN, alike: float = ALIKE) -> tuple[str, ...]:
    """Masks for an item of ``size`` words: the seeds from ``run`` words on, else masks over the whole item.

    A shorter item may have d words substituted. Cut into d + 2 parts, it has two without
    a substitution wherever these are, so a mask for every choice of d parts to leave out finds it; with
    d = 0 the mask is the whole item.
    """
    if size >= run:
        return seeds
    lost = size - ceil(size * alike)
    if not lost:
        return ("1" * size,)
    ends = [size * k // (lost + 2) for k in range(lost + 3)]
    out = {
        "".join("0" * (b - a) if k in gone else "1" * (b - a) for k, (a, b) in enumerate(zip(ends, ends[1:]))).strip("0")
        for gone in combinations(range(lost + 2), lost)
    }
    return tuple(sorted(out))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seed_hits(texts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(id, place, hash) for every place of every seed; ``texts``: id, hashed (array of word hashes)."""
    every = F.flatten(F.array(*[_entries(F.col("hashed"), s) for s in seeds]))
    return texts.select("id", F.explode(every).alias("entry")).select("id", "entry.place", "entry.hash")


def _entries(hashed: Column, seed: str) -> Column:
    return F.transform(_hashes(hashed, seed), lambda h, i: F.struct(i.alias("place"), h.alias("hash")))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    seeds: tuple[str, ...] = SEEDS,
    run: int = RUN,
    alike: float = ALIKE,
) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id, doc_word, item_word, n_words, n_equal, n_places.

    n_words is the item's words that lie within the document, from item_word on the item's side and
    doc_word on the document's (0-based), n_equal the equal ones among them, at the place with most
    equal words (the first among ties); n_places counts the places where the item overlaps. An overlap
    is a run of ``run`` words (all of a shorter item's) with ``alike`` of them equal, rounded up; so an item of
    up to four words overlaps where it stands word for word. Items without words or with a null id are
    never found, and a null document overlaps nothing. Repeated ids count as one document. Other columns are ignored. Without hits: no rows.

    Short items have masks of their own, which documents are hashed by only if there are items of that length.
    The benchmark is broadcast only if its counted seed hashes and words are few; else both sides are
    shuffled. Documents without hits are not read into the verification.
    """
    items = texts_of(benchmark, item_col, item_text_col).select(F.col("doc_id").alias("id"), word_hashes(F.col("text")).alias("hashed"))
    items = stage(items.where(F.size("hashed") > 0).where(F.col("id").isNotNull()), "items")
    sizes = [r[0] for r in items.select(F.least(F.size("hashed"), F.lit(run))).distinct().collect()]  # at most ``run`` numbers
    masks = {size: masks_of(size, seeds, run, alike) for size in sizes}
    own = [seed_hits(items.where(F.least(F.size("hashed"), F.lit(run)) == size), m) for size, m in sorted(masks.items())]
    if not own:
        own = [seed_hits(items, seeds)]
    hit_items = own[0]
    for more in own[1:]:
        hit_items = hit_items.unionByName(more)
    seeds = tuple(sorted({m for found in masks.values() for m in found})) or seeds
    wanted = stage(hit_items.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("hash").alias("wanted")), "wanted")
    n_wanted = wanted.count()
    n_items, n_words = items.agg(F.count("*"), F.coalesce(F.sum(F.size("hashed")), F.lit(0))).first()
    texts = texts_of(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    hashed = texts.select(F.col("doc_id").alias("id"), word_hashes(F.col("text")).alias("hashed"))
    hits = seed_hits(hashed, seeds).join(small_side(wanted, n_wanted), F.col("hash") == F.col("wanted"))
    hits = stage(hits.select("id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "hits")
    found = stage(hits.select(F.col("id").alias("doc_id")).distinct(), "found")
    n_found = found.count()
    n_hits = hits.count()
    theirs = texts.join(small_side(found, n_found), "doc_id", "left_semi").select(F.col("doc_id").alias("its"), word_hashes(F.col("text")).alias("doc_words"))
    along = theirs.join(small_side(hits, n_hits), F.col("its") == F.col("id")).drop("its")
    # beyond the broadcast's bound both sides are shuffled by item, and only the words that the item can cover go along
    size = F.size("item_words")
    its_items = items.select(F.col("id").alias("its_item"), F.col("hashed").alias("item_words"))
    laid = along.join(small_side(its_items, n_items + n_words), F.col("item_id") == F.col("its_item"))
    laid = laid.select(
        "id", "item_id", "shift", "item_words",
        F.slice("doc_words", F.greatest(F.col("shift"), F.lit(0)) + 1, size).alias("beside"),
        F.greatest(-F.col("shift"), F.lit(0)).alias("item_word"),
    )
    fit = F.least(F.size("beside"), F.size("item_words") - F.col("item_word"))
    equal = F.transform(F.slice("beside", 1, fit), lambda w, i: (w == F.get(F.col("item_words"), i + F.col("item_word"))).cast("int"))
    compared = laid.select("id", "item_id", "shift", "item_word", F.size("item_words").alias("size"), equal.alias("equal"))
    length = F.least(F.lit(run), F.col("size"))
    checked = compared.withColumn("best", _best_run(F.col("equal"), length))
    checked = checked.where(F.col("best") >= F.ceil(length * alike))
    best = F.struct(_total("equal").alias("n_equal"), (-F.col("shift")).alias("back"), F.col("item_word"), F.size("equal").alias("n_words"))
    return (
        checked.groupBy(F.col("id").alias("doc_id"), "item_id")
        .agg(F.max(best).alias("best"), F.countDistinct("shift").alias("n_places"))
        .select(
            "doc_id", "item_id",
            F.greatest(-F.col("best.back"), F.lit(0)).alias("doc_word"),
            "best.item_word", "best.n_words", "best.n_equal", "n_places",
        )
    )


def _total(column: str) -> Column:
    return F.aggregate(column, F.lit(0), lambda a, x: a + x)


def _best_run(equal: Column, length: Column) -> Column:
    """Most equal words in a run of ``length`` words, or in all there are; each run is added up by itself, so time grows with the words."""
    last = F.greatest(F.size(equal) - length, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(equal, i + 1, length), F.lit(0), lambda a, x: a + x))
    return F.array_max(runs)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text overlaps no benchmark item.

    Decided row by row: rows are told apart by id and text, null ids are compared like others, and of rows with one id
    only those with an overlap go. All columns stay.
    """
    keyed = docs.select(row_key(docs).alias("doc_id"), docs["text"].alias("text"))
    found = stage(overlaps(keyed, benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return docs.join(small_side(found, found.count()), row_key(docs) == found["leaked"], "left_anti")
