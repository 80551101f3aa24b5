"""Document fingerprints by winnowing, in built-in functions only.

Every run of ``k`` words has a hash; of every ``window`` consecutive hashes the smallest is chosen,
the rightmost among equals, and kept with its word position. Any run of words of length
``window + k - 1`` or more that two texts share gives them a common chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import stage
from .common import small_side, texts_of

#: Parts that each id range is cut into.
SUBRANGES = 8
#: Low bits of a chosen value that hold the complement of the position, so that the smallest of equal
#: hashes is the rightmost one. The hash keeps the 40 bits above.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    spaced = F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def chosen(text: Column, k: int = 5, window: int = 4) -> Column:
    """Array of the chosen values (hash above, position's complement below), by position; equal texts give equal arrays.

    A text of fewer than ``k`` words has one value, that of all its words; one without words (null,
    empty, white space) has none. Positions count words from 0, modulo 2 to the 24th.
    """
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def valued(h: Column) -> Column:
        n = F.size(h)

        def gram(x: Column, i: Column) -> Column:
            rest = [F.get(h, i + F.lit(j)) for j in range(1, k)]
            return F.xxhash64(x, *rest).bitwiseAND(~PLACES) + (F.lit(PLACES) - i.bitwiseAND(PLACES))

        grams = F.transform(F.slice(h, 1, F.greatest(n - (k - 1), F.least(n, F.lit(1)))), gram)

        def least(v: Column) -> Column:
            first = F.slice(v, 1, F.greatest(F.size(v) - (window - 1), F.least(F.size(v), F.lit(1))))
            return F.array_distinct(F.transform(first, lambda x, i: x if window == 1 else F.least(x, *[F.get(v, i + F.lit(j)) for j in range(1, window)])))

        return let(grams, least)

    return F.coalesce(let(hashed, valued), F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashes(chosen_values: Column) -> Column:
    """Distinct hashes of the chosen values."""
    return F.array_distinct(F.transform(chosen_values, lambda v: F.shiftright(v, PLACE_BITS)))


def positions(chosen_values: Column) -> Column:
    """Word positions of the chosen values."""
    return F.transform(chosen_values, lambda v: F.lit(PLACES) - v.bitwiseAND(PLACES))


def digest(chosen_values: Column) -> Column:
    """16 hex digits for the whole array of hashes and positions."""
    return F.lower(F.lpad(F.hex(F.xxhash64(chosen_values)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes (0 to 1); two texts without words are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 4) -> DataFrame:
    """Per row: doc_id, hashes, positions (one each per chosen k-gram, by position)."""
    values = docs.select(docs[id_col].alias("doc_id"), chosen(docs[text_col].cast("string"), k, window).alias("values"))
    return values.select("doc_id", F.transform("values", lambda v: F.shiftright(v, PLACE_BITS)).alias("hashes"), positions(F.col("values")).alias("positions"))


def _placed(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds ``part``, ascending with doc_id: id ranges of about equal rows, each cut into ``SUBRANGES`` of equal width.

    The cuts are as many values as ranges (255 at most), whatever the data. Null ids come first, parted by their text.
    """
    cuts = docs.where(F.col("doc_id").isNotNull()).stat.approxQuantile("doc_id", [i / ranges for i in range(ranges + 1)], 0.2 / ranges)
    cuts = sorted({int(c) for c in cuts}) or [0]
    lows = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    widths = F.array(*[F.lit(max(1, -(-(b - a) // SUBRANGES))).cast("bigint") for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])])
    at = F.greatest(F.size(F.filter(lows, lambda low: low <= F.col("doc_id"))) - 1, F.lit(0))
    placed = docs.withColumn("at", at).withColumn(
        "sub",
        F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SUBRANGES)))
        .otherwise(F.least(F.greatest(F.floor((F.col("doc_id") - F.get(lows, F.col("at"))) / F.get(widths, F.col("at"))), F.lit(0)), F.lit(SUBRANGES - 1))),
    )
    return placed.withColumn("part", F.when(F.col("doc_id").isNull(), F.col("sub")).otherwise((F.col("at") + 1) * SUBRANGES + F.col("sub")).cast("int")).drop("at", "sub")


def with_next(docs: DataFrame, k: int = 5, window: int = 4, ranges: int | None = None) -> DataFrame:
    """doc_id, text, values, and next_text, next_values: those of the next row in descending doc_id.

    After the last row comes the first; null ids are last; equal ids are ordered by text; a single row
    is its own next. Each text is shuffled once, to its id range, and the first row of every range
    goes as a guest to the range before it as well, so that no order of all rows is needed.
    ``docs``: doc_id, text.
    """
    spark = docs.sparkSession
    placed = _placed(docs, ranges or min(255, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    heads = stage(placed.groupBy("part").agg(F.max("doc_id").alias("head")), "heads")
    order = Window.orderBy(F.desc("part"))  # one row a part
    hosts = heads.select("part", "head", F.coalesce(F.lag("part").over(order), F.min("part").over(Window.partitionBy())).alias("host"))
    its = hosts.select(F.col("part").alias("of"), F.col("head"), "host")
    its = small_side(its, heads.count())
    met = placed.join(its, (placed["part"] == its["of"]) & placed["doc_id"].eqNullSafe(its["head"]))
    guests = met.groupBy("of", "host", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("host").alias("part"), F.lit(True).alias("guest"))
    rows = placed.select("doc_id", "text", "part", F.lit(False).alias("guest")).unionByName(guests)
    rows = rows.repartition("part").withColumn("values", chosen(F.col("text"), k, window))
    follow = Window.partitionBy("part").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    rows = rows.select("doc_id", "text", "guest", "values", F.lead("text").over(follow).alias("next_text"), F.lead("values").over(follow).alias("next_values"))
    return rows.where(~F.col("guest")).drop("guest")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 4) -> DataFrame:
    """Fingerprint of every row's whole text, of its edited text, and their likenesses.

    The edited text has the last third (rounded down) of the code points replaced by as many first code
    points of the next row's text in descending doc_id, or by all it has. Per row: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is the
    empty text, whose fingerprint has no hashes and is like that of any other text without words.
    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    pairs = with_next(texts_of(docs, id_col, text_col), k, window)
    n = F.length("text").cast("bigint")
    third = F.floor(n / 3).cast("int")
    edited = pairs.select(
        "doc_id", n.alias("n_chars"), "values", "next_values",
        F.concat(F.substring("text", F.lit(1), n.cast("int") - third), F.substring("next_text", F.lit(1), third)).alias("edited"),
    )
    marked = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "values", "next_values", chosen(F.col("edited"), k, window).alias("edited_values"))
    sets = marked.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("values")).alias("fingerprint"), digest(F.col("edited_values")).alias("edited_fingerprint"),
        hashes(F.col("values")).alias("own"), hashes(F.col("edited_values")).alias("changed"), hashes(F.col("next_values")).alias("following"),
    )
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
