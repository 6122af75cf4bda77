"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Every run of ``WINDOW`` consecutive words of a benchmark item is a window (an
item of fewer words is one window).  Of the hashes of the ``GRAM``-word grams in
each window the smallest is kept as its fingerprint.  A document keeps the
smallest hash of every window of its own in the same way, so a window that it
shares with an item is sure to share its fingerprint, while only about two in
seven grams are looked up.  Where a document's fingerprint is one of an item's,
the hit is extended over the words around it: each window of the document that
holds the gram is compared, word for word, with the items' windows.

Documents are read once and their texts never shuffled: what leaves the scan is
one row a document and the few words around each hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

#: Words of a window, words of a hashed gram.
WINDOW, GRAM = 10, 5
#: Rows up to which a side made from the benchmark is broadcast; larger ones are shuffled.
FEW = 200_000
#: A gram's smallest hash carries the gram's place in its lower bits.
PLACE_BITS = 30
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The runs of characters that are digits, letters or beyond ASCII, A-Z lower-cased word by word (``lower`` where a word is ASCII, which is faster)."""
    small = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), ""), small)


def gram_hashes(words_column: str, size: str, gram: int) -> Column:
    """The hash of each gram, its lower bits the gram's place."""
    high, place = F.lit(-1 << PLACE_BITS), lambda i: i.cast("long")
    return F.transform(F.sequence(F.lit(0), F.col(size) - gram), lambda i: F.xxhash64(*[F.get(words_column, i + k) for k in range(gram)]).bitwiseAND(high).bitwiseOR(place(i)))


def smallest(hashes: str, size: str, window: int, gram: int) -> Column:
    """The smallest hash of each window of words, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.col(size) - window), lambda i: F.least(*[F.get(hashes, i + k) for k in range(window - gram + 1)])))


def fingerprints(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds ``prints``, an array of (hash, first, around): of each fingerprint of ``words`` (``size`` many) the words of all windows that hold its gram.

    ``first`` is the place of the first of those words.
    """
    full = F.col("size") >= window
    hashed = rows.withColumn("_hashes", F.when(full, gram_hashes("words", "size", gram)))
    least = hashed.withColumn("_least", F.when(full, smallest("_hashes", "size", window, gram)))
    place = lambda v: v.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    first = lambda v: F.greatest(place(v) - (window - gram), F.lit(0))
    around = lambda v: F.slice("words", first(v) + 1, place(v) + window - first(v))
    prints = F.transform("_least", lambda v: F.struct(v.bitwiseAND(F.lit(-1 << PLACE_BITS)).alias("hash"), first(v).alias("first"), around(v).alias("around"), F.lit(window).alias("length")))
    return least.withColumn("prints", prints).drop("_hashes", "_least")


def short_prints(length: int) -> Column:
    """Every run of ``length`` words as a fingerprint of its own, for items that short."""
    run = lambda i: F.slice("words", i + 1, length)
    return F.when(F.col("size") >= length, F.transform(F.sequence(F.lit(0), F.col("size") - length), lambda i: F.struct(F.xxhash64(run(i)).alias("hash"), i.alias("first"), run(i).alias("around"), F.lit(length).alias("length"))))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, length, words) of every window of every item (item_id, text); a null id is an item named ''."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).withColumn("size", F.size("words")).where("size > 0")
    length = F.least("size", F.lit(window))
    places = cut.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("first"))
    return places.select("item", "length", F.slice("words", F.col("first") + 1, F.col("length")).alias("words"))


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, broadcast if they are no more than ``FEW``."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row of ``docs`` (doc_id, text, and any others).

    ``n_hit`` counts the document's words inside any occurrence of a window of
    ``items`` (item_id, text); the array ``items`` has the ids, as strings in
    order, of the items with occurring windows, each once.  A null text has no
    words; repeated rows each get a row; rows of one item_id are one item.  An
    item without words has no windows.  Empty tables give no hits, or no rows.
    """
    parts = stored(item_windows(items, window).select("item", "length", F.array_join("words", " ").alias("window"), "words").distinct(), "item-windows")
    lengths = sorted(r[0] for r in parts.select("length").distinct().collect())
    whole = parts.where(F.col("length") == window).select("words", F.size("words").alias("size"))
    # A window has one smallest hash; an item shorter than a window is hashed as it is.
    known = fingerprints(whole, window, gram).select(F.explode("prints.hash").alias("hash"))
    known = known.unionByName(parts.where(F.col("length") < window).select(F.xxhash64("words").alias("hash"))).distinct()
    known = stored(known.withColumn("known", F.lit(True)), "item-fingerprints")

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row")).withColumn("size", F.size("words"))
    marked = fingerprints(cut, window, gram)
    kind = "array<struct<hash:bigint,first:int,around:array<string>,length:int>>"
    # A row of its own stands for the document; it is not looked up, its hash only deals it out.
    mark = F.array(F.struct(F.xxhash64("row").alias("hash"), F.lit(-1).alias("first"), F.lit(None).cast("array<string>").alias("around"), F.lit(0).alias("length")))
    every = [mark.cast(kind), *[F.coalesce(c.cast(kind), F.array().cast(kind)) for c in ([F.col("prints")] if window in lengths else []) + [short_prints(n) for n in lengths if n < window]]]
    spread = marked.select("doc_id", "row", "size", F.explode(F.concat(*every)).alias("p")).select("doc_id", "row", "size", "p.*")
    found = spread.join(_small(known), "hash", "left").where("known or first < 0").drop("hash", "known")
    found = stored(found, "fingerprint-hits")

    lookup = _small(stored(parts.select("window", "length").distinct(), "window-texts"))
    tried = found.where("first >= 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.size("around") - F.col("length"))))
    texts = tried.select("row", (F.col("first") + F.col("at")).alias("begin"), "length", F.array_join(F.slice("around", F.col("at") + 1, F.col("length")), " ").alias("window"))
    hits = stored(texts.join(lookup, ["window", "length"]).distinct(), "window-hits")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["reach"], x["end"].cast("long")).alias("reach"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["reach"], x["begin"].cast("long")))).alias("n")),
        lambda a: a["n"],
    )
    n_hit = hits.groupBy("row").agg(covered.alias("n_hit"))
    owners = _small(stored(parts.select("item", "window").distinct(), "window-items"))
    named = hits.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct()
    ids = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return (
        found.where("first < 0")
        .select("row", "doc_id", F.col("size").cast("long").alias("n_words"))
        .join(n_hit, "row", "left")
        .join(ids, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )
