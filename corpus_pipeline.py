"""From raw documents to packed training sequences: five stages over the whole table.

Each stage works on everything that its predecessor kept, and its decisions take
effect: toxic documents go, of equal texts and of near-duplicate groups one
document stays (rows are told apart by all their columns, so ids may be null or
repeat), personal data is replaced in the text, and what is left is packed.  All
stages but the last return the columns of ``documents``.

A stage handles nulls in any column (a null text counts as empty and stays null),
empty tables, and columns beyond those it needs, which it passes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact, packing, pii, simhash, toxicity
from strandlake.llm.common import WRITTEN, dropped, free_name, stored, table
from strandlake.llm.queries import learning_rows


def _row_hash(docs: DataFrame) -> Column:
    """Tells rows apart by all their columns that can be hashed; maps and variants cannot."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def _first_of_each(docs: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """Of the rows (doc_id, row_hash, ``group``) of ``found``, one row of ``docs`` for each group: that of smallest doc_id, a null id last.

    Of rows with one id the least hash of all columns decides; of rows alike in all columns one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "n")
    counted = found.groupBy(group, "doc_id", "row_hash").agg(F.count("*").alias("n"))
    name, own_id, own_hash, copies = (free_name(docs.columns, x) for x in ("row_hash", "chosen_id", "chosen_hash", "chosen_copies"))
    least = counted.groupBy(group).agg(F.min(rank).alias("m"))
    chosen = stored(least.select(F.col("m.doc_id").alias(own_id), F.col("m.row_hash").alias(own_hash), F.col("m.n").alias(copies)), "chosen")
    marked = docs.withColumn(name, _row_hash(docs))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col(own_id))) & (F.col(name) == F.col(own_hash))
    taken = lambda rows: marked.join(rows.select(own_id, own_hash), same, "left_semi")
    columns = [f"`{c}`" for c in docs.columns]
    again = chosen.where(F.col(copies) > 1)
    if again.isEmpty():
        return taken(chosen).select(*columns)
    return taken(chosen.where(F.col(copies) == 1)).unionByName(taken(again).dropDuplicates([name])).select(*columns)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    return toxicity.accepted(docs, toxicity.fit(learning_rows(docs, table(spark, sf_dir, "labels"))))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, one: that with the largest doc_id."""
    found = exact.exact_duplicates(docs, also={"row_hash": _row_hash(docs)})
    return _first_of_each(docs, found.where("kept"), "digest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, one: that with the smallest doc_id, whatever its id is if none has any."""
    return _first_of_each(docs, simhash.near_duplicates(docs, also={"row_hash": _row_hash(docs)}), "group")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced and their length brought up to date."""
    done = pii.redacted(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return done if length is None else done.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.ids_crc32, "ids_crc32 long")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The stages learn models and fingerprints that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again; what a stage needed besides is deleted when its result is there."""
    docs, before = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(spark, WRITTEN[before:-1])
    return docs
