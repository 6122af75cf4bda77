"""Embedding near-dedup by iterative quantisation.

A rotation learned on a bounded sample turns each vector into a balanced binary
code.  Distinct codes are retrieved through multi-index Hamming tables: the code
is cut into blocks, and a table for each bit of each block holds the block
without that bit, so two codes that differ by at most one bit in some block meet
in a table; with more codes than such tables have buckets, wider and more tables
take their place.  Codes within ``MAX_BITS`` bits stay candidates, and the original
vectors behind a candidate pair are compared in double precision, block against
block.

Equal vectors are one weighted class throughout.  A code with many vectors is
cut into chunks of bounded size, and pairs of chunks are compared by a matrix
product that returns a count and a local root for each vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, by_class, small_batches, stored
from .graph import components

BITS = 64
#: Vectors on which the rotation is learned, at most.
SAMPLE = 20_000
#: Rounds of rotation and rounding.
ROUNDS = 30
#: Codes further apart than this are not compared.
MAX_BITS = 14
#: Vectors in a chunk at about.
CHUNK = 1024


def learn_rotation(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of ``(x - mean) @ projection`` are balanced codes.

    Principal directions first, then a rotation that alternates with rounding to
    the nearest corner of the cube.
    """
    rng = np.random.default_rng(seed)
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    centred = vectors - mean
    values, directions = np.linalg.eigh(centred.T @ centred / max(1, len(vectors)))
    basis = directions[:, np.argsort(values)[::-1][:bits]]
    if basis.shape[1] < bits:
        basis = np.concatenate((basis, np.zeros((basis.shape[0], bits - basis.shape[1]))), axis=1)
    flat = centred @ basis
    rotation, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    for _ in range(rounds):
        corners = np.where(flat @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(corners.T @ flat)
        rotation = right.T @ left.T
    return mean, basis @ rotation


def codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """A 64-bit code of each unit vector."""
    return np.packbits((vectors - mean) @ projection >= 0, axis=1).view(np.int64).ravel()


def table_masks(count: int, blocks: int = 4, seed: int = 29) -> np.ndarray:
    """Bits that each Hamming table looks at, for so many codes.

    While codes are few a table looks at a block without one of its bits.  As
    they grow, buckets would hold ever more of them, so tables look at as many
    bits as the count has; blocks are cut from the bits in several orders, and
    there are more tables by what a bit more costs two codes a tenth apart.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    base = [sum(1 << k for k in range(a, b) if k != j) for a, b in zip(edges, edges[1:]) for j in range(a, b)]
    narrow = BITS // blocks - 1
    wide = min(BITS // 2, count.bit_length() - 1)
    if wide <= narrow:
        return np.array(base, np.uint64)
    rng, found = np.random.default_rng(seed), []
    while len(found) < len(base) * (1 / 0.9) ** (wide - narrow):
        order = rng.permutation(BITS)
        found += [sum(1 << int(k) for k in order[at : at + wide]) for at in range(0, BITS - wide + 1, wide)]
    return np.array(found, np.uint64)


def _unit(raw: bytes, rows: int) -> np.ndarray:
    """Vectors laid end to end, as rows of length one."""
    found = np.frombuffer(raw, np.float64).reshape(rows, -1)
    return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def code_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = 4) -> DataFrame:
    """(a, b) with a < b for distinct codes ``code`` that meet in a table and lie within ``max_bits`` bits.

    Each pair comes once, from the first table in which the two meet.
    """
    masks = table_masks(distinct.count(), blocks)
    signed = masks.view(np.int64).tolist()
    rows = distinct.select("code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in signed])).alias("which", "part"))
    dealt = rows.repartition("which", "part").sortWithinPartitions("which", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"code": np.empty(0, np.int64), "which": np.empty(0, np.int64), "part": np.empty(0, np.int64)})

        def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            code, which, part = (pdf[c].to_numpy(np.int64) for c in ("code", "which", "part"))
            at, shift = np.arange(len(code)), 1
            while len(at := at[at + shift < len(code)]):
                at = at[(which[at] == which[at + shift]) & (part[at] == part[at + shift])]
                x = code[at].view(np.uint64) ^ code[at + shift].view(np.uint64)
                near = np.bitwise_count(x) <= max_bits
                pick, x = at[near], x[near]
                first = ((x[:, None] & masks[None, :]) == 0).argmax(axis=1) if len(x) else np.empty(0, np.int64)
                own = first == which[pick]
                if own.any():
                    one, two = code[pick[own]], code[pick[own] + shift]
                    yield pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two)})
                shift += 1

        for pdf in batches:
            both = pd.concat((held, pdf), ignore_index=True)
            if not len(both):
                continue
            last = (both["which"] == both["which"].iloc[-1]) & (both["part"] == both["part"].iloc[-1])
            yield from work(both[~last])
            held = both[last]
        yield from work(held)

    return dealt.mapInPandas(run, "a long, b long")


def _compare(threshold: float):
    """For two chunks of vectors: how many weighted links each vector has, and a root it is linked to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                one, two = _unit(row.vectors_a, len(row.ids_a)), _unit(row.vectors_b, len(row.ids_b))
                ids_a, ids_b = np.asarray(row.ids_a, np.int64), np.asarray(row.ids_b, np.int64)
                weight_a, weight_b = np.asarray(row.weights_a, np.int64), np.asarray(row.weights_b, np.int64)
                linked = one @ two.T >= threshold
                linked &= ids_a[:, None] != ids_b[None, :]
                if not linked.any():
                    continue
                same = len(ids_a) == len(ids_b) and bool((ids_a == ids_b).all())
                ids = ids_a if same else np.r_[ids_a, ids_b]
                count = linked @ weight_b if same else np.r_[linked @ weight_b, weight_a @ linked]
                root_a, root_b = ids_a.copy(), ids_b.copy()
                while True:
                    low_a = np.minimum(root_a, np.where(linked, root_b[None, :], np.iinfo(np.int64).max).min(axis=1))
                    low_b = np.minimum(root_b, np.where(linked, low_a[:, None], np.iinfo(np.int64).max).min(axis=0))
                    if (low_a == root_a).all() and (low_b == root_b).all():
                        break
                    root_a, root_b = low_a, low_b
                root = root_a if same else np.r_[root_a, root_b]
                kept = count > 0
                yield pd.DataFrame({"cid": ids[kept], "n": count[kept], "root": root[kept]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", max_bits: int = MAX_BITS, blocks: int = 4, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    n_links counts the other rows at cosine ``threshold`` or more that the tables
    retrieve; component_id is the smallest vec_id reachable by links, the row's
    own included; kept: vec_id = component_id.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing.  Vectors of
    different lengths compare as if padded with zeros.  Rows that repeat a
    vec_id count as vectors of their own.  Further columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    wide = vectors.agg(F.max(F.size(embedding))).first()[0] or 0
    entry = F.col(embedding).cast("array<double>")
    usable = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(entry, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(entry, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), entry).alias("v"))

    def pad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                if v is None:
                    out.append(None)
                    continue
                full = np.zeros(wide)
                full[: len(v)] = v
                full += 0.0  # minus zero and zero are the same vector
                scale = np.abs(full).max()
                out.append((full / scale if not 1e-100 < scale < 1e100 else full).tobytes())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": out})

    small_batches(spark, rows=2000)
    as_bytes = stored(rows.select(F.col("vec_id").cast("string").alias("vec_id"), "v").mapInPandas(pad, "vec_id string, vec binary").select(F.col("vec_id").cast("long").alias("vec_id"), "vec"), "vectors")
    grouped = as_bytes.where(F.col("vec").isNotNull()).groupBy("vec").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    taken = [r[0] for r in bounded_sample(classes.select("vec"), ["vec"], sample).collect()]
    mean, projection = learn_rotation(_unit(b"".join(taken), len(taken)) if taken else np.zeros((0, max(1, wide))))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(code=codes(_unit(b"".join(pdf["vec"]), len(pdf)), mean, projection))

    coded = stored(classes.select("cid", "weight", "vec").mapInPandas(encode, "cid long, weight long, vec binary, code long"), "codes")
    per_code = stored(coded.groupBy("code").agg(F.count("*").alias("members")), "distinct-codes")
    many = per_code.where("members > 1").select(F.col("code").alias("a"), F.col("code").alias("b"))
    small_batches(spark, rows=32_768)
    pairs = stored(code_pairs(per_code.select("code"), max_bits, blocks).unionByName(many), "code-pairs")
    parts = per_code.select("code", F.ceil(F.col("members") / chunk).alias("parts"))
    used = pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct().join(parts, "code")
    chunks = (
        coded.join(used, "code")
        .groupBy("code", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("cid", "weight", "vec")).alias("m"))
        .select("code", "part", F.col("m.cid").alias("ids"), F.col("m.weight").alias("weights"), F.concat_ws("", F.transform("m.vec", F.hex)).alias("hexes"))
        .select("code", "part", "ids", "weights", F.unhex("hexes").alias("vectors"))
    )
    chunks = stored(chunks, "chunks")
    count = lambda side: used.select(F.col("code").alias(side), F.col("parts").alias(f"parts_{side}"))
    blocks_of = (
        pairs.join(count("a"), "a")
        .join(count("b"), "b")
        .withColumn("part_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_a") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("part_a")).otherwise(F.lit(0).cast("long")), F.col("parts_b") - 1)))
        .select("a", "b", "part_a", "part_b")
    )
    side = lambda x: chunks.select(F.col("code").alias(x), F.col("part").alias(f"part_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("ids", "weights", "vectors")])
    small_batches(spark, rows=64)
    compared = stored(blocks_of.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"]).select(*[f"{c}_{x}" for x in "ab" for c in ("ids", "weights", "vectors")]).mapInPandas(_compare(threshold), "cid long, n long, root long"), "compared")
    small_batches(spark)
    totals = compared.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = components(compared.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    least = roots.join(classes.select(F.col("cid").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("cid"), "component_id")
    per_class = classes.join(totals, "cid", "left").join(linked, "cid", "left")
    per_class = per_class.select("vec", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    per_class = stored(per_class, "vector-components")
    usable = as_bytes.where(F.col("vec").isNotNull())
    out = by_class(usable, per_class, "vec", "weight", usable.count()).select("vec_id", "n_links", "component_id")
    none = as_bytes.where(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.unionByName(none)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
