"""Helpers of the package: hashing of words in whole texts, packed columns, written stages, grouping of hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.session import shared_dir

MASK = (1 << 64) - 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 17
_BASE = 0x2545F4914F6CDD1D  # of the polynomial that hashes a word; odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
BATCH = 4 << 20  # bytes of a batch of rows that goes to Python
_BATCH_KEY, _BATCH_USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (an invertible finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values(gap: np.ndarray) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = values[_FOLD]
    values[gap] = 0
    return values


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words_of(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE, heads: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and row of each word, A-Z lower-cased.

    ``gap`` tells the bytes between words (a table of 256), white space if not given.  With ``heads``
    the hashes have one column more for each: that of the word's first so many bytes, 0 if it has no more.
    Works on the bytes of a whole column at once; the hash is a polynomial in the
    byte's place inside its word, summed in blocks so that memory stays bounded.
    """
    shape = (1 + len(heads),) if heads else ()
    if not len(data):
        return np.zeros((0, *shape), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] |= inside[begins]
    starts = np.flatnonzero(first)
    del first, inside
    if not len(starts):
        return np.zeros((0, *shape), np.uint64), starts, starts
    rows = np.searchsorted(offsets, starts, side="right") - 1
    table = _byte_values(gap)
    hashes = np.empty((len(starts), *shape), np.uint64)
    bounds = np.append(starts, len(data))
    powers, back = np.ones(1, np.uint64), np.ones(1, np.uint64)
    w = 0
    while w < len(starts):
        e = max(w + 1, int(np.searchsorted(bounds, bounds[w] + _BLOCK, side="right")) - 1)
        e = min(e, len(starts))
        chunk, rel = data[bounds[w] : bounds[e]], bounds[w : e + 1] - bounds[w]
        if len(chunk) > len(powers):
            powers = np.cumprod(np.full(len(chunk), _BASE, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            back = np.cumprod(np.append(np.uint64(1), np.full(len(chunk) - 1, _INVERSE, np.uint64)))
        if heads:
            place = np.arange(len(chunk)) - np.repeat(rel[:-1], np.diff(rel))
            parts = table[chunk] * powers[place]
            whole = np.add.reduceat(parts, rel[:-1])
            hashes[w:e, 0] = whole
            for k, head in enumerate(heads, 1):
                first = np.add.reduceat(np.where(place < head, parts, np.uint64(0)), rel[:-1])
                hashes[w:e, k] = np.where(first == whole, np.uint64(0), first ^ np.uint64(head))
        else:  # by the byte's place in the chunk, and then back by that of the word's first
            parts = table[chunk]
            parts *= powers[: len(chunk)]
            hashes[w:e] = np.add.reduceat(parts, rel[:-1]) * back[rel[:-1]]
        w = e
    return mix(hashes), starts, rows


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles; a shorter row is one shingle."""
    factors = mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    full = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width if len(full) else 0):
        full += hashes[k : k + len(full)] * factors[k]
    full = mix(full)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            keys = np.sort(full[a : b - width + 1])
            sets.append(keys[np.append(True, keys[1:] != keys[:-1])])
        elif b > a:
            tagged = np.append(hashes[a:b] * factors[: b - a], np.uint64((b - a) * 0x632BE59BD9B4E019 & MASK))
            sets.append(mix(tagged.sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(full[:0])
    return sets


def set_digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 63-bit digest of each set of hashes; none may be empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(sizes):
        return sizes
    keys = mix(np.concatenate(sets) ^ np.uint64(0xD6E8FEB86659FD93))
    total = np.add.reduceat(keys, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)
    return (mix(total) >> np.uint64(1)).astype(np.int64)


def pack48(keys: np.ndarray) -> bytes:
    """The low 48 bits of each hash, six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def written(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: lineage ends there, and any executor can read it."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH`` bytes.  By Spark's own limits a batch may be all texts of a partition, in the JVM and the worker at once.

    A size that the session names itself stays.
    """
    if spark.conf.get(_BATCH_KEY) == _BATCH_USUAL:
        spark.conf.set(_BATCH_KEY, f"{BATCH}b")


def give_back() -> None:
    """Return what a task has freed to the system: Spark keeps its Python worker, and its memory, for tasks of other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def attach_group(df: DataFrame, key: str, salt: Column, salts: int, **aggs: Column) -> DataFrame:
    """Left-join aggregates of each row's group, whose sizes may differ by any factor.

    ``aggs`` must be mins, maxes or sums (safe to apply to their own results, given
    as ``name=(column, function)``).  Rows are dealt by (key, salt), so a key with a
    third of all rows is ``salts`` groups; their ``salts`` results per key are
    aggregated again and joined back by (key, salt).
    """
    salted = df.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    part = salted.groupBy(F.col(key).alias("__k"), F.col("__salt").alias("__s")).agg(
        *[f(c).alias(name) for name, (c, f) in aggs.items()]
    )
    whole = part.groupBy(F.col("__k").alias("__w")).agg(*[f(F.col(name)).alias(name) for name, (_, f) in aggs.items()])
    lookup = part.select("__k", "__s").join(whole, F.col("__k").eqNullSafe(F.col("__w"))).drop("__w")
    same = salted[key].eqNullSafe(lookup["__k"]) & (salted["__salt"] == lookup["__s"])
    return salted.join(lookup, same, "left").select(*[salted[c] for c in df.columns], *aggs)


def components(links: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, label) for every end of ``links`` (a, b): label is the least node of its connected component.

    Alternating large-star and small-star rounds: every node is tied to the least
    node it knows, first for its larger neighbours, then for itself and its smaller
    ones, until nothing changes; the number of rounds grows with the logarithm of
    the longest chain.  Each round is written to the shared folder.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m"))
        tied = both.join(least, both["u"] == least["c"])
        if large:
            out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.select(F.col("c").alias("u"), F.col("m").alias("v"))
            )
        return out.where(F.col("u") != F.col("v")).distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), spark, "links")
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = written(star(star(edges, True), False), spark, "stars")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
