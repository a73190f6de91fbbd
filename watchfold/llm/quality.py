"""Quality filter: an interpolated modified Kneser-Ney model of the bytes of trusted text.

N-grams are numbers in base 257 (a byte plus one; 0 stands before a text), so the table of
counts is open and grows with the trusted text.  Counts are combined in each task, summed
by n-gram, and joined with the totals of their contexts, sharded by context; lower
orders count the distinct continuations of the order above.

Documents are scored in blocks of bounded size.  A block asks for each of its distinct
n-grams once; requests and model meet by shard, which is the pair of bytes before
the last two contexts end in, so that an n-gram, its shorter forms and all their contexts are in one
shard.  The answers go back to the block, where the documents' perplexities are summed.
Of the model only orders 1 and 2 are sent to all tasks: 257 ** 2 numbers at most.

A document is rejected if its perplexity (steadied by a little average text) lies above its
language's quantile among trusted documents the model has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchfold.llm.common import bounded_batches, give_back, mix, pack48, text_buffer, unpack48, written

ORDER = 5  # at most 5: longer n-grams do not fit into 48 bits
FOLDS = 5  # one fold in FOLDS of the trusted documents sets the thresholds and is not trained on
QUANTILE = 0.995
PRIOR = 64  # symbols of average trusted text added to each document, so that a few words alone reject nothing
SLACK = 0.05  # nats a symbol by which a document may lie above its language's quantile
SENT = 1_000_000  # trusted ids that may be broadcast
BLOCK = 8 << 20  # bytes of text that ask together
SHARD_ROWS = 200_000  # n-grams of the model that a shard is meant to hold
TURN = 256  # blocks that meet a shard at once
_BASE = 257
_STEP = 1 / 2048  # nats; an answer is rounded to whole steps
_BYTES = 1 << 20
_HELD = 1 << 21  # n-grams a task holds before it sends their counts on


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, as a number; places before a text are 0."""
    symbols = data.astype(np.int64) + 1
    number, at = symbols.copy(), np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, min(ORDER, len(data))):
        before = symbols[:-k] * _BASE**k
        before[at[k:] < k] = 0
        number[k:] += before
    return number


def _pieces(texts: pa.Array):
    """(first row, bytes, offsets) of runs of rows; a long text is a run of its own."""
    data, offsets = text_buffer(texts)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BYTES, side="right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return found, np.bincount(at, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def gram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts, combined per task before the shuffle."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, data, offsets in _pieces(batch.column(0)):
                held.append(np.unique(grams(data, offsets), return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [_counted(held)]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield pa.record_batch([*map(pa.array, held.pop())], ["gram", "n"])
                        size = 0
        if held:
            yield pa.record_batch([*map(pa.array, _counted(held))], ["gram", "n"])
        del held
        give_back()

    return texts.select(text_col).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n = dict(counts.where("n <= 4").groupBy("n").agg(F.count("*")).collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]


def model(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(size, gram, share, context, rest) of the n-grams of all sizes; ``counts`` (gram, n) are those of the highest.

    ``share`` is an n-gram's own part of its context's probability, ``rest`` what its context leaves to the size below.
    """
    levels, level = [], written(counts, spark, "grams")
    for size in range(ORDER, 0, -1):
        d1, d2, d3 = _discounts(level)
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = ((F.col("gram") - F.pmod("gram", F.lit(_BASE))) / _BASE).cast("bigint")
        totals = level.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("spared"))
        joined = level.withColumn("own", context).join(totals, F.col("own") == F.col("context"))
        levels.append(joined.select(F.lit(size).alias("size"), "gram", ((F.col("n") - off) / F.col("total")).alias("share"), "context", (F.col("spared") / F.col("total")).alias("rest")))
        if size > 1:  # the size below counts in how many n-grams of this one it ends
            below = F.pmod("gram", F.lit(_BASE ** (size - 1)))
            level = written(level.groupBy(below.alias("gram")).agg(F.count("*").alias("n")), spark, "grams")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return written(out, spark, "model")


def short_costs(kn: DataFrame) -> np.ndarray:
    """The probability of the last symbol under size 2, for each of the 257 ** 2 pairs."""
    rows = kn.where("size <= 2").select("size", "gram", "share", "context", "rest").toArrow()  # at most 257 + 257 ** 2 rows
    p = np.full(_BASE, 1 / _BASE)
    for size in (1, 2):
        at = np.flatnonzero(rows["size"].to_numpy() == size)
        gram, context = rows["gram"].to_numpy()[at], rows["context"].to_numpy()[at]
        rest = np.ones(_BASE ** (size - 1))
        rest[context] = rows["rest"].to_numpy()[at]
        p = (rest[:, None] * p[-_BASE:][None, :]).reshape(-1)  # size 1 has the one context 0
        p[gram] += rows["share"].to_numpy()[at]
    return p


def _shard(number: np.ndarray, shards: int) -> np.ndarray:
    """The shard of n-grams, from their third and second last bytes."""
    return (mix((number // _BASE % _BASE**2).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _blocks(batches, columns: int):
    """(number, rows, texts, bytes) of blocks of rows, numbered alike each time that a partition is read."""
    from pyspark import TaskContext

    number, rows, texts, size = TaskContext.get().partitionId() << 32, [[] for _ in range(columns)], [], 0
    for batch in batches:
        for n in range(batch.num_rows):
            text = (batch.column(columns)[n].as_py() or "").encode()
            if texts and size + len(text) > BLOCK:
                yield number, rows, texts, size
                number, rows, texts, size = number + 1, [[] for _ in range(columns)], [], 0
            for k in range(columns):
                rows[k].append(batch.column(k)[n].as_py())
            texts.append(text)
            size += len(text)
    if texts:
        yield number, rows, texts, size


def _distinct(texts: list[bytes]) -> np.ndarray:
    found = [np.unique(grams(data, offsets)) for _, data, offsets in _pieces(pa.array(texts, pa.large_binary()).cast(pa.large_string()))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def scores(spark: SparkSession, docs: DataFrame, kn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, symbols, nats): log-perplexity per symbol of each document; null if it has no text.

    ``docs`` is read twice and must give the same partitions both times, as tables do; if not, the job fails.
    """
    shards = max(64, kn.where(F.col("size") == ORDER).count() // SHARD_ROWS)
    shared = spark.sparkContext.broadcast(short_costs(kn))

    def ask(batches):
        for number, _, texts, size in _blocks(batches, 0):
            wanted = _distinct(texts)
            shard = _shard(wanted, shards)
            order = np.argsort(shard, kind="stable")
            there, first = np.unique(shard[order], return_index=True)
            packed = [pack48(x.astype(np.uint64)) for x in np.split(wanted[order], first[1:])] if len(wanted) else []
            # A block without any text asks nothing, but is known.
            yield pa.record_batch([pa.array([number] * (len(there) or 1), pa.int64()), pa.array(there if len(there) else [-1], pa.int64()), pa.array(packed or [b""], pa.binary())], ["block", "shard", "grams"])
            del texts, wanted, shard, order, packed
            give_back()

    text = F.col(text_col).cast("string")
    asked = written(docs.select(text).mapInArrow(ask, "block bigint, shard bigint, grams binary"), spark, "asked")
    turns = asked.select("block").distinct().count() // TURN + 1
    tall = kn.where("size > 2")

    def place(batches):
        for batch in batches:
            context = batch.column("context").to_numpy()
            yield batch.append_column("shard", pa.array(_shard(context * _BASE, shards)))

    tall = tall.mapInArrow(place, "size int, gram bigint, share double, context bigint, rest double, shard bigint")
    tall = tall.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(turns)).cast("int"))

    def answer(known: pa.Table, wanted: pa.Table) -> pa.Table:
        low, levels = shared.value, {}
        size, gram, context = (known[c].to_numpy() for c in ("size", "gram", "context"))
        share, rest = known["share"].to_numpy(), known["rest"].to_numpy()
        for k in range(3, ORDER + 1):
            at = np.flatnonzero(size == k)
            at = at[np.argsort(gram[at])]
            contexts, first = np.unique(context[at], return_index=True)
            levels[k] = gram[at], share[at], contexts, rest[at][first]

        def look(keys, values, wanted, default):
            if not len(keys):
                return np.full(len(wanted), default)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], default)

        out = []
        for packed in wanted["grams"].to_pylist():
            number = unpack48(packed).astype(np.int64)
            p = low[number % _BASE**2]
            for k, (keys, shares, contexts, rests) in levels.items():
                part = number % _BASE**k
                p = look(keys, shares, part, 0.0) + look(contexts, rests, part // _BASE, 1.0) * p
            out.append(np.clip(np.rint(-np.log(np.maximum(p, 1e-13)) / _STEP), 0, 65535).astype("<u2").tobytes())
        return pa.table([wanted["block"], wanted["shard"], pa.array(out, pa.binary())], names=["block", "shard", "nats"])

    answers = tall.groupBy("shard", "turn").cogroup(asked.groupBy("shard", "turn")).applyInArrow(answer, "block bigint, shard bigint, nats binary")

    id_kind = docs.schema[id_col].dataType.simpleString()
    id_type = docs.select(F.col(id_col)).limit(0).toArrow().schema.field(0).type

    def bundle(batches):
        import zstandard

        for number, (ids, langs), texts, _ in _blocks(batches, 2):
            lengths = np.array([len(x) for x in texts], "<i8")
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            yield pa.record_batch([pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([langs], pa.list_(pa.string())), pa.array([lengths.tobytes()], pa.binary()), pa.array([packed], pa.binary())], ["block", "ids", "langs", "lengths", "texts"])

    given = docs.select(F.col(id_col), F.col(lang_col).cast("string"), text)
    bundles = given.mapInArrow(bundle, f"block bigint, ids array<{id_kind}>, langs array<string>, lengths binary, texts binary")

    def weigh(own: pa.Table, told: pa.Table) -> pa.Table:
        import zstandard

        if own.num_rows != 1 or not told.num_rows:
            raise ValueError("documents came in other partitions when they were read again; write them first")
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(own["texts"][0].as_py()), np.uint8)
        length = np.frombuffer(own["lengths"][0].as_py(), "<i8")
        offsets = np.append(0, np.cumsum(length))
        texts = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        pieces = list(_pieces(texts))
        known = np.unique(np.concatenate([np.unique(grams(d, o)) for _, d, o in pieces]))
        shard, cost = _shard(known, shards), np.full(len(known), -1, np.int64)
        for s, packed in zip(told["shard"].to_pylist(), told["nats"].to_pylist()):
            at, got = np.flatnonzero(shard == s), np.frombuffer(packed, "<u2")
            if len(at) != len(got):
                raise ValueError("documents came in other partitions when they were read again; write them first")
            cost[at] = got
        if (cost < 0).any():
            raise ValueError("documents came in other partitions when they were read again; write them first")
        nats = np.zeros(len(length))
        for first, d, o in pieces:
            total = np.append(0, np.cumsum(cost[np.searchsorted(known, grams(d, o))]))
            nats[first : first + len(o) - 1] = np.diff(total[o]) * _STEP
        values = pa.array(nats / np.maximum(length, 1), pa.float64(), mask=length == 0)
        return pa.table([own["ids"].combine_chunks().flatten(), own["langs"].combine_chunks().flatten(), pa.array(length, pa.int64()), values], names=["id", "lang", "symbols", "nats"])

    return bundles.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, f"id {id_kind}, lang string, symbols bigint, nats double")


def judge(spark: SparkSession, docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(id, lang, symbols, perplexity, limit, kept) of each document.

    ``trusted`` (id_col) names the documents to trust.  A language without held-out trusted documents, a null
    one too, takes the limit of all languages together; with no trusted text at all nothing is rejected.  A document
    without text is kept: there is nothing to judge.  Repeated rows are judged alike; an empty
    table gives no rows; very long texts are read whole; other columns are ignored.  ``docs`` is read
    more than once: give a table, or a plan whose partitions do not change.
    """
    bounded_batches(spark)
    ids = trusted.select(F.col(id_col).alias("t")).where("t is not null").distinct()
    fold = F.pmod(F.xxhash64("t"), F.lit(FOLDS))
    seen = ids.where(fold != 0)
    # Few ids are sent to the texts; beyond that both sides are sorted by id.
    seen = F.broadcast(seen) if seen.count() <= SENT else seen.hint("merge")
    train = docs.select(id_col, text_col).join(seen, F.col(id_col) == F.col("t"), "left_semi")
    kn = model(spark, gram_counts(train, text_col))
    scored = written(scores(spark, docs, kn, id_col, text_col, lang_col), spark, "perplexity")
    unseen = scored.where("symbols > 0").join(ids.where(fold == 0), F.col("id") == F.col("t"), "left_semi")
    usual = unseen.agg(F.sum(F.col("nats") * F.col("symbols")) / F.sum("symbols")).first()[0] or 0.0
    steady = (F.col("nats") * F.col("symbols") + PRIOR * usual) / (F.col("symbols") + PRIOR)
    cut = F.percentile_approx(steady, F.lit(quantile), F.lit(100_000)) + slack
    limits = written(unseen.groupBy(F.col("lang").alias("l")).agg(cut.alias("own")).where("l is not null"), spark, "limits")
    overall = unseen.agg(cut.alias("overall")).first()["overall"]
    met = scored.join(limits, F.col("lang") == F.col("l"), "left")
    limit = F.coalesce("own", F.lit(overall).cast("double"))
    return met.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), "symbols", F.exp("nats").alias("perplexity"), F.exp(limit).alias("limit"),
        F.coalesce(steady <= limit, F.lit(True)).alias("kept"),
    )


def keep_good(spark: SparkSession, docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected; rows repeating an id share its decision."""
    bad = judge(spark, docs, trusted).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
