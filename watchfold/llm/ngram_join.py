"""N-gram Jaccard join by vertical partitioning.

The global order of all shingles (rare ones first, equally common ones by hash) is
cut into fragments.  A fragment receives every document's piece of it, so it knows
how common each of its shingles is; partial overlaps are counted inside fragments
and summed per pair.

1. ``documents``: per document the size and a digest of its shingle set.  Equal sets
   are one *class* from here on, so exact copies are never paired.
2. ``fragments``: the classes' shingles travel packed (six bytes each) to the
   fragment of their hash.  Shingles of one class only cannot overlap with anything
   and end there; the others go back to their class with their frequency.
3. ``prefixes``: a partner must share one of the rarest ``n - ceil(t n) + 1`` shingles.
   Classes whose shingles are too unique to have any partner end here.  Each shingle of
   a prefix says how large a partner may be that is first met there (``limits``): the
   shingles left must hold the whole overlap, which grows with the partner.  So classes
   of one size are a pair only if they meet among the rarest seventh, and a copy with too
   many changes of its own meets none of the thousands that share the rest with it.
4. Candidates are met in the fragments of the prefixes.  A short list of classes that
   share a shingle gives all pairs that the limits of both allow; a long one (near copies
   by the thousand) gives only the links to its most central classes, those with the
   commonest shingles.  After these are checked, long lists that still hold several
   components give the pairs between them that the limits allow.  Each similar pair is
   allowed in the list of its first common shingle, so no link is lost, and a large group
   of near copies costs rows in proportion to its size, not its square.
5. ``overlaps``: both classes' shingles are cut by hash into parts, the overlap is
   counted per part and summed per pair, and tested exactly in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchfold.llm.common import attach_group, components, pack48, set_digests, shingle_sets, text_buffer, unpack48, words_of, written

PER_FRAGMENT = 2_000_000  # shingles in a fragment, on average
SHORT = 8  # a list of so many classes gives all its pairs at once
CENTRES = 2  # classes of a longer list to which the others are compared first
AT_ONCE = 1_000_000  # pairs that a task holds before equal ones are merged
PARTS = 4  # parts of a class's shingles in which overlaps are counted
_ROW_BYTES = 4 << 20


def _sets(batch: pa.RecordBatch, width: int):
    """Blocks of rows of about 4 MB of text: (first row, sets)."""
    data, offsets = text_buffer(batch.column(1))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _ROW_BYTES, side="right")) - 1)
        part = offsets[a : b + 1] - offsets[a]
        hashes, _, rows = words_of(data[offsets[a] : offsets[b]], part)
        yield a, shingle_sets(hashes, rows, b - a, width)
        a = b


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, n_shingles, digest) of each row; digest is null where there are no words."""

    def run(batches):
        for batch in batches:
            n, digests = [], []
            for _, sets in _sets(batch, width):
                n += [len(s) for s in sets]
                some = iter(set_digests([s for s in sets if len(s)]).tolist())
                digests += [next(some) if len(s) else None for s in sets]
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.int64())], ["id", "n_shingles", "digest"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_shingles bigint, digest bigint")


_PIECE = "part int, classes binary, sizes binary, counts binary, keys binary"


def _pieces(docs: DataFrame, text_col: str, width: int, fragments: int) -> DataFrame:
    """Rows (part, classes, sizes, counts, keys): the shingles of some classes in one fragment, packed.

    Classes of about ``PER_FRAGMENT`` shingles are packed together: there are fragments in proportion to the
    input, so fewer shingles at a time would make rows in proportion to its square.
    """

    def packed(seen: dict) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in seen.values()], np.int32)
        keys = np.concatenate(list(seen.values()))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        part = ((keys >> np.uint64(48)) % np.uint64(fragments)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        tags = {"classes": np.fromiter(seen, np.int64, len(seen)), "sizes": sizes}
        keys = np.frombuffer(pack48(keys[order]), np.uint8).reshape(-1, 6)
        return _packed(part[order], owner[order], {"keys": keys}, tags)

    def run(batches):
        seen, held = {}, 0
        for batch in batches:
            for _, sets in _sets(batch, width):
                sets = [s for s in sets if len(s)]
                for name, s in zip(set_digests(sets).tolist(), sets):
                    if name not in seen:
                        seen[name] = s
                        held += len(s)
                if held >= PER_FRAGMENT:
                    yield packed(seen)
                    seen, held = {}, 0
        if seen:
            yield packed(seen)

    return docs.select(F.lit(0), text_col).mapInArrow(run, _PIECE)


def _packed(part: np.ndarray, owner: np.ndarray, entries: dict[str, np.ndarray], tags: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per part of entries that are sorted by part and, inside, by owner.

    ``entries`` has a value (or a row of bytes) for each entry, ``tags`` one for each owner: these are written once
    per owner in a row, with the ``counts`` of the owner's entries there.
    """
    head = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))[: len(part)]
    rows = np.flatnonzero(np.diff(part[head], prepend=-1))

    def cells(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(values)
        width = values.nbytes // len(values) if len(values) else 0
        bounds = (np.append(starts, len(values)) * width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(values)])

    columns = {"part": pa.array(part[head[rows]].astype(np.int32))}
    columns |= {name: cells(values[owner[head]], rows) for name, values in tags.items()}
    columns["counts"] = cells(np.diff(np.append(head, len(part))).astype(np.int32), rows)
    columns |= {name: cells(values, head[rows]) for name, values in entries.items()}
    return pa.record_batch(list(columns.values()), list(columns))


def _values(column: pa.ChunkedArray, kind=np.uint8) -> np.ndarray:
    """The values of a column of packed cells, one after the other."""
    parts = []
    for chunk in column.chunks:
        chunk = chunk.cast(pa.large_binary())
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and at[-1] > at[0]:
            parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)).view(kind)


def _unpacked(table: pa.Table, *tags: tuple[str, type]) -> list[np.ndarray]:
    """The given values of each entry's owner."""
    counts = _values(table.column("counts"), np.int32)
    return [np.repeat(_values(table.column(name), kind), counts) for name, kind in tags]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _shared(pieces: DataFrame, blocks: int) -> DataFrame:
    """Per fragment and block of classes: the shingles that more than one class has, with their rarity class on top."""

    def run(table: pa.Table) -> pa.Table:
        fragment = table.column("part")[0].as_py()
        classes, sizes = _unpacked(table, ("classes", np.int64), ("sizes", np.int32))
        keys = unpack48(_values(table.column("keys")))
        # first the shingles that come once at all, which are most
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        order = order[np.lexsort((classes[order], keys[order]))]
        classes, sizes, keys = classes[order], sizes[order], keys[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1]))[: len(keys)]
        classes, sizes, keys = classes[new], sizes[new], keys[new]
        starts, df = _runs(keys)
        keep = np.repeat(df > 1, df)
        level = np.repeat(np.minimum(np.floor(np.log2(np.maximum(df, 1))), 63).astype(np.uint64), df)[keep]
        classes, sizes, keys = classes[keep], sizes[keep], keys[keep]
        # Two columns in one: the order's leading bits, then the fragment's 48-bit key; the fragment is in the row.
        keys = keys | (level << np.uint64(48))
        block = classes % blocks
        order = np.lexsort((classes, block))
        classes, sizes, keys, block = classes[order], sizes[order], keys[order], block[order]
        starts, _ = _runs(classes)
        owner = np.cumsum(np.append(0, classes[1:] != classes[:-1])) if len(classes) else classes
        out = _packed(block, owner, {"keys": keys}, {"classes": classes[starts], "sizes": sizes[starts]})
        return pa.Table.from_batches([out]).append_column("fragment", pa.array([fragment] * out.num_rows, pa.int32()))

    return pieces.groupBy("part").applyInArrow(run, _PIECE + ", fragment int")


_CLASS = "class bigint, size int, weight bigint, alone int, prefix binary, shared binary"


def _candidates(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Per class that can have a partner: how many shingles only it has, its prefix after these and all its shared shingles, by global order and by hash."""

    def run(table: pa.Table) -> pa.Table:
        keys = _values(table.column("keys"), np.uint64)
        fragments = np.repeat(table.column("fragment").to_numpy(), pc.binary_length(table.column("keys")).to_numpy() // 8)
        classes, sizes = _unpacked(table, ("classes", np.int64), ("sizes", np.int32))
        level, low = keys >> np.uint64(48), keys & np.uint64((1 << 48) - 1)
        whole = low | (fragments.astype(np.uint64) << np.uint64(48))
        order = np.lexsort((whole, level, classes))
        classes, sizes, whole, level = classes[order], sizes[order], whole[order], level[order].astype(np.int64)
        starts, counts = _runs(classes)
        rows = {"class": [], "size": [], "weight": [], "alone": [], "prefix": [], "shared": []}
        for a, m in zip(starts.tolist(), counts.tolist()):
            n = int(sizes[a])
            need = -(-n * num // den)
            if m >= need:  # n - m shingles are unique and come first
                rows["class"].append(int(classes[a]))
                rows["size"].append(n)
                rows["weight"].append(1000 * int(level[a : a + m].sum()) // n)
                rows["alone"].append(n - m)
                rows["prefix"].append(whole[a : a + (n - need + 1) - (n - m)].tobytes())
                rows["shared"].append(np.sort(whole[a : a + m]).tobytes())
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    return shared.groupBy("part").applyInArrow(run, _CLASS)


_LIST = "part int, classes binary, sizes binary, labels binary, weights binary, counts binary, keys binary, limits binary"


def _lists(classes: DataFrame, fragments: int, num: int, den: int) -> DataFrame:
    """Prefixes dealt to fragments of the order, packed.

    ``limits``: the largest partner that a class may meet first at this shingle.  At the place ``p`` of the class's order
    ``n - p`` shingles are left, and a partner of ``m`` needs ``num (n + m) / (num + den)`` of them.
    """

    def run(batches):
        for batch in batches:
            data = pa.Table.from_batches([batch])
            column = lambda name, kind=np.int64: data.column(name).to_numpy().astype(kind)
            keys = _values(data.column("prefix"), np.uint64)
            if not len(keys):
                continue
            lengths, sizes = pc.binary_length(data.column("prefix")).to_numpy() // 8, column("size")
            owner = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths - column("alone"), lengths)
            limits = ((sizes[owner] - place) * (num + den) // num - sizes[owner]).astype(np.int32)
            part = ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            tags = {"classes": column("class"), "sizes": column("size", np.int32), "labels": column("label"), "weights": column("weight")}
            yield _packed(part[order], owner[order], {"keys": keys[order], "limits": limits[order]}, tags)

    return classes.select("class", "size", "alone", "prefix", "label", "weight").mapInArrow(run, _LIST)


_PAIR = "a bigint, b bigint, size_a int, size_b int"


def _near_centres(starts, counts, sizes, limits, labels, weights, num, den):
    """Index arrays: all pairs of short lists, in long ones those with the ``CENTRES`` most central classes."""
    for length in range(2, SHORT + 1):
        at = starts[counts == length]
        i, j = np.triu_indices(length, 1)
        yield (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
    long = counts > SHORT
    for a, c in zip(starts[long].tolist(), counts[long].tolist()):
        for top in np.argsort(-weights[a : a + c], kind="stable")[:CENTRES].tolist():
            yield np.full(c, a + top), np.arange(a, a + c)


def _across(starts, counts, sizes, limits, labels, weights, num, den):
    """Index arrays of the pairs between different components in long lists: each class outside the list's largest
    component with those whose size its limit allows."""
    if not len(starts):
        return
    several = (counts > SHORT) & (np.minimum.reduceat(labels, starts) < np.maximum.reduceat(labels, starts))
    for a, c in zip(starts[several].tolist(), counts[several].tolist()):
        own, n, reach = labels[a : a + c], sizes[a : a + c], limits[a : a + c]
        by = np.argsort(own, kind="stable")
        heads, members = _runs(own[by])
        outside = np.flatnonzero(own != own[by[heads[np.argmax(members)]]])
        order = np.argsort(n, kind="stable")
        first = np.searchsorted(n[order], -(-n[outside] * num // den), side="left")
        many = np.maximum(np.searchsorted(n[order], reach[outside], side="right") - first, 0)
        ends = np.cumsum(many)
        x = 0
        while x < len(outside):
            y = max(x + 1, int(np.searchsorted(ends, ends[x] - many[x] + AT_ONCE, side="right")))
            own_x = np.repeat(np.arange(x, y), many[x:y])
            at = np.arange(len(own_x)) - (ends[own_x] - many[own_x] - (ends[x] - many[x])) + first[own_x]
            i, j = outside[own_x], order[at]
            met = (own[i] != own[j]) & (reach[j] >= n[i])
            yield a + i[met], a + j[met]
            x = y


def _pairs(lists: DataFrame, num: int, den: int, second: bool) -> DataFrame:
    """Pairs that share a prefix shingle where the limits of both allow the other: near centres, or (second) across components."""

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts) if parts else np.zeros((0, 4), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))[: len(rows)]]

    def run(table: pa.Table) -> pa.Table:
        tags = _unpacked(table, ("classes", np.int64), ("sizes", np.int32), ("labels", np.int64), ("weights", np.int64))
        keys, limits = _values(table.column("keys"), np.uint64), _values(table.column("limits"), np.int32)
        order = np.argsort(keys)
        keys, limits = keys[order], limits[order].astype(np.int64)
        classes, sizes, labels, weights = (x[order].astype(np.int64) for x in tags)
        starts, counts = _runs(keys)
        found, held = [], 0
        for i, j in (_across if second else _near_centres)(starts, counts, sizes, limits, labels, weights, num, den):
            fit = (limits[i] >= sizes[j]) & (limits[j] >= sizes[i]) & (classes[i] != classes[j])
            i, j = i[fit], j[fit]
            swap = classes[i] > classes[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            found.append(np.column_stack([classes[i], classes[j], sizes[i], sizes[j]]))
            held += len(i)
            if held > AT_ONCE:
                found = [merged(found)]
                held = len(found[0])
        rows = merged(found)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.table([pa.array(rows[:, k]).cast(t) for k, t in enumerate(kinds)], ["a", "b", "size_a", "size_b"])

    return lists.groupBy("part").applyInArrow(run, _PAIR)


def _common(batches):
    """Counts the keys that x and y of each pair share."""
    for batch in batches:
        lap = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
        ]
        yield pa.record_batch([*(batch.column(c) for c in ("a", "b", "size_a", "size_b")), pa.array(lap, pa.int64())], ["a", "b", "size_a", "size_b", "common"])


def _due(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole prefixes share what a similar pair's must: a class has ceil(t n) - 1 shingles beyond its own."""

    left = classes.select(F.col("class").alias("a"), F.col("prefix").alias("x"))
    right = classes.select(F.col("class").alias("b"), F.col("prefix").alias("y"))
    met = pairs.select("a", "b", "size_a", "size_b").join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "x", "y")
    beyond = F.ceil(F.greatest("size_a", "size_b") * num / den) - 1
    return met.mapInArrow(_common, _PAIR + ", common bigint").where((F.col("common") + beyond) * (num + den) >= (F.col("size_a") + F.col("size_b")) * num)


def _overlaps(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose exact overlap reaches the threshold: overlaps per part of the order, summed per pair."""

    def cut(batches):
        for batch in batches:
            rows = {"class": [], "part": [], "segment": []}
            for name, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(keys, np.uint64)
                part = keys % np.uint64(PARTS)
                for p in range(PARTS):
                    rows["class"].append(name)
                    rows["part"].append(p)
                    rows["segment"].append(keys[part == p].tobytes())
            yield pa.record_batch([pa.array(rows["class"], pa.int64()), pa.array(rows["part"], pa.int32()), pa.array(rows["segment"], pa.binary())], list(rows))

    segments = classes.select("class", "shared").mapInArrow(cut, "class bigint, part int, segment binary")
    dealt = pairs.select("a", "b", "size_a", "size_b", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    left = segments.select(F.col("class").alias("a"), "part", F.col("segment").alias("x"))
    right = segments.select(F.col("class").alias("b"), "part", F.col("segment").alias("y"))
    both = dealt.join(left, ["a", "part"]).join(right, ["b", "part"]).select("a", "b", "size_a", "size_b", "x", "y")
    total = both.mapInArrow(_common, _PAIR + ", common bigint").groupBy("a", "b", "size_a", "size_b").agg(F.sum("common").alias("common"))
    return total.where(F.col("common") * den >= (F.col("size_a") + F.col("size_b") - F.col("common")) * num)


def jaccard_links(spark: SparkSession, docs: DataFrame, sizes: DataFrame, text_col: str = "text", num: int = 3, den: int = 4, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """(links, labels) between classes of equal shingle sets.

    ``links`` (a, b, size_a, size_b, common): enough of the links ``num / den`` or more
    alike to connect all that are connected; every pair outside one component was
    tested.  ``labels`` (node, label): the component of each class with a partner.
    """
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(4, min(65_536, -(-total // PER_FRAGMENT)))
    shared = _shared(_pieces(docs, text_col, width, fragments), fragments)
    classes = written(_candidates(shared, num, den), spark, "classes")
    alone = classes.withColumn("label", F.col("class"))

    def checked(lists: DataFrame, second: bool) -> DataFrame:
        pairs = _pairs(lists, num, den, second).distinct()
        if second:
            pairs = written(_due(pairs, classes, num, den), spark, "due")
        return written(_overlaps(pairs, classes, num, den), spark, "links")

    first = checked(_lists(alone, fragments, num, den), False)
    labels = written(components(first, spark), spark, "labels")
    joined = classes.join(labels, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class"))
    second = checked(_lists(joined, fragments, num, den), True)
    links = first.unionByName(second)
    if not second.isEmpty():
        labels = written(components(links, spark), spark, "labels")
    return links, labels


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 3, den: int = 4, width: int = 5) -> DataFrame:
    """(id, n_shingles, component_id): documents linked by shingle sets ``num / den`` or more alike.

    ``component_id`` is the least id that links reach.  A document of fewer than
    ``width`` words is one shingle; one without words (null, empty, white space) is
    linked with nothing and is its own component.  Rows that repeat an id are each
    returned; a null id keeps its row and its component's least known id.  An empty
    table gives no rows.  Other columns of ``docs`` are ignored.
    """
    sizes = written(documents(docs, id_col, text_col, width), spark, "sizes")
    _, labels = jaccard_links(spark, docs, sizes, text_col, num, den, width)
    named = attach_group(sizes, "digest", F.xxhash64("id"), 64, __least=(F.col("id"), F.min))
    # The least id of a class, then of its component: one row per class with a partner.
    least = (
        sizes.where("digest is not null").groupBy(F.col("digest").alias("node")).agg(F.min("id").alias("least"))
        .join(labels, "node").groupBy("label").agg(F.min("least").alias("least"))
    )
    by_class = labels.join(least, "label").select("node", "least")
    tied = named.withColumn("__s", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int"))
    spread = by_class.select("node", "least", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("s"))
    out = tied.join(spread, (tied["digest"] == spread["node"]) & (tied["__s"] == spread["s"]), "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.coalesce("least", "__least"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document with the least id stays.

    Rows that repeat an id share its decision; a null id stays only if nothing is linked with it.
    """
    found = jaccard_components(spark, docs, id_col, text_col)
    dropped = found.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti")
