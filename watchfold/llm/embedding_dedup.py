"""Near copies among embeddings by collision-counting projections.

Every vector is projected onto many random lines.  Two vectors collide on a line if one lies
in the window centred at the other; two that reach the wanted cosine collide on nearly all
lines, and the least count that lets almost all such pairs through (``least_count``) decides
which pairs are verified, in double precision.

Vectors meet in cells: bundles of further lines, each cut into intervals.  Bundles get
longer with the number of vectors, so that a cell keeps its size, and there are as
many bundles as the wanted recall needs (``bundles``).  In a cell the vectors are sorted by
their first line, and each block's window is a run of the sorted rows.  A pair counts in
the first bundle that brings it together, so nothing is counted twice and no pair leaves
its task: tasks return link counts and a spanning set of links.

Equal vectors are one class.  Where a crowd of vectors lies so close around one of
``PIVOTS`` sampled ones that any two of it must reach the cosine, they are linked by their
number, without being compared.  A crowded cell is split into units that are compared
two by two.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchfold.llm.common import attach_group, components, written

COSINE = 0.9
LINES = 32  # lines on which collisions are counted
REACH = 2.5  # half a window's width, in deviations of a pair at the cosine
PASS = 0.999  # share of such pairs that the count lets through
MEET = 0.98  # share of such pairs that meet in some bundle
WIDTH = 4.0  # width of a bundle's intervals, in the same deviations
CELL = 2_048  # vectors a cell is meant to hold
UNIT = 4_096  # vectors of a unit of a crowded cell
PIVOTS = 512
CROWD = 1_024  # vectors around a pivot that count as a crowd
_STEPS = 32  # steps of a line's stored place in one deviation of all vectors
_ROWS = 256


def spread(cosine: float) -> float:
    """The deviation of two unit vectors' difference along a random line, if they have this cosine."""
    return math.sqrt(2 - 2 * cosine)


def least_count(lines: int, reach: float = REACH, share: float = PASS) -> int:
    """The largest count that at least ``share`` of the pairs at the cosine reach."""
    p = math.erf(reach / math.sqrt(2))
    tail, count = 0.0, lines + 1
    while tail < share and count > 0:
        count -= 1
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
    return count


def _same_interval(width: float) -> float:
    """How often two points with a normal difference of deviation 1 fall into one of randomly shifted intervals."""
    inside = math.erf(width / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def bundles(n: int, cosine: float = COSINE, cell: int = CELL, meet: float = MEET) -> tuple[int, int]:
    """(lines in a bundle, bundles): unrelated vectors share a cell with about ``cell`` others; pairs at the cosine meet."""
    far = _same_interval(WIDTH * spread(cosine) / spread(0.0))
    size = max(0, math.ceil(math.log(max(1, n) / cell) / -math.log(far)))
    near = _same_interval(WIDTH) ** size
    return size, 1 if near == 1 else math.ceil(math.log(1 - meet) / math.log(1 - near))


def lines_of(dim: int, lines: int, of: int, bundle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions of the counted lines, and those and the shifts of the bundles' lines; the same in every task."""
    seed = np.random.default_rng([dim, lines, of, bundle])
    return seed.standard_normal((dim, lines)), seed.standard_normal((dim, of * bundle)), seed.random(of * bundle)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _numbers(binary: pa.Array, kind: str) -> np.ndarray:
    values = binary.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def projected(vectors: DataFrame, size: int, count: int, id_col: str, vec_col: str, cosine: float, lines: int) -> DataFrame:
    """(row, id, key, dim, vector, places, cells) of each row; the last five are null where a vector links with nothing."""
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    width = WIDTH * spread(cosine)

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            held = [None] * batch.num_rows
            for i, x in enumerate(batch.column(1)):
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy().astype(kind) + 0.0  # no negative zeros
                    if np.isfinite(v).all() and v.any():
                        held[i] = v
                        by_dim.setdefault(len(v), []).append(i)
            key, dims, vector, places, cells = ([None] * batch.num_rows for _ in range(5))
            for dim, rows in by_dim.items():
                units = _units(np.array([held[i] for i in rows], np.float64))
                counted, bundled, shift = lines_of(dim, lines, size, count)
                at = np.clip((units @ counted + 4) * _STEPS, 0, 255).astype(np.uint8)
                number = np.floor(units @ bundled / width + shift).astype("<i4").reshape(len(rows), count, size)
                for n, i in enumerate(rows):
                    raw = held[i].tobytes()
                    key[i], vector[i], places[i], dims[i] = hashlib.blake2b(raw, digest_size=16).digest(), raw, at[n].tobytes(), dim
                    cells[i] = [
                        int.from_bytes(hashlib.blake2b(number[n, t].tobytes() + b"%d:%d" % (t, dim), digest_size=8).digest(), "little", signed=True)
                        for t in range(count)
                    ]
            ids = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            columns = [ids, batch.column(0), pa.array(key, pa.binary()), pa.array(dims, pa.int32()), pa.array(vector, pa.binary()), pa.array(places, pa.binary()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["row", "id", "key", "dim", "vector", "places", "cells"])

    id_kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec_col).mapInArrow(run, f"row bigint, id {id_kind}, key binary, dim int, vector binary, places binary, cells array<bigint>")


def with_crowds(spark: SparkSession, classes: DataFrame, kind: str, cosine: float, pivots: int, crowd: int) -> DataFrame:
    """``classes`` with the column crowd: the pivot around which a class lies in a crowd, else -1.

    Any two vectors at most half the cosine's angle from a third one reach the cosine.
    """
    picked = classes.orderBy(F.xxhash64("key"), "class").limit(pivots).select("dim", "vector").collect()  # at most ``pivots``
    near = math.cos(math.acos(cosine) / 2) + 1e-6
    by_dim = {d: _units(np.array([np.frombuffer(x, kind) for e, x in picked if e == d], np.float64)) for d in {d for d, _ in picked}}
    starts = {d: sum(len(by_dim[e]) for e in by_dim if e < d) for d in by_dim}
    sent = spark.sparkContext.broadcast(by_dim)

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, -1, np.int32)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in sent.value:
                    at = np.flatnonzero(dims == dim)
                    close = _units(_numbers(batch.column("vector").take(pa.array(at)), kind).astype(np.float64)) @ sent.value[dim].T >= near
                    out[at] = np.where(close.any(1), starts[dim] + close.argmax(1), -1)
            yield batch.append_column("crowd", pa.array(out))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema)
    near_one = written(classes.mapInArrow(run, shape + ", crowd int"), spark, "crowds")
    large = [r[0] for r in near_one.where("crowd >= 0").groupBy("crowd").agg(F.count("*").alias("c")).where(F.col("c") >= crowd).collect()]
    return near_one.withColumn("crowd", F.when(F.col("crowd").isin(large), F.col("crowd")).otherwise(-1))


class _Links:
    """Counts and a spanning forest of the links among numbered rows."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.count, self.low = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        low = self.low
        while True:
            x, y = low[a], low[b]
            if (x == y).all():
                break
            least = np.minimum(x, y)
            np.minimum.at(low, x, least)
            np.minimum.at(low, y, least)
            while (low != low[low]).any():
                low[:] = low[low]


_FOUND = "class bigint, links bigint, other bigint"


def _comparer(kind: str, cosine: float, lines: int, reach: float, share: float):
    window = math.ceil(reach * spread(cosine) * _STEPS) + 1
    least = least_count(lines, reach, share)

    def compare(group: pa.Table) -> pa.Table:
        """Links among the vectors that share a cell, or between the two units of it that met here."""
        group = group.combine_chunks()
        places = _numbers(group["places"], "u1")
        order = np.argsort(places[:, 0], kind="stable")
        group, places = group.take(pa.array(order)), places[order]
        table, x, y = group["table"][0].as_py(), group["x"][0].as_py(), group["y"][0].as_py()
        cells = np.array(group["cells"].to_pylist()).reshape(len(places), -1)[:, :table]
        vectors = _numbers(group["vector"], kind).astype(np.float64)
        vectors /= np.abs(vectors).max(1, keepdims=True)
        norms = np.linalg.norm(vectors, axis=1)
        unit, crowd = group["unit"].to_numpy(), group["crowd"].to_numpy()
        links = _Links(group["n"].to_numpy())
        mine, theirs = (np.arange(len(places)),) * 2 if x == y else (np.flatnonzero(unit == x), np.flatnonzero(unit == y))
        here, there = np.ascontiguousarray(places[mine].T), np.ascontiguousarray(places[theirs].T)
        if not lines or not len(mine) or not len(theirs):
            return pa.table([[], [], []], schema=pa.schema([("class", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]))
        step, width = np.uint8(window), np.uint8(min(255, 2 * window))
        for first in range(0, len(mine), _ROWS):
            block = here[:, first : first + _ROWS]
            a = np.searchsorted(there[0], max(0, int(block[0, 0]) - window), side="left")
            b = np.searchsorted(there[0], min(255, int(block[0, -1]) + window), side="right")
            if x == y:
                a = max(a, first)
            counts = np.zeros((block.shape[1], b - a), np.uint8)
            for own, other in zip(block, there[:, a:b]):  # a place is in the window if the difference does not wrap round
                counts += (own[:, None] + step) - other <= width
            p, q = np.nonzero(counts >= least)
            p, q = mine[p + first], theirs[q + a]
            ok = (crowd[p] < 0) | (crowd[p] != crowd[q])
            if x == y:
                ok &= p < q
            p, q = p[ok], q[ok]
            for s in range(0, len(p), 1 << 15):
                i, j = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
                first_here = ~(cells[i] == cells[j]).any(1)
                i, j = i[first_here], j[first_here]
                near = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= cosine * (norms[i] * norms[j])
                links.add(i[near], j[near])
        at = np.flatnonzero(links.count)
        names = group["class"].to_numpy()
        return pa.table([names[at], links.count[at], names[links.low[at]]], names=["class", "links", "other"])

    return compare


def near_copies(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, lines: int = LINES, reach: float = REACH, share: float = PASS, meet: float = MEET, cell: int = CELL, unit: int = UNIT, pivots: int = PIVOTS, crowd: int = CROWD) -> DataFrame:
    """(id, n_links, component_id, kept) of each vector.

    ``n_links`` counts the other vectors whose cosine was found to be at least ``cosine``; none below it counts.
    ``component_id`` is the least id reachable over links; a vector stays if that is its own.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, and vectors of
    different lengths not with each other.  Equal vectors always link.  Rows repeating an id are vectors of their own
    (of those tied for the least id all are kept); a null id is never the least if another is there; an empty table gives
    no rows; other columns are ignored.
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    size, count = bundles(vectors.count(), cosine, cell, meet)
    rows = written(projected(vectors, size, count, id_col, vec_col, cosine, lines), spark, "projected")
    keyed = attach_group(
        rows.where("key is not null").select("row", "id", "key"), "key", F.col("row"), 64,
        **{"class": (F.col("row"), F.min), "n": (F.lit(1).cast("bigint"), F.sum), "least": (F.col("id"), F.min)},
    )
    keyed = written(keyed, spark, "classes")
    heads = keyed.where(F.col("row") == F.col("class")).select("class", "n", "least")
    classes = heads.join(rows.drop("id"), F.col("class") == F.col("row")).drop("row")
    classes = with_crowds(spark, classes, kind, cosine, pivots, crowd)
    copies = classes.select("class", "n", "crowd", "dim", "vector", "places", "cells", F.posexplode("cells").alias("table", "cell"))

    # Crowded cells: units of one crowd, or of what is in none, compared two by two but not within a crowd.
    filled = copies.groupBy("table", "cell", "crowd").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / unit).cast("int")
    crowded = filled.groupBy(F.col("table").alias("t"), F.col("cell").alias("l")).agg(
        F.sum("c").alias("all"), F.sort_array(F.collect_list(F.struct("crowd", parts.alias("parts")))).alias("each")  # one for each crowd there
    ).where(F.col("all") > unit)
    every = F.flatten(F.transform("each", lambda e: F.transform(F.sequence(F.lit(1), e["parts"]), lambda k: F.struct(e["crowd"].alias("crowd"), (k - 1).alias("part")))))
    crowded = crowded.select("t", "l", every.alias("units"), F.map_from_entries("each").alias("parts"))
    met = copies.join(crowded, (F.col("table") == F.col("t")) & (F.col("cell") == F.col("l")), "left")
    own = F.struct(F.col("crowd"), F.pmod(F.xxhash64("class"), F.try_element_at("parts", "crowd")).cast("int").alias("part"))
    met = met.withColumn("unit", F.coalesce(F.array_position("units", own).cast("int"), F.lit(1)) - 1)
    others = F.filter(
        F.transform(F.coalesce("units", F.array(F.struct(F.lit(-1).alias("crowd"), F.lit(0).alias("part")))), lambda u, i: F.struct(i.alias("i"), u["crowd"].alias("c"))),
        lambda u: F.col("units").isNull() | (u["c"] == -1) | (u["c"] != F.col("crowd")),
    )
    placed = met.select("class", "n", "crowd", "vector", "places", "cells", "table", "cell", "unit", F.explode(F.transform(others, lambda u: u["i"])).alias("to"))
    placed = placed.withColumns({"x": F.least("unit", "to"), "y": F.greatest("unit", "to")}).drop("to")
    found = placed.groupBy("table", "cell", "x", "y").applyInArrow(_comparer(kind, cosine, lines, reach, share), _FOUND)
    found = written(found, spark, "found")

    around = classes.where("crowd >= 0").groupBy(F.col("crowd").alias("o")).agg(F.min("class").alias("first"), F.sum("n").alias("members"))
    gathered = written(classes.select("class", "n", "least", "crowd").join(F.broadcast(around), F.col("crowd") == F.col("o"), "left").drop("o"), spark, "gathered")
    links = found.groupBy(F.col("class").alias("k")).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("class").alias("a"), F.col("other").alias("b")).union(gathered.where("first is not null").select("class", "first"))
    parts = components(edges, spark).select(F.col("node").alias("m"), "label").distinct()
    joined = gathered.join(links, F.col("class") == F.col("k"), "left").join(parts, F.col("class") == F.col("m"), "left")
    joined = joined.select("class", "least", F.coalesce("label", "class").alias("label"), (F.col("n") - 1 + F.coalesce(F.col("members") - F.col("n"), F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = attach_group(joined, "label", F.col("class"), 64, component=(F.col("least"), F.min))
    answers = written(joined.select(F.col("class").alias("k"), "n_links", "component"), spark, "answers")
    # A class of many copies has one answer: the join may split its rows, which nothing else needs together.
    linked = keyed.select("row", "id", "class").join(answers, F.col("class") == F.col("k")).select("id", "n_links", "component")
    alone = rows.where("key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
