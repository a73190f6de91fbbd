"""Grouping of spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted or deleted letter moves a word's vector of letter counts by one, a replaced
letter by one up in one place and one down in another.  So the words near a word lie in a
small box around its vector, among the words of its own length and of the next.  Each
length has a tree whose upper part is laid out on a bounded sample and cuts the words into
cells of a bounded size; a word is sent to the cells its box reaches.  In each
cell a full tree is built, whose nodes are pruned by their boxes, and what is left is
compared letter by letter.  What a cell finds is summed per word before it leaves the task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from watchfold.llm.common import written

MIN_LETTERS = 7
MIN_COUNT = 2
TIMES = 10  # a form is at least so many times as frequent
SAMPLE = 100_000  # words the upper trees are laid out on
CELL = 400_000  # letters that a cell is laid out for
BLOCK = 4  # a cell of more than so many times the letters is split into blocks
DIMS, LEVELS = 32, 4  # counters of letters (rare letters share some) and how far a signature counts
_LEAF = 16
_QUERIES = 8_192
_HELD = 400_000  # distinct words a task holds before it sends their counts on


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters and ``min_count`` occurrences over all texts.

    A word is a maximal run of Latin-1 letters with A-Z lower-cased.  With ``noise`` k, a run is misspelt
    in each document where k divides the crc32 of ``<id>:<run>``: it loses the letter at that number modulo its length.
    """

    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_letters)  # a longest run, if it has the letters

    def run(batches):
        held = Counter()

        def out():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                begin = zlib.crc32(f"{name.as_py() if name.is_valid else ''}:".encode())
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    if noise:
                        h = zlib.crc32(word.encode(), begin)
                        if h % noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_letters:
                                continue
                    held[word] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    part = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# Letter counts


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    size = len(words[0]) if words else 0
    return np.array(words, dtype=f"U{max(1, size)}").view(np.uint32).reshape(len(words), -1)[:, :size]


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each counter's letters occur: a to z have one each, all others share the rest."""
    where = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % (DIMS - 26)).astype(np.int64)
    flat = where + np.arange(len(codes))[:, None] * DIMS
    return np.bincount(flat.ravel(), minlength=len(codes) * DIMS).reshape(-1, DIMS)


def signatures(counts: np.ndarray) -> np.ndarray:
    """Counts in unary, ``LEVELS`` bits each: bits of one that another lacks are the least number of letters it has more."""
    bits = (counts[:, :, None] > np.arange(LEVELS)).reshape(len(counts), -1)
    return np.packbits(bits, axis=1).view(np.uint64)


def _lacks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a & ~b).sum(-1)


class Layout:
    """The upper part of a length's tree: nodes (counter, limit, left, right) or leaves (-1, cell, 0, 0)."""

    def __init__(self, sample: np.ndarray, share: float, cell: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.cells, self._share, self._cell = 0, share, cell
        self._split(sample)
        self.nodes = np.array(self.nodes)

    def _split(self, counts: np.ndarray) -> int:
        at, best = len(self.nodes), None
        self.nodes.append((-1, self.cells, 0, 0))
        if len(counts) * self._share > self._cell:
            for limit in range(LEVELS):
                lower = (counts <= limit).mean(0)
                dim = int(np.abs(lower - 0.5).argmin())
                if best is None or abs(lower[dim] - 0.5) < best[0]:
                    best = abs(lower[dim] - 0.5), dim, limit
        if best is None or best[0] > 0.49:
            self.cells += 1
            return at
        _, dim, limit = best
        low = counts[:, dim] <= limit
        left, right = self._split(counts[low]), self._split(counts[~low])
        self.nodes[at] = (dim, limit, left, right)
        return at

    def reach(self, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells a row's vector can get to by ``up`` counts more and ``down`` less."""
        rows = np.arange(len(counts))
        at, up, down = np.zeros(len(counts), np.int64), np.full(len(counts), up), np.full(len(counts), down)
        done = []
        while len(rows):
            dim, limit, left, right = self.nodes[at].T
            leaf = dim < 0
            done.append((rows[leaf], limit[leaf]))
            rows, up, down, dim, limit, left, right = (x[~leaf] for x in (rows, up, down, dim, limit, left, right))
            own = counts[rows, dim]
            more, less = np.maximum(0, limit + 1 - own), np.maximum(0, own - limit)
            go_left, go_right = less <= down, more <= up
            at = np.concatenate([left[go_left], right[go_right]])
            up = np.concatenate([up[go_left], (up - more)[go_right]])
            down = np.concatenate([(down - less)[go_left], down[go_right]])
            rows = np.concatenate([rows[go_left], rows[go_right]])
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (rows, rows)


def layouts(spark: SparkSession, words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Layout]:
    """The trees of lengths whose words fill more than one cell, from about ``sample`` words chosen by hash."""
    total = words.count()
    step = max(1, math.ceil(total / sample))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).select("word", F.length("word").alias("size"))
    crowded = words.groupBy(F.length("word").alias("long")).agg(F.count("*").alias("c")).where(F.col("c") * F.col("long") > cell)
    by_size: dict[int, list[str]] = {}
    for size, word in picked.join(crowded, F.col("size") == F.col("long")).select("size", "word").toLocalIterator():
        by_size.setdefault(size, []).append(word)
    return {size: Layout(letter_counts(letters(found)), step, max(1, cell // size)) for size, found in by_size.items()}


# Search inside a cell


class Tree:
    """A k-d tree over signatures; every node knows the least and the greatest count of each counter below it."""

    def __init__(self, marks: np.ndarray, counts: np.ndarray):
        self.order, self.marks = np.arange(len(marks)), marks
        bounds, low, high, kids = [], [], [], []
        stack = [(0, len(marks), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            n, own = len(bounds), self.order[a:b]
            bounds.append((a, b))
            kids.append([-1, -1])
            low.append(np.bitwise_and.reduce(marks[own], 0))
            high.append(np.bitwise_or.reduce(marks[own], 0))
            if parent >= 0:
                kids[parent][side] = n
            if b - a > _LEAF:
                part = np.minimum(counts[own], LEVELS)
                dim = int(part.var(0).argmax())
                values = part[:, dim]
                limit = np.median(values)
                left = values <= limit
                if left.all():
                    left = values < limit
                if left.any():
                    self.order[a:b] = np.concatenate([own[left], own[~left]])
                    middle = a + int(left.sum())
                    stack += [(a, middle, n, 0), (middle, b, n, 1)]
        self.bounds, self.kids = np.array(bounds).reshape(-1, 2), np.array(kids).reshape(-1, 2)
        self.low, self.high = np.array(low), np.array(high)

    def within(self, queries: np.ndarray, up: int, down: int):
        """Blocks (query, point) whose counts differ by at most ``up`` more and ``down`` less in the point."""
        for first in range(0, len(queries), _QUERIES):
            block = queries[first : first + _QUERIES]
            q, node, ends = np.arange(len(block)), np.zeros(len(block), np.int64), []
            while len(q):
                near = (_lacks(self.low[node], block[q]) <= up) & (_lacks(block[q], self.high[node]) <= down)
                q, node = q[near], node[near]
                leaf = self.kids[node, 0] < 0
                ends.append((q[leaf], node[leaf]))
                q, node = np.repeat(q[~leaf], 2), self.kids[node[~leaf]].ravel()
            q, node = (np.concatenate(x) for x in zip(*ends))
            a, sizes = self.bounds[node, 0], np.diff(self.bounds[node], axis=1).ravel()
            # Leaves may be large where words share their letters: go by at most so many pairs.
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum(), 1 << 21), side="left")
            for s, e in zip(cuts, [*cuts[1:], len(q)]):
                n = sizes[s:e]
                if not len(n):
                    continue
                point = self.order[np.repeat(a[s:e] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pair = np.repeat(q[s:e], n)
                ok = (_lacks(self.marks[point], block[pair]) <= up) & (_lacks(block[pair], self.marks[point]) <= down)
                yield pair[ok] + first, point[ok]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters, of equal length or ``b`` one longer, differ by exactly one edit."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= a.shape[1]


_FOUND = "word string, near bigint, best_n bigint, best string"


def search_cell(cell: pa.Table) -> pa.Table:
    """What the words of a cell find in it: (word, near, best_n, best).

    Kinds: 0 a point, also compared with the other points; 1 a point only; 2 a word of the same length
    from elsewhere; 3 a word that is one letter shorter.
    """
    cell = cell.sort_by([("kind", "ascending"), ("word", "ascending")])
    kinds, words, n = cell["kind"].to_numpy(), cell["word"].to_pylist(), cell["n"].to_numpy()
    points = np.flatnonzero(kinds <= 1)
    kind_of = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    empty = kind_of.empty_table()
    if not len(points) or len(words) < 2:
        return empty
    there = letters([words[i] for i in points])
    counts = letter_counts(there)
    tree = Tree(signatures(counts), counts)
    # A word's place in the order of forms: the most frequent first, then by code points.
    codes = np.array([w.encode() for w in words], dtype=object)
    place = np.empty(len(words), np.int64)
    order = sorted(range(len(words)), key=lambda i: (-n[i], codes[i]))
    place[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for kind in (0, 2, 3):
        mine = np.flatnonzero(kinds == kind)
        if not len(mine):
            continue
        here = letters([words[i] for i in mine])
        for q, p in tree.within(signatures(letter_counts(here)), 1, 0 if kind == 3 else 1):
            if kind == 0:  # each pair of points once; equal rows never differ by an edit
                once = mine[q] < points[p]
                q, p = q[once], p[once]
            step = max(1, (1 << 22) // max(1, there.shape[1]))
            for s in range(0, len(q), step):
                a, b = q[s : s + step], p[s : s + step]
                met = one_edit(here[a], there[b])
                a, b = mine[a[met]], points[b[met]]
                for x, y in ((a, b), (b, a)):
                    near += np.bincount(x, minlength=len(near))
                    np.minimum.at(best, x, place[y])
    seen = np.flatnonzero(near)
    if not len(seen):
        return empty
    top = np.array(order)[best[seen]]
    return pa.table([[words[i] for i in seen], near[seen], n[top], [words[i] for i in top]], schema=kind_of)


def near_words(spark: SparkSession, words: DataFrame, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(word, near, best_n, best): how many words are one edit away and the most frequent of them, for words (word, n) with any."""
    trees = spark.sparkContext.broadcast(layouts(spark, words, sample, cell))

    def run(batches):
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            held = batch.column(0).to_pylist()
            for i, word in enumerate(held):
                by_size.setdefault(len(word), []).append(i)
            out = []
            for size, rows in by_size.items():
                counts, at = letter_counts(letters([held[i] for i in rows])), np.array(rows)
                zero = np.zeros(len(rows), np.int64)
                tree, longer = trees.value.get(size), trees.value.get(size + 1)
                own = zero
                if tree:
                    row, target = tree.reach(counts, 0, 0)
                    own = own.copy()
                    own[row] = target
                    row, target = tree.reach(counts, 1, 1)
                    later = target > own[row]  # of two cells that reach each other one asks
                    out.append((at[row[later]], size, target[later], 2))
                out.append((at, size, own, 0))
                out.append((at, size + 1, zero, 3) if not longer else (lambda x: (at[x[0]], size + 1, x[1], 3))(longer.reach(counts, 1, 0)))
            for rows, size, target, kind in out:
                took = pa.array(rows)
                columns = [np.full(len(rows), size, np.int32), target.astype(np.int32), np.full(len(rows), kind, np.int32)]
                if len(rows):
                    yield pa.record_batch([*map(pa.array, columns), batch.column(0).take(took), batch.column(1).take(took)], ["size", "cell", "kind", "word", "n"])

    sent = words.select("word", "n").mapInArrow(run, "size int, cell int, kind int, word string, n bigint")
    sent = written(sent, spark, "cells")
    # Only cells that hold a point are asked; those beyond what they were laid out for are split into blocks.
    points, others = F.count_if(F.col("kind") == 0), F.count_if(F.col("kind") != 0)
    parts = lambda x: F.greatest(F.lit(1), F.ceil(x * F.col("size") / F.lit(cell * block))).cast("int")
    cells = sent.groupBy("size", "cell").agg(points.alias("points"), others.alias("others")).where("points > 0 and points + others > 1")
    cells = cells.select(F.col("size").alias("s"), F.col("cell").alias("c"), parts(F.col("points")).alias("rows"), parts(F.col("others")).alias("turns"))
    met = sent.join(cells, (F.col("size") == F.col("s")) & (F.col("cell") == F.col("c")))
    h = F.xxhash64("word")
    row, turn = F.pmod(h, F.col("rows")).cast("int"), F.pmod(F.floor(h / (1 << 32)), F.col("turns")).cast("int")
    numbers = lambda a, b, kind: F.transform(F.sequence(a, b), lambda x: F.struct(kind(x).cast("int").alias("kind"), x.alias("row")))
    # A point stands in its own block, all turns of it, and asks the blocks after it; the others ask all blocks in their turn.
    as_point = F.flatten(F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.array(F.struct(F.when(t == 0, 0).otherwise(1).alias("kind"), row.alias("row"), t.cast("int").alias("turn")))))
    asks = F.filter(numbers(F.lit(0), F.col("rows") - 1, lambda x: F.lit(2)), lambda x: x["row"] > row)
    asks = F.transform(asks, lambda x: F.struct(x["kind"].alias("kind"), x["row"].alias("row"), F.lit(0).alias("turn")))
    others = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda x: F.struct(F.col("kind").alias("kind"), x.alias("row"), turn.alias("turn")))
    placed = met.select("size", "cell", "word", "n", F.explode(F.when(F.col("kind") == 0, F.concat(as_point, asks)).otherwise(others)).alias("at"))
    placed = placed.select("size", "cell", F.col("at.row").alias("row"), F.col("at.turn").alias("turn"), F.col("at.kind").alias("kind"), "word", "n")
    found = placed.groupBy("size", "cell", "row", "turn").applyInArrow(search_cell, _FOUND)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), first.alias("f"))
    return found.select("word", "near", (-F.col("f.m")).alias("best_n"), F.col("f.best").alias("best"))


def roots(spark: SparkSession, forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) for words with a form (word, form): the last of the forms, ``2 ** rounds`` steps at most."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        on = at.select(F.col("word").alias("w"), F.col("root").alias("further"))
        at = written(at.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root")), spark, "roots")
    return at


def group_variants(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = TIMES, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word; see ``word_counts`` for what words are.

    ``n_near`` counts the words one edit away; the form is the most frequent of them (ties: the first by code
    points) if it is at least ``times`` (2 or more) as frequent as the word; ``root`` is the last of a word's forms.

    Null and empty texts have no words; a null id counts as an empty string in ``noise``; rows repeating an id count
    each; very long texts and words are read whole; an empty table gives no rows; other columns are ignored.
    """
    words = written(word_counts(docs, id_col, text_col, noise, min_letters, min_count), spark, "words")
    near = near_words(spark, words, sample, cell, block)
    fits = F.col("best_n") >= times * F.col("n")
    joined = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("best_n")).alias("form_n")
    )
    table = written(joined, spark, "variants")
    most = table.agg(F.max("n")).first()[0] or 1
    steps = math.log(max(times, most), times)  # every step to a form multiplies the count
    last = roots(spark, table.where("form is not null"), math.ceil(math.log2(steps + 1)) + 1)
    last = last.withColumnRenamed("word", "w")
    return table.join(last, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
