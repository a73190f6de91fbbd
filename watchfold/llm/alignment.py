"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, by galloping intersection.

Both tokenizers' tokens of a text end at byte offsets.  The shorter list of ends drives a
search into the longer one, first by doubling steps and then by halving them; ends found in
both cut the tokens into groups, and inside a group the ranks of a token's two bounds among
the other side's ends are the range of tokens it overlaps.

A text is first cut where no token of either can reach over (before most spaces, between
letters and marks), and each distinct cut is tokenised and aligned once.  The linked id pairs of a text are then counted
over the corpus: per task first, by shuffle after that.  The most frequent ``HOT`` pairs are
looked up in place; all others are joined by pair, where none has many rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from watchfold.llm.common import written

HOT = 1 << 18  # pairs that are sent to all tasks; the others are joined
_CUTS = 200_000  # cuts that a worker remembers, and as many older ones (speed only)
_LONG = 256  # characters; longer cuts are not remembered
_FLUSH = 1 << 21  # pairs a task holds before it counts them

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARGIN = "\x01"  # stands before a cut that begins without a space, and joins nothing


def common_ends(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs (i, j) with a[i] == b[j] in two ascending lists, found by galloping through the longer one."""
    if len(a) > len(b):
        return [(i, j) for j, i in common_ends(b, a)]
    found, low = [], 0
    for i, end in enumerate(a):
        high, step = low, 1
        while high < len(b) and b[high] < end:
            low, high, step = high + 1, high + step, 2 * step
        low = bisect_left(b, end, low, min(high, len(b)))
        if low == len(b):
            break
        if b[low] == end:
            found.append((i, low))
            low += 1
    return found


def groups_and_links(a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Of two lists of ends with the same last end: the groups' last indexes, and (i, first, last) of the ``b`` tokens that overlap ``a[i]``."""
    groups, links, i, j = common_ends(a, b), [], 0, 0
    for gi, gj in groups:
        if gi == i or gj == j:  # one token on a side: it overlaps all of the other
            links += [(k, j, gj) for k in range(i, gi + 1)]
        else:
            begin = a[i - 1] if i else 0
            for k in range(i, gi + 1):
                links.append((k, bisect_right(b, begin, j, gj), bisect_left(b, a[k], j, gj)))
                begin = a[k]
        i, j = gi + 1, gj + 1
    return groups, links


class Aligner:
    """Tokens and links of texts under a byte-level BPE file (A) and a sentencepiece BPE model (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in visible]
        byte_of = {chr(x): x for x in visible} | {chr(256 + n): x for n, x in enumerate(hidden)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        self.name_a, self.name_b = [b"%d" % x for x in range(len(self.bytes_a))], [b"%d" % x for x in range(len(self.bytes_b))]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        self.space = self.b.piece_to_id("▁")
        self.cut = self._cutter(pieces)
        # What a cut comes to: (n_a, n_b, n_groups, n_links, groups, pairs), or False if a side's tokens do not spell it.
        self.known: dict[str, tuple | bool] = {}
        self.older: dict[str, tuple | bool] = {}

    def _cutter(self, pieces: list[str]):
        """A function that cuts a text where neither tokenizer's tokens can reach over.

        That is before a space or line end that follows something visible, and between a letter and a mark,
        unless a piece of B holds such a place; one cut is the whole text if B has other habits with spaces.
        """
        inside = {p[n : n + 2] for p in pieces for n in range(len(p) - 1)}
        alone = self.b.encode(_MARGIN + "a")[::2] == [self.space, self.b.piece_to_id("a")]
        if not alone or any(_MARGIN in x for x in inside) or any(x[1] == "▁" and x[0] != "▁" for x in inside):
            return lambda text: [text]
        letter = re.compile(f"[{_LETTERS}]").match
        marks = "".join(c for c in _MARKS if not any(x[1] == c and letter(x) for x in inside))
        lines = "" if any(x[1] == "\n" and not x[0].isspace() for x in inside) else "\n"
        stops, blanks = re.escape(marks), " " + lines
        # White space, in the widest sense, stays with the white space before it.
        return re.compile(f"(?s:.)(?:[^{blanks}{stops}]+|(?<=[\\s\u180e\u200b\ufeff])[{blanks}]" + (f"|(?<![{_LETTERS}])[{stops}]" if marks else "") + ")*").findall

    def _aligned(self, cut: str, ids_a: list[int], ids_b: list[int]) -> tuple | bool:
        spelt = cut.encode()
        if b"".join([self.bytes_a[x] for x in ids_a]) != spelt or b"".join([self.bytes_b[x] for x in ids_b]) != spelt:
            return False
        if len(ids_a) == 1 or len(ids_b) == 1:
            n_groups, groups = 1, b",".join([self.name_a[x] for x in ids_a]) + b"|" + b",".join([self.name_b[x] for x in ids_b])
            pairs = [a << 32 | b for a in ids_a for b in ids_b]
        else:
            ends_a = list(itertools.accumulate([self.size_a[x] for x in ids_a]))
            ends_b = list(itertools.accumulate([self.size_b[x] for x in ids_b]))
            ends, links = groups_and_links(ends_a, ends_b)
            shown, i, j = [], 0, 0
            for gi, gj in ends:
                shown.append(b",".join([self.name_a[x] for x in ids_a[i : gi + 1]]) + b"|" + b",".join([self.name_b[x] for x in ids_b[j : gj + 1]]))
                i, j = gi + 1, gj + 1
            n_groups, groups = len(ends), b";".join(shown)
            pairs = [ids_a[k] << 32 | ids_b[x] for k, lo, hi in links for x in range(lo, hi + 1)]
        return len(ids_a), len(ids_b), n_groups, len(pairs), groups, array("q", pairs).tobytes()

    def _pieces(self, cuts: list[str]) -> list[list[int]]:
        """B's ids of cuts, as they are in the text: B puts a space before all it reads."""
        read = self.b.encode([c[1:] if c[0] == " " else _MARGIN + c for c in cuts], num_threads=1)
        return [[self.space] if c == " " else ids if c[0] == " " else ids[2:] for c, ids in zip(cuts, read)]

    def align(self, text: str | None) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray] | None:
        """((n_a, n_b, n_groups, n_links), groups, distinct linked pairs a << 32 | b, their counts); None without tokens."""
        if not text:
            return None
        if len(self.known) > _CUTS:
            self.known, self.older = {}, self.known
        cuts = self.cut(" " + text)
        times, known, older, passing, new = Counter(cuts), self.known, self.older, {}, []
        for cut in times:
            if cut not in known:
                if cut in older:
                    known[cut] = older[cut]
                else:
                    new.append(cut)
        if new:
            for cut, a, b in zip(new, self.a.encode_batch_fast(new, add_special_tokens=False), self._pieces(new)):
                (known if len(cut) <= _LONG else passing)[cut] = self._aligned(cut, a.ids, b)
        met = known if not passing else {c: passing[c] if c in passing else known[c] for c in times}
        found = [met[c] for c in times]
        if not all(found):
            return None
        n = list(times.values())
        sizes = np.array([x[:4] for x in found]).T @ np.array(n)
        pairs, place = np.unique(np.frombuffer(b"".join([x[5] for x in found]), np.int64), return_inverse=True)
        counts = np.bincount(place, np.repeat(n, [x[3] for x in found]), len(pairs)).astype(np.int64)
        return sizes, b";".join([met[c][4] for c in cuts]), pairs, counts


@functools.lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_LONGS = ["n_a", "n_b", "n_groups", "n_links"]


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row.

    ``row`` numbers the rows; ``pairs`` holds the distinct linked (A id << 32 | B id) as little-endian 64-bit
    numbers, ``times`` how often the text links each as 32-bit numbers.
    """

    def run(batches):
        from pyspark import TaskContext

        aligner, row = _aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            out, held, first = [], 0, 0
            for n, text in enumerate(batch.column(1)):
                got = aligner.align(text.as_py())
                if got is None:
                    out.append((row, 0, 0, 0, 0, "", b"", b""))
                else:
                    out.append((row, *got[0].tolist(), hashlib.sha256(got[1]).hexdigest(), got[2].astype("<i8").tobytes(), got[3].astype("<u4").tobytes()))
                    held += 12 * len(got[2])
                row += 1
                if held > 8 << 20 or n == batch.num_rows - 1:
                    rows, *rest = zip(*out)
                    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                    columns = [pa.array(rows, pa.int64()), batch.column(0).slice(first, len(out)), *(pa.array(c, k) for c, k in zip(rest, kinds))]
                    yield pa.record_batch(columns, ["row", "doc_id", *_LONGS, "groups_sha256", "pairs", "times"])
                    out, held, first = [], 0, n + 1

    kind = docs.schema[id_col].dataType.simpleString()
    longs = ", ".join(f"{x} bigint" for x in _LONGS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"row bigint, doc_id {kind}, {longs}, groups_sha256 string, pairs binary, times binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each linked pair, and whether no pair of its A id is in more rows."""

    def run(batches):
        held, size = [], 0

        def out():
            pair, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return pair, np.bincount(n, np.concatenate([x for _, x in held]), len(pair)).astype(np.int64)

        for batch in batches:
            data = b"".join(x.as_py() for x in batch.column(0))
            pair, n = np.unique(np.frombuffer(data, "<i8"), return_counts=True)
            held.append((pair, n))
            size += len(pair)
            if size > _FLUSH:
                held, size = [out()], 0
                if len(held[0][0]) > _FLUSH // 2:
                    yield pa.record_batch([*map(pa.array, held[0])], ["pair", "n"])
                    held = []
                else:
                    size = len(held[0][0])
        if held:
            yield pa.record_batch([*map(pa.array, out())], ["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(top, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(spark: SparkSession, docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): each text's alignment.

    Texts are read with a space before them.  ``count_sum`` adds, over the text's links, the number of rows that hold
    the linked id pair anywhere; ``n_best`` counts links whose pair is in as many rows as any pair of its A id.

    A null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens: zeros and ''.
    Very long texts are read whole, cut by cut; a cut without spaces is one unit of work.  Rows repeating an id each
    count and are returned; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    if not path_a or not path_b:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    aligned = written(alignments(docs, path_a, path_b, id_col, text_col), spark, "aligned")
    counts = written(pair_counts(aligned), spark, "pair-counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(hot).toArrow().sort_by("pair")  # at most ``hot`` rows
    shared = spark.sparkContext.broadcast([top["pair"].to_numpy(), top["n"].to_numpy(), top["best"].to_numpy(zero_copy_only=False)])

    def run(batches):
        hot_pairs, hot_n, hot_best = shared.value
        lists = pa.list_(pa.int64())
        for batch in batches:
            best, total, pairs_left, times_left = [], [], [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times")):
                pairs, times = np.frombuffer(pairs.as_py(), "<i8"), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(hot_pairs, pairs), max(0, len(hot_pairs) - 1))
                met = hot_pairs[at] == pairs if len(hot_pairs) else np.zeros(len(pairs), bool)
                at = at[met]
                best.append(int(times[met][hot_best[at]].sum()))
                total.append(int((times[met] * hot_n[at]).sum()))
                pairs_left.append(pairs[~met])
                times_left.append(times[~met])
            longs = [pa.array(best, pa.int64()), pa.array(total, pa.int64())]
            yield pa.record_batch([batch.column("row"), *longs, pa.array(pairs_left, lists), pa.array(times_left, lists)], ["row", "best", "total", "pairs", "times"])

    met = written(aligned.select("row", "pairs", "times").mapInArrow(run, "row bigint, best bigint, total bigint, pairs array<bigint>, times array<bigint>"), spark, "met")
    left = met.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    left = left.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
    left = left.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total")
    )
    sums = met.select("row", "best", "total").union(left.select("row", "best", "total"))
    sums = sums.groupBy(F.col("row").alias("of")).agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum"))
    return aligned.join(sums, F.col("row") == F.col("of")).select(F.col("doc_id").alias(id_col), *_LONGS, "n_best", "count_sum", "groups_sha256")
