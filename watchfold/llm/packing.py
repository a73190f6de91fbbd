"""Harmonic packing of tokenised documents into fixed-length sequences.

A document is cut into pieces whose lengths fall into reciprocal-capacity classes:
a piece of class ``k`` takes at most ``capacity // k`` tokens, and every sequence of
that class holds exactly ``k`` pieces.  Whole multiples of the capacity are sequences
of their own; a rest is left whole if its class wastes little, else it is cut at the
next smaller slot, which it then fills exactly.  Each task fills its classes alone; only the
pieces of sequences left open at its end are exchanged.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from watchfold.llm.common import bounded_batches, give_back, written

CAPACITY = 2048
WASTE = 32  # a rest stays whole if it leaves at most a part of 1/WASTE of its slot empty
_CACHE = 500_000  # chunks whose ids a task remembers (speed only)
# Code points whose classes and cases no Unicode version has changed; tests compare all of them with the tokenizer.
_PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u024f]*").fullmatch


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordPieces:
    """Ids of whole texts under a tokenizers file of the word-end BPE kind, as little-endian unsigned 32-bit bytes.

    Such a tokenizer never joins what white space separates, and lower-cases; so each chunk
    between white space is looked up or encoded once.  Its merges are run by tiktoken, whose
    byte-pair ranks are the vocabulary's own order: a byte that UTF-8 never uses stands for
    the word end.  Texts with other than plain code points (see ``_PLAIN``), or with
    what may be a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}
        ranks = {}
        for token, number in vocab.items():
            body, end = (token[:-4], b"\xff") if token.endswith("</w>") and len(token) > 4 else (token, b"")
            if all(c in byte_of for c in body):
                ranks.setdefault(bytes(byte_of[c] for c in body) + end, number)
        self.encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pack = functools.cache(lambda n: struct.Struct(f"<{n}I").pack)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.known: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            ids = self.encode(chunk.encode() + b"\xff")
        elif chunk[:-1].isalpha() and chunk[-1] in ".,":
            ids = [*self.encode(chunk[:-1].encode() + b"\xff"), *self.encode(chunk[-1].encode() + b"\xff")]
        else:
            ids = [x for word in self.split(chunk) for x in self.encode(word.encode() + b"\xff")]
        out = self.pack(len(ids))(*ids)
        if len(self.known) >= _CACHE:
            self.known.clear()
        self.known[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, chunk = self.known.get, self._chunk
        return b"".join([known(c) or chunk(c) for c in text.lower().split()])


def cuts(length: int, capacity: int = CAPACITY, waste: int = WASTE) -> list[tuple[int, int]]:
    """(piece length, class) of a document's pieces in order; the class is the number of pieces in a sequence."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        k = capacity // slot  # the most pieces of this slot that fit
        if (slot - rest) * waste <= slot:
            out.append((rest, k))
            break
        slot = capacity // (k + 1)
        out.append((slot, capacity // slot))
        rest -= slot
    return out


_ROWS = "start bigint, length bigint, ids binary, doc_tokens bigint, class int, task int, nth bigint, offset bigint, full boolean"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, waste: int = WASTE) -> DataFrame:
    """Tokenise, cut and fill, task by task.

    Rows (doc_id, start, length, ids, doc_tokens, class, task, nth, offset, full): of a full sequence ``nth`` is
    its number in the task and ``offset`` the piece's place; of the at most one open sequence per class
    ``nth`` only orders its pieces.
    """

    def run(batches):
        from pyspark import TaskContext

        encoder, task = WordPieces(tokenizer), TaskContext.get().partitionId()
        end, waiting, filled = np.array([end_id], "<u4").tobytes(), {}, 0
        names = ["doc_id", *(x.split()[0] for x in _ROWS.split(", "))]
        long, id_type = pa.int64(), None

        def out(rows):
            kinds = [id_type, long, long, pa.binary(), long, pa.int32(), pa.int32(), long, long, pa.bool_()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            id_type, rows, held = batch.column(0).type, [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                total, at = len(ids) // 4, 0
                for length, k in cuts(total, capacity, waste):
                    own = waiting.setdefault(k, [])
                    own.append((name, at, length, ids[4 * at : 4 * (at + length)], total))
                    at += length
                    if len(own) == k:
                        offset = 0
                        for piece in own:
                            rows.append((*piece, k, task, filled, offset, True))
                            offset += piece[2]
                        filled += 1
                        own.clear()
                held += len(ids)
                if held > 8 << 20 and rows:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)
        rows = [(*piece, k, task, n, 0, False) for k, own in waiting.items() for n, piece in enumerate(own)]
        if rows:
            yield out(rows)
        del encoder, waiting, rows
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, {_ROWS}")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, waste: int = WASTE, group: int = 256) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces and their places.

    ``ids`` holds unsigned 32-bit little-endian token ids.  Sequences hold up to ``capacity`` ids, gapless
    from offset 0.  What tasks leave open is filled up, class by class, among the pieces of ``group`` tasks; the last open sequences of the
    classes are laid end to end, so a group of tasks ends in one short sequence.
    A null or empty text is the end id alone; rows repeating an id are packed each; a null id stays null;
    an empty table gives no pieces.  Other columns of ``docs`` are ignored.
    """
    bounded_batches(spark)
    cut = written(pieces(docs, tokenizer or tokenizer_path(), id_col, text_col, end_id, capacity, waste), spark, "pieces")
    shown = ["doc_id", "start", "length", "ids", "doc_tokens"]
    full = cut.where("full").select(*shown, (F.col("task").cast("bigint") * F.lit(1 << 32) + F.col("nth")).alias("sequence_id"), "offset")
    rest = cut.where("not full").withColumn("team", F.floor(F.col("task") / group))
    order = Window.partitionBy("team", "class").orderBy("task", "nth")
    rest = rest.withColumn("at", F.floor((F.row_number().over(order) - 1) / F.col("class")))
    inside = Window.partitionBy("team", "class", "at").orderBy("task", "nth")
    inside = Window.partitionBy("team", "class", "at")
    rest = rest.withColumn("short", F.count("*").over(inside) < F.col("class"))
    rest = rest.withColumn("offset", F.sum("length").over(inside.orderBy("task", "nth")) - F.col("length"))
    base = F.lit(1 << 62) + F.col("team") * F.lit(1 << 40)
    number = base + F.col("class").cast("bigint") * F.lit(1 << 28) + F.col("at")
    filled = rest.where("not short").select(*shown, number.alias("sequence_id"), "offset")
    # The last open sequence of each class: laid end to end and cut where a sequence is full.
    along = Window.partitionBy("team").orderBy("class", "task", "nth")
    tail = rest.where("short").withColumn("lo", F.sum("length").over(along) - F.col("length"))
    tail = tail.withColumn("s", F.explode(F.sequence(F.floor(F.col("lo") / capacity), F.floor((F.col("lo") + F.col("length") - 1) / capacity))))
    a, b = F.greatest("lo", F.col("s") * capacity), F.least(F.col("lo") + F.col("length"), (F.col("s") + 1) * capacity)
    tail = tail.select(
        "doc_id", (F.col("start") + a - F.col("lo")).alias("start"), (b - a).alias("length"),
        F.substring("ids", (4 * (a - F.col("lo")) + 1).cast("int"), (4 * (b - a)).cast("int")).alias("ids"), "doc_tokens",
        (base + F.col("s")).alias("sequence_id"), (a - F.col("s") * capacity).alias("offset"),
    )
    return full.union(filled).union(tail)
