"""Toxic spans with a linear-chain conditional random field.

Documents are labelled, tokens are not; a token of a toxic document is labelled toxic if
it, or its beginning, occurs in toxic documents far more often than in others.  The
field has two states, a weight for each such word or word beginning, and transitions;
it is fitted on windows of a bounded sample of labelled documents.  Whole texts are then
tagged: forward-backward gives each token's marginal.  Between tokens that have a
feature, the chain repeats one step, whose powers are known in closed form, so exact
marginals cost as many steps as there are such tokens.  Marginals sum up to document
scores, calibrated on the sample, and to the offending spans.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.llm.common import mix, text_buffer, words_of, written

SAMPLE = 10_000  # labelled documents of each class to fit on, the first by hash: the bound of what is fitted on
WINDOWS = 30_000  # windows of the sample to fit the field on
HALF = 8  # tokens on each side of a window's middle
HEADS = (4, 5, 6)  # bytes of word beginnings
FEWEST, ODDS, MOST = 4, 3.0, 50_000  # toxic sample documents a feature needs, least log-odds, most features
DECIDE = 0.7
_BYTES = 4 << 20


def _gap() -> np.ndarray:
    """Bytes between tokens: all but letters and bytes of letters beyond ASCII."""
    gap = np.ones(256, bool)
    gap[65:91] = gap[97:123] = gap[128:] = False
    return gap


def tokens(texts: pa.Array):
    """Blocks of rows: (first row, number of rows, bytes, byte offsets, features (token x 4), start byte, row)."""
    data, offsets = text_buffer(texts)
    gap, salt = _gap(), mix(np.arange(1 + len(HEADS), dtype=np.uint64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BYTES, side="right")) - 1)
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, starts, rows = words_of(part, at, gap, HEADS)
        yield a, b - a, part, at, hashes ^ salt, starts, rows
        a = b


def held_out(id_col: Column) -> Column:
    """Rows kept for judging: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Field(NamedTuple):
    keys: np.ndarray  # features, sorted
    weights: np.ndarray  # of the toxic state
    bias: float
    moves: np.ndarray  # log-potentials, state before x state
    scale: tuple[float, ...]  # of the calibration: constant, and one for each of ``summary``


def feature_table(sample: DataFrame) -> np.ndarray:
    """Features of toxic tokens, sorted; ``sample`` has toxic, text."""

    def run(batches):
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist(), bool)
            for a, _, _, _, hashes, _, rows in tokens(batch.column(1)):
                row, key = np.repeat(rows, hashes.shape[1]), hashes.ravel()
                order = np.lexsort((row, key))
                row, key = row[order], key[order]
                new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
                row, key = row[new], key[new]
                own, at = np.unique(key, return_inverse=True)
                bad = np.bincount(at, toxic[a + row], len(own)).astype(np.int64)
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(own)) - bad)], ["key", "bad", "good"])

    part = sample.select("toxic", "text").mapInArrow(run, "key bigint, bad bigint, good bigint")
    sums = part.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1))
    top = sums.where(F.col("bad") >= FEWEST).withColumn("odds", odds).where(F.col("odds") >= ODDS).orderBy(F.desc("odds"), "key").limit(MOST)
    empty = mix(np.zeros(1, np.uint64)) ^ mix(np.arange(1 + len(HEADS), dtype=np.uint64))  # a word that has no such beginning
    return np.setdiff1d(top.toPandas()["key"].to_numpy(np.int64).view(np.uint64), empty)


def look_up(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each token the numbers of its features, counted from 1; 0 for none."""
    if not len(keys):
        return np.zeros(hashes.shape, np.int32)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == hashes, at + 1, 0).astype(np.int32)


def windows(sample: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, class of the document) of windows around sample tokens with a feature, and around two others of each document."""
    wide = 2 * HALF + 1

    def run(batches):
        for batch in batches:
            toxic = np.array(batch.column(0).to_pylist(), bool)
            for a, n, _, _, hashes, _, rows in tokens(batch.column(1)):
                found = look_up(hashes, keys)
                out, labels, classes = [], [], []
                bounds = np.searchsorted(rows, np.arange(n + 1))
                for r in range(n):
                    own = found[bounds[r] : bounds[r + 1]]
                    if not len(own):
                        continue
                    hit = own.any(1)
                    middles = {*np.flatnonzero(hit)[:: 1 + hit.sum() // 4].tolist(), len(own) // 3, 2 * len(own) // 3}
                    padded = np.concatenate([np.full((HALF, own.shape[1]), -1, np.int32), own, np.full((HALF, own.shape[1]), -1, np.int32)])
                    for m in sorted(middles):
                        piece = padded[m : m + wide]
                        out.append(piece.tobytes())
                        labels.append(((piece > 0).any(1) & toxic[a + r]).tobytes())
                        classes.append(int(toxic[a + r]))
                yield pa.record_batch([pa.array(out, pa.binary()), pa.array(labels, pa.binary()), pa.array(classes, pa.int32())], ["x", "y", "toxic"])

    got = sample.select("toxic", "text").mapInArrow(run, "x binary, y binary, toxic int").orderBy(F.xxhash64("x", "y"), "toxic").limit(WINDOWS).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.int32).reshape(-1, wide, 1 + len(HEADS))
    return x, np.frombuffer(b"".join(got["y"]), bool).reshape(-1, wide), got["toxic"].to_numpy(int)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_features: int, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-4):
    """(weights, bias, moves): gradient ascent (Adam) on the conditional likelihood of the windows, each counted ``weight`` times."""
    real = x[:, :, 0] >= 0
    ids = np.maximum(x, 0)
    theta = np.zeros(n_features + 1 + 1 + 4)  # feature 0 is none; bias; moves
    theta[n_features + 1] = -2.0
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    n, length = y.shape
    if not n:
        return theta[1 : n_features + 1], float(theta[n_features + 1]), theta[-4:].reshape(2, 2)
    for step in range(1, rounds + 1):
        w, bias, moves = theta[: n_features + 1].copy(), theta[n_features + 1], theta[-4:].reshape(2, 2)
        w[0] = 0
        node = np.zeros((n, length, 2))
        node[:, :, 1] = w[ids].sum(2) + bias
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = node[:, 0] * real[:, 0, None]
        # A place outside the document passes states through unchanged, at no cost.
        for t in range(1, length):
            ahead = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + node[:, t]
            begin = ~real[:, t - 1, None]
            alpha[:, t] = np.where(real[:, t, None], np.where(begin, node[:, t], ahead), alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            back = node[:, t + 1] + beta[:, t + 1]
            both = np.logaddexp(back[:, 0, None] + moves[:, 0], back[:, 1, None] + moves[:, 1])
            beta[:, t] = np.where(real[:, t + 1, None] & real[:, t, None], both, beta[:, t + 1] * real[:, t, None])
        total = np.logaddexp(alpha[:, :, 0] + beta[:, :, 0], alpha[:, :, 1] + beta[:, :, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total)
        error = (y - p1) * real * weight[:, None]
        slope = np.zeros_like(theta)
        slope[: n_features + 1] = np.bincount(ids.ravel(), np.repeat(error.ravel(), ids.shape[2]), n_features + 1)
        slope[0] = 0
        slope[n_features + 1] = error.sum()
        pair = real[:, 1:] & real[:, :-1]
        for i in (0, 1):
            for j in (0, 1):
                joint = np.exp(alpha[:, :-1, i] + moves[i, j] + node[:, 1:, j] + beta[:, 1:, j] - total[:, 1:])
                seen = (y[:, :-1] == i) & (y[:, 1:] == j)
                slope[-4 + 2 * i + j] = ((seen - joint) * pair * weight[:, None]).sum()
        slope = slope / weight.sum() - ridge * theta
        mean, var = 0.9 * mean + 0.1 * slope, 0.99 * var + 0.01 * slope**2
        theta += rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
    return theta[1 : n_features + 1], float(theta[n_features + 1]), theta[-4:].reshape(2, 2).copy()


def marginals(at: np.ndarray, scores: np.ndarray, length: int, bias: float, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of the tokens at places ``at`` of a document of ``length`` tokens; the others have no feature."""
    plain = np.exp(moves) * np.array([1.0, np.exp(bias)])  # one step into a token without a feature
    values, right = np.linalg.eig(plain)
    values, right = np.real(values), np.real(right)
    order = np.argsort(-np.abs(values))
    values, right = values[order], right[:, order]
    left = np.linalg.inv(right)
    ratio = values[1] / values[0]

    def power(r: int) -> np.ndarray:
        """The r-th power, up to a factor."""
        return np.outer(right[:, 0], left[0]) + ratio**r * np.outer(right[:, 1], left[1])

    start = np.array([1.0, np.exp(bias)])
    emit = np.stack([np.ones(len(at)), np.exp(np.clip(scores, -50, 50))], 1)
    step, ahead, last = np.exp(moves), [], None
    for k, (place, e) in enumerate(zip(at.tolist(), emit)):
        if last is None:
            v = e if place == 0 else (start @ power(place - 1)) @ step * e
        else:
            v = (v @ power(place - last - 1)) @ step * e
        v = v / v.sum()
        ahead.append(v)
        last = place
    out, b = np.zeros(len(at)), power(length - 1 - last) @ np.ones(2) if last is not None else None
    for k in range(len(at) - 1, -1, -1):
        b = b / b.sum()
        p = ahead[k] * b
        out[k] = p[1] / p.sum()
        if k:
            b = power(int(at[k] - at[k - 1]) - 1) @ (step @ (emit[k] * b))
    return out


def summary(p: np.ndarray, length: int) -> list[float]:
    """Of a document's marginals: expected toxic tokens (log), the largest, and their share."""
    total = float(p.sum())
    return [np.log1p(total), float(p.max(initial=0)), min(1.0, 50 * total / max(length, 1))]


_OUT = "tokens bigint, s0 double, s1 double, s2 double, spans array<struct<start:bigint,end:bigint,p:double>>"


def tag(spark: SparkSession, docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, tokens, s0, s1, s2, spans): the summary of the marginals, and toxic spans in code points."""
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        weights, gap = np.append(0.0, field.weights), _gap()
        for batch in batches:
            columns = {c: [] for c in ("tokens", "s0", "s1", "s2", "spans")}
            for _, n, data, offsets, hashes, starts, rows in tokens(batch.column(1)):
                found = look_up(hashes, field.keys)
                hit = np.flatnonzero(found.any(1))
                bounds = np.searchsorted(rows, np.arange(n + 1))
                cuts = np.searchsorted(hit, bounds)
                for r in range(n):
                    length, own = int(bounds[r + 1] - bounds[r]), hit[cuts[r] : cuts[r + 1]]
                    p = marginals(own - bounds[r], weights[found[own]].sum(1) + field.bias, length, field.bias, field.moves) if len(own) else np.zeros(0)
                    spans = []
                    if (p >= least).any():
                        text = data[offsets[r] : offsets[r + 1]]
                        point = np.append(0, np.cumsum((text & 0xC0) != 0x80))
                        for token, q in zip(own[p >= least].tolist(), p[p >= least].tolist()):
                            a = int(starts[token] - offsets[r])
                            b = _token_end(text, a, gap)
                            spans.append({"start": int(point[a]), "end": int(point[b]), "p": q})
                    s = summary(p, length)
                    for name, value in zip(columns, (length, *s, spans)):
                        columns[name].append(value)
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))]
            yield pa.record_batch([batch.column(0), *(pa.array(v, k) for v, k in zip(columns.values(), kinds))], ["id", *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, {_OUT}")


def _token_end(text: np.ndarray, at: int, gap: np.ndarray, step: int = 1 << 12) -> int:
    """The first byte from ``at`` on that is no part of a token, or the text's end."""
    while at < len(text):
        after = np.flatnonzero(gap[text[at : at + step]])
        if len(after):
            return at + int(after[0])
        at, step = at + step, 2 * step
    return len(text)


def calibrate(s: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, ...]:
    """Logistic regression of labels on summaries, each counted ``weight`` times, with a small ridge."""
    x = np.column_stack([np.ones(len(s)), s]) if len(s) else np.zeros((0, 4))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        bend = (x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(x.shape[1])
        move = np.linalg.solve(bend, x.T @ (weight * (y - p)) - 0.1 * beta)
        beta += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-7:
            break
    return tuple(beta.tolist())


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """A field fitted on at most ``SAMPLE`` labelled documents of each class, none of them held out.

    A class cut to its sample counts as many times as it has labelled documents, so that the scores' base rate is
    that of all labels whatever their number.  Rows without an id or a label of 0 or 1 are left out; with one class only the field says nothing.
    """
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("toxic"))
    ordered = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("i"), "i").limit(SAMPLE) for c in (0, 1)]
    ids = written(ordered[0].union(ordered[1]), spark, "sample-ids")  # at most 2 * SAMPLE rows, hence the broadcast
    sample = written(docs.join(F.broadcast(ids), F.col(id_col) == F.col("i")).select("toxic", F.col(text_col).alias("text"), "i"), spark, "sample")
    # Classes count as in all labels, not as in the sample; without a cut these are ones.
    n = dict(known.groupBy("toxic").count().collect())
    share = np.array([max(1.0, n.get(c, 0) / SAMPLE) for c in (0, 1)])
    keys = feature_table(sample)
    x, y, own = windows(sample, keys)
    weights, bias, moves = fit(x, y, share[own], len(keys))
    field = Field(keys, weights, bias, moves, ())
    seen = tag(spark, sample, field, "i", "text").select("id", "s0", "s1", "s2").join(F.broadcast(ids), F.col("id") == F.col("i")).toPandas()
    return field._replace(scale=calibrate(seen[["s0", "s1", "s2"]].to_numpy(float), seen["toxic"].to_numpy(float), share[seen["toxic"].to_numpy(int)]))


def score(spark: SparkSession, docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, tokens, spans) of each document.

    Null and empty texts get the score of a text without toxic tokens; repeated rows are scored alike;
    an empty table gives no rows; other columns are ignored.
    """
    tagged = tag(spark, docs, field, id_col, text_col)
    c = field.scale or (0.0, 0.0, 0.0, 0.0)
    logit = F.lit(c[0]) + F.col("s0") * c[1] + F.col("s1") * c[2] + F.col("s2") * c[3]
    value = 1 / (1 + F.exp(-logit))
    return tagged.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), value.alias("score"), (value >= DECIDE).cast("int").alias("predicted"), "tokens", "spans"
    )
