"""Personal data by weak supervision.

Candidates are spans that a kind's exact pattern finds (base spans, always kept) or a
broader one does.  Four labelers vote on each: the exact pattern with its check, a
gazetteer, the words before it, and its shape.  Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, without labels; its posteriors
train a logistic span classifier, which decides on the candidates beyond the base.

Texts are read once; the counts of patterns cover all candidates, and there are at most
``kinds * 3**labelers * 2**features`` of them, so the fit is the same at every size.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.llm.common import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "shape")
FEATURES = ("long", "spaced", "near start of line")
ACCEPT = 0.9  # probability from which a span beyond the base is added

# The contract's base patterns, in forms that read a text once (a run of digits or of
# address characters is entered at its start only, which is where the leftmost match begins).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Broader forms.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\] ] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}")
_NATIONAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_CONTEXT = {  # words that speak for a kind, and words that speak against all
    "email": re.compile(r"mail|contact|write|reach", re.I), "ip": re.compile(r"\bip\b|host|server|address|client", re.I),
    "card": re.compile(r"card|visa|credit|account|payment", re.I), "phone": re.compile(r"phone|call|tel|mobile|fax|whatsapp", re.I),
}
_AGAINST = re.compile(r"order|version|isbn|serial|invoice|sku|\bno\b|\bid\b|#\s*\Z", re.I)
_DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl"}
_CALLING = ("1", "33", "34", "39", "31", "41", "43", "44", "49", "52", "54", "55", "61", "81", "86", "91")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and (text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-")):
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def _is_byte(part: str) -> bool:
    """Whether digits, with any number of leading zeros, stand for at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, kind by kind."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_is_byte, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def broad_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the broader patterns."""
    out = [("email", *m.span()) for m in _SPELT.finditer(text)] if "(at)" in text or "[at]" in text else []
    for m in _IP.finditer(text):
        if not all(map(_is_byte, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and not luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in _NATIONAL.finditer(text)]


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """+1, -1 or 0 of each labeler."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    if kind == "email":
        known = 1 if span.rpartition(".")[2].lower() in _DOMAINS else -1
    elif kind == "ip":
        known = -1 if span.split(".")[0] in ("0", "255") else 0
    elif kind == "card":
        known = 1 if span[0] in "3456" and 13 <= sum(c.isdigit() for c in span) <= 16 else -1
    else:
        known = (1 if span[1:].startswith(_CALLING) else -1) if span[0] == "+" else 0
    context = 1 if _CONTEXT[kind].search(before) else -1 if _AGAINST.search(before) else 0
    open_end = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    pattern = 1 if base else 0 if kind in ("email", "phone") else -1
    return pattern, known, context, -1 if open_end else 1


def _features(text: str, start: int, end: int) -> int:
    span = text[start:end]
    return (end - start > 16) + 2 * (" " in span) + 4 * (start < 2 or "\n" in text[start - 2 : start])


def _key(kind: str, vote: tuple[int, ...], features: int) -> int:
    number = KINDS.index(kind)
    for v in vote:
        number = number * 3 + v + 1
    return number * 2 ** len(FEATURES) + features


def _read_key(key: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    bits = tuple(key >> n & 1 for n in range(len(FEATURES)))
    key >>= len(FEATURES)
    vote = []
    for _ in LABELERS:
        key, v = divmod(key, 3)
        vote.append(v - 1)
    return key, tuple(reversed(vote)), bits


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,key:int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of each document: all candidates in order, with the key of their votes and features."""

    def found(text):
        base = base_spans(text)
        taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
        more = [(k, a, b) for k, a, b in broad_spans(text) if not any(x < b and a < y for x, y in taken[k])]
        for is_base, spans in ((True, base), (False, more)):
            for kind, a, b in spans:
                yield {"start": a, "kind": KINDS.index(kind), "end": b, "base": is_base, "key": _key(kind, votes(text, kind, a, b, is_base), _features(text, a, b))}

    kind_of = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("key", pa.int32())]))

    def run(batches):
        for batch in batches:
            spans = [sorted(found(t.as_py() or ""), key=lambda s: (s["start"], s["kind"])) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind_of)], ["id", "spans"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {id_kind}, spans {_SPAN}")


def reliabilities(patterns: dict[tuple[int, tuple[int, ...]], int], rounds: int = 50) -> tuple[dict, np.ndarray]:
    """Posterior of each (kind, votes) pattern and P(vote | label) per labeler, by expectation-maximisation.

    A prior worth a twentieth of the spans says that labelers are right more often than not, the exact pattern most.
    """
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    vote = np.array([k[1] for k in keys], int).reshape(len(keys), len(LABELERS)) + 1
    kind = np.array([k[0] for k in keys], int)
    prior = np.array([[[0.40, 0.35, 0.25], [0.25, 0.35, 0.40]]] * len(LABELERS))
    prior[0] = [[0.80, 0.15, 0.05], [0.05, 0.15, 0.80]]
    table, share, weight = prior.copy(), np.full(len(KINDS), 0.5), max(1.0, n.sum() / 20)
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        odds = np.log(share[kind] / (1 - share[kind]))
        for j in range(len(LABELERS)):
            odds += np.log(table[j, 1, vote[:, j]] / table[j, 0, vote[:, j]])
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for j, v, y in itertools.product(range(len(LABELERS)), range(3), (0, 1)):
            right = post if y else 1 - post
            table[j, y, v] = ((n * right)[vote[:, j] == v].sum() + weight * prior[j, y, v]) / ((n * right).sum() + weight)
        for k in range(len(KINDS)):
            own = kind == k
            share[k] = np.clip(((n * post)[own].sum() + 1) / (n[own].sum() + 2), 0.02, 0.98)
    return dict(zip(keys, post)), table


def span_classifier(counts: dict[int, int], rounds: int = 300) -> dict[int, float]:
    """Probability of each key, by a logistic regression on votes, features and kind fitted to the posteriors."""
    if not counts:
        return {}
    read = {key: _read_key(key) for key in counts}
    patterns: dict = {}
    for key, n in counts.items():
        patterns[read[key][:2]] = patterns.get(read[key][:2], 0) + n
    post, _ = reliabilities(patterns)
    rows = [[kind == k for k in range(len(KINDS))] + [v == x for v in vote for x in (-1, 1)] + list(bits) for kind, vote, bits in read.values()]
    x = np.array(rows, float).reshape(len(read), -1)
    y = np.array([post[r[:2]] for r in read.values()])
    w = np.sqrt(np.array([counts[k] for k in read], float))  # common patterns lead, rare ones are heard
    w /= max(w.sum(), 1e-9)
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - 1e-3 * beta
        bend = (x.T * (w * p * (1 - p))) @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(read, 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))))


def shown(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def detect(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, spans, added): per document its spans (struct of start, kind, end, base, key) in order; ``added`` counts those beyond the base.

    Null and empty texts have no spans; repeated rows are each returned; an empty table gives
    no rows; other columns are ignored.
    """
    found = written(candidates(docs, id_col, text_col), spark, "candidates")
    counts = dict(found.select(F.explode("spans").alias("s")).groupBy("s.key").count().collect())
    good = sorted(key for key, p in span_classifier(counts).items() if p >= accept)
    keep = F.filter("spans", lambda s: s["base"] | s["key"].isin(good)) if good else F.filter("spans", lambda s: s["base"])
    return found.select(F.col("id").alias(id_col), keep.alias("spans")).withColumn("added", F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint"))


def digest(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    is_base = lambda k: lambda s: s["base"] & (s["kind"] == k)
    count = [F.size(F.filter("spans", is_base(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return detected.select(id_col, *count, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
