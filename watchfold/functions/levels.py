"""Scores, bands, tiers and their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from watchfold import constants as K


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rank_of(value: Column | str, order: Sequence[str]) -> Column:
    """0-based position of a label in ``order``; null for any other."""
    v = _as_column(value)
    out = F.when(v == order[0], 0)
    for i, label in enumerate(order[1:], 1):
        out = out.when(v == label, i)
    return out


def label_of(rank: Column, order: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(o) for o in order]), (rank + 1).cast("int"))


def score_likelihood(name: Column | str) -> Column:
    """Score of a likelihood name; a name not in the table scores as unknown."""
    n = _as_column(name)
    out = None
    for label, score in K.LIKELIHOOD_SCORE.items():
        out = F.when(n == label, score) if out is None else out.when(n == label, score)
    return out.otherwise(K.LIKELIHOOD_DEFAULT)


def score_action(score: Column | str) -> Column:
    s = _as_column(score)
    return F.when(s <= K.PASS_MAX, "pass").when(s <= K.REVIEW_MAX, "review").when(s.isNotNull(), "block")


def text_action(verdict: Column | str) -> Column:
    return F.when(_as_column(verdict).isin(*K.TEXT_FLAGGED), "block").otherwise("pass")


def confidence_band(score: Column | str) -> Column:
    s = _as_column(score)
    out = None
    for top, name in K.BANDS:
        out = F.when(s <= top, name) if out is None else out.when(s <= top, name)
    return out.when(s.isNotNull(), K.TOP_BAND)


def severity(level: Column | str, deltas: Sequence[tuple[Column, int]]) -> Column:
    """Base severity moved by each matched bump in turn, kept within low..critical."""
    rank = rank_of(level, K.SEVERITIES)
    for matched, delta in deltas:
        moved = F.greatest(F.lit(0), F.least(F.lit(len(K.SEVERITIES) - 1), rank + delta))
        rank = F.when(matched, moved).otherwise(rank)
    return label_of(rank, K.SEVERITIES)


def decision_tier(p: Column | str, threshold: float) -> Column:
    """allow < 0.15, step-up < 0.35, review < threshold, else block; block comes first."""
    q = _as_column(p)
    return F.when(q >= threshold, "block").when(q < 0.15, "allow").when(q < 0.35, "step_up").otherwise("review")


def psi_band(psi: Column | str) -> Column:
    x = _as_column(psi)
    return F.when(x > K.PSI_ALARM, "alarm").when(x >= K.PSI_WATCH, "watch").otherwise("stable")
