"""Personal data by weak supervision.

Strict patterns give base spans. Looser patterns propose more candidates, on which weak
labelers (pattern, check, gazetteer, context) vote. Expectation-maximisation estimates how
reliable each labeler is, without any truth, and its posteriors train the span classifier
that decides which candidates are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislelens.sources.files import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context")

# The base patterns. Possessive repeats and look-behinds keep them linear in
# the text; they match what the plain patterns match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser candidates.
_SPELLED_AT = re.compile(r" ?[\[(]at[\])] ?| at (?=[\w-]{2,63} dot )", re.I)
_SPELLED_DOMAIN = re.compile(r"[\w-]{2,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[a-z]{2,24})+", re.I)
_SPELLED_LOCAL = re.compile(r"[\w.%+-]{1,64}$")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
_NATIONAL = re.compile(
    r"(?<![0-9A-Za-z+.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
)
_GROUPED = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")
_SHORT_CARD = (13, 15)

# Gazetteers and context words.
_TLDS = frozenset("com org net edu gov mil int info biz io ai dev app co us uk de fr es it nl eu ca au jp cn in br ch at be se no example test".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98".split())
_NEAR = {
    "email": re.compile(r"e-?mail|contact|write to|reach|address|mailto|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|ping|client|login", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|\btel\b|call|fax|mobile|whatsapp|telefon|téléphone|teléfono", re.I),
}
_FAR = re.compile(r"version|isbn|issn|order|invoice|section|figure|serial|doi|checksum", re.I)
_CONTEXT = 40

#: A candidate is added when the classifier gives it at least this probability.
MIN_PROBABILITY = 0.5
ROUNDS = 50

_SPANS = "array<struct<kind: int, start: int, end: int>>"
_VOTES = "array<struct<kind: int, start: int, end: int, votes: string>>"
CANDIDATES = f"base {_SPANS}, more {_VOTES}"


# ---- candidates and votes ------------------------------------------------------------

def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if not _has_digit(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _has_digit(text: str) -> bool:
    return re.search("[0-9]", text) is not None


def _loose(text: str) -> Iterator[tuple[int, int, int]]:
    """Candidates of the looser patterns."""
    for m in _SPELLED_AT.finditer(text):
        local = _SPELLED_LOCAL.search(text[max(0, m.start() - 64) : m.start()])
        domain = _SPELLED_DOMAIN.match(text, m.end())
        if local and domain:
            yield 0, m.start() - len(local[0]), domain.end()
    if not _has_digit(text):
        return
    if ":" in text:
        for m in _IP6.finditer(text):
            yield 1, *m.span()
    for m in _CARD.finditer(text):
        alone = not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum())
        if alone and _SHORT_CARD[0] <= len(_digits(m[0])) <= _SHORT_CARD[1]:
            yield 2, *m.span()
    for m in _GROUPED.finditer(text):  # next to other digits, so that the strict pattern took too many
        yield 2, *m.span()
    for m in _NATIONAL.finditer(text):
        yield 3, *m.span()


def _vote(text: str, kind: int, start: int, end: int, strict: bool) -> str:
    """One character per labeler: + for, - against, 0 no opinion."""
    found = text[start:end]
    digits = _digits(found)
    if kind == 0:
        tail = re.split(r"[^a-z]+", found.lower())[-1]
        check, listed = "+" if len(tail) >= 2 else "-", "+" if tail in _TLDS else "-"
    elif kind == 1:
        parts = found.split(".") if "." in found else found.split(":")
        check = "+" if len(set(parts)) > 1 else "-"
        listed = "-" if found.startswith(("0.", "127.", "255.")) else "0"
    elif kind == 2:
        check, listed = "+" if _luhn(digits) else "-", "+" if digits[0] in "3456" else "-"
    else:
        check = "+" if len(set(digits)) > 2 else "-"
        listed = "+" if strict and any(digits[:n] in _CALLING for n in (1, 2)) else "0"
    near = text[max(0, start - _CONTEXT) : start]
    context = "+" if _NEAR[KINDS[kind]].search(near) else "-" if _FAR.search(near) else "0"
    return ("+" if strict else "-" if kind == 2 else "0") + check + listed + context


def _inspect(text: str | None) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_spans(text)
    more = [(k, s, e, "b" + _vote(text, k, s, e, True)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    opens = [s for s, _ in taken]
    ends = list(accumulate((e for _, e in taken), max))
    for k, s, e in sorted(_loose(text), key=lambda c: (c[1], c[0])):
        i = bisect_left(opens, e)  # base spans that open before the candidate ends
        if not i or ends[i - 1] <= s:
            more.append((k, s, e, "c" + _vote(text, k, s, e, False)))
    return base, more


def _inspected(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        found = [_inspect(t) for t in texts]
        yield pd.DataFrame({
            "base": [[dict(zip(("kind", "start", "end"), s)) for s in b] for b, _ in found],
            "more": [[dict(zip(("kind", "start", "end", "votes"), s)) for s in m] for _, m in found],
        })


# ---- reliabilities and classifier ----------------------------------------------------

def _signs(votes: str) -> np.ndarray:
    return np.array([{"+": 1, "-": 2, "0": 0}[v] for v in votes[1:]])


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over (kind, votes, count): posteriors, and P(vote | labeler, truth).

    Labelers are independent given the truth and share one table over all kinds; the share of
    true candidates is estimated per kind. Counts are smoothed by a prior that a vote is
    rather right than wrong.
    """
    kinds = np.array([k for k, _, _ in patterns])
    votes = np.array([_signs(v) for _, v, _ in patterns])
    counts = np.array([n for _, _, n in patterns], float)
    prior = np.array([[2.0, 1.0, 4.0], [2.0, 4.0, 1.0]])  # rows: false, true; columns: 0, +, -
    table = np.repeat((prior / prior.sum(1, keepdims=True))[None], len(LABELERS), 0)
    share = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        odds = np.stack([np.log(1 - share[kinds]), np.log(share[kinds])])
        for l in range(len(LABELERS)):
            odds += np.log(table[l][:, votes[:, l]])
        posterior = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -500, 500)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for l in range(len(LABELERS)):
            table[l] = prior + np.stack([np.bincount(votes[:, l], w, 3) for w in weight])
        table /= table.sum(2, keepdims=True)
        for k in range(len(KINDS)):
            own = kinds == k
            share[k] = (weight[1, own].sum() + 1) / (counts[own].sum() + 2)
    return posterior, table


def _features(kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
    signs = np.concatenate([votes == 1, votes == 2], 1).astype(float)
    return np.concatenate([np.eye(len(KINDS))[kinds], signs], 1)


def classify(patterns: list[tuple[int, str, int]]) -> list[float]:
    """Probability of every pattern by logistic regression on the posteriors, weighted by counts."""
    if not patterns:
        return []
    posterior, _ = reliabilities(patterns)
    x = _features(np.array([k for k, _, _ in patterns]), np.array([_signs(v) for _, v, _ in patterns]))
    counts = np.array([n for _, _, n in patterns], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps with a ridge of one
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (posterior - p)) - w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return [float(v) for v in 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))]


def scan(docs: DataFrame, *, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Spans of personal data, one row per input row.

    Columns: doc_id, base and spans (arrays of kind, start, end in code points, by kind as in
    ``KINDS``, then start; ``spans`` holds the base ones and the candidates that the
    classifier accepts). Null text is empty. The vote counts that train the classifier come
    from all documents; there are at most ``2 * kinds * 3 ** labelers`` different ones.
    """
    inspected = F.pandas_udf(_inspected, CANDIDATES)
    found = cut_lineage(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), inspected("text").alias("_c")).select("doc_id", "_c.*"))
    votes = found.select(F.explode("more").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    patterns = sorted((r.kind, r.votes, r.n) for r in votes.collect())
    likely = [(k, v) for (k, v, _), p in zip(patterns, classify(patterns)) if p >= min_probability and v[0] == "c"]
    accepted = F.array(*[F.lit(f"{k}{v}") for k, v in likely]).cast("array<string>")
    added = F.transform(
        F.filter("more", lambda c: F.array_contains(accepted, F.concat(c["kind"].cast("string"), c["votes"]))),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _joined(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind of the base spans, a hash of them, and all spans as text."""
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )
