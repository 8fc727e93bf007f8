"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols by a lexicon, a transducer over letters: the longest learned key that a word begins with (a stem, or
the whole word) gives its class and weight.  Five small transducers read the symbols of a clause: insults, threats
(a verb of harm and its target), targets (somebody addressed, near an insult), negation (a negator before) and reported
speech (a verb of saying, or quotation marks).  Their composition is one automaton, the product of their states, whose
arcs say which of them fired together, so that a hit is counted as plain, addressed, negated or reported.  What is scored
is matched clauses: a clause's weight is the sum of its hits' weights, each by the factors of its arc.

Keys and weights of insults, and how much clauses count, are learned from labelled documents: stems by log odds of the
documents that hold them, the rest by logistic regression over clause features.  Features of a document are taken from a
lexicon of the other folds, so that words that it brought in itself do not count.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, free_names, give_back, own_columns, small_batches, stored

#: Labelled documents of each label that are learned from: those with the smallest hashes.
FIT_DOCS = 4_000
#: Folds; stem lengths; documents, log-likelihood ratio and log odds that a key needs; keys at most.
FOLDS, STEM, LEAST_DOCS, LEAST_G, LEAST_ODDS, KEYS = 4, range(3, 9), 3, 16.0, 1.0, 50_000

# Symbols, and words of the closed classes.
OTHER, TARGET, NEGATOR, REPORT, QUOTE, INSULT, HARM, BREAK = range(8)
WORDS = {
    TARGET: "you your yours yourself u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros",
    NEGATOR: "not no never neither nor without isn aren wasn don doesn didn nicht kein keine keinen nie niemals ohne pas jamais aucun aucune sans ni nunca jamás tampoco sin",
    REPORT: "said says say told wrote writes claimed claims called calls quoted according reported sagte sagt schrieb behauptete nannte laut dit disait écrit écrivait prétend appelle selon dijo dice escribió afirmó llamó según",
    HARM: "kill hurt destroy murder beat burn stab shoot töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir",
    INSULT: "idiot moron imbecile dumb scumbag dummkopf trottel abschaum crétin imbécile ordure estúpido imbécil escoria",
}
#: Weights of words that are not learned; factors of arcs.
GIVEN = 1.5
ADDRESSED_BY, NEGATED_BY, REPORTED_BY = 1.25, 0.4, 0.6
#: Words that a target or a negator reaches.
REACH, SCOPE = 4, 3
HIT, THREAT, ADDRESSED, NEGATED, REPORTED = 1, 2, 4, 8, 16

TOKEN = re.compile(r"[^\W\d_]+|[.,;:!?\n\"“”„«»]")
PUNCTUATION = dict.fromkeys(".,;:!?\n", BREAK) | dict.fromkeys("\"“”„«»", QUOTE)


def _insult(state: int, symbol: int) -> tuple[int, int]:
    return 0, HIT if symbol == INSULT else 0


def _threat(state: int, symbol: int) -> tuple[int, int]:
    """Counts down from a verb of harm; a target in reach is threatened."""
    if symbol == HARM:
        return REACH, 0
    return (0, THREAT) if symbol == TARGET and state else (max(state - 1, 0), 0)


def _target(state: int, symbol: int) -> tuple[int, int]:
    """Counts down from a target (1 to REACH) or from an insult (above); the other in reach is addressed."""
    if symbol == TARGET:
        return REACH, ADDRESSED if state > REACH else 0
    if symbol == INSULT:
        return (2 * REACH, 0) if state > REACH or not state else (state - 1, ADDRESSED)
    return (0 if state in (0, REACH + 1) else state - 1), 0


def _negation(state: int, symbol: int) -> tuple[int, int]:
    if symbol == NEGATOR:
        return SCOPE, 0
    return max(state - 1, 0), NEGATED if state and symbol in (INSULT, HARM) else 0


def _reported(state: int, symbol: int) -> tuple[int, int]:
    """A verb of saying holds to the end of the clause, quotation marks to the next ones."""
    if symbol == QUOTE:
        return (0 if state == 2 else 2), 0
    return (1 if symbol == REPORT and not state else state), REPORTED if state and symbol in (INSULT, HARM) else 0


def compose(*parts) -> tuple[list[list[int]], list[list[int]]]:
    """The product of transducers: next state and united output by (state, symbol); state 0 is the beginning."""
    number, states, follow, out = {(0,) * len(parts): 0}, [(0,) * len(parts)], [], []
    for state in states:
        steps = [[part(s, symbol) for part, s in zip(parts, state, strict=True)] for symbol in range(BREAK)]
        follow.append([])
        out.append([sum(o for _, o in step) for step in steps])
        for step in steps:
            goal = tuple(s for s, _ in step)
            if goal not in number:
                number[goal] = len(states)
                states.append(goal)
            follow[-1].append(number[goal])
    return follow, out


FOLLOW, OUTPUT = compose(_insult, _threat, _target, _negation, _reported)


class Lexicon(dict):
    """Symbols of tokens; ``weights`` of those that hit.  Keys are ``^stem`` and ``word$``; a word has its longest key."""

    def __init__(self, keys: dict[str, float]):
        super().__init__(PUNCTUATION)
        self.keys_, self.weights = keys, {}
        self.given = {w: symbol for symbol, words in WORDS.items() for w in words.split()}

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.update(PUNCTUATION)
            self.weights.clear()
        weight = self.keys_.get(f"{word}$")
        if weight is None:
            weight = next((self.keys_[s] for k in reversed(STEM) if len(word) >= k and (s := f"^{word[:k]}") in self.keys_), None)
        symbol = self.given.get(word, OTHER)
        if weight is not None and symbol in (OTHER, INSULT):
            symbol = INSULT if weight > 0 else OTHER
        if symbol in (INSULT, HARM):
            self.weights[word] = GIVEN if weight is None or symbol == HARM else weight
        self[word] = symbol
        return symbol


FEATURES = ["total", "most", "density", "addressed", "negated", "reported", "threats"]


def clauses(text: str, lexicon: Lexicon):
    """(weight, addressed, negated, reported, threats) of each clause that the grammar matches, and the number of words."""
    tokens = TOKEN.findall(text.lower())
    symbols = bytes(map(lexicon.__getitem__, tokens))
    matched, at = [], 0
    for clause in symbols.split(bytes([BREAK])):
        if INSULT in clause or HARM in clause:
            state, weight, shares, threats = 0, 0.0, [0.0, 0.0, 0.0], 0
            for i, symbol in enumerate(clause, at):
                fired = OUTPUT[state][symbol]
                state = FOLLOW[state][symbol]
                if not fired:
                    continue
                w = lexicon.weights.get(tokens[i], GIVEN) if fired & HIT else GIVEN if fired & THREAT else 0.0
                threats += bool(fired & THREAT)
                for j, (bit, factor) in enumerate(((ADDRESSED, ADDRESSED_BY), (NEGATED, NEGATED_BY), (REPORTED, REPORTED_BY))):
                    if fired & bit:
                        w *= factor
                        shares[j] += w or GIVEN * (factor - 1)
                weight += w
            if weight > 0:
                matched.append((weight, *shares, threats))
        at += len(clause) + 1
    return matched, len(tokens)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """A document's features; zeros for null and empty texts."""
    matched, n = clauses(text or "", lexicon)
    if not matched:
        return [0.0] * len(FEATURES)
    total = sum(m[0] for m in matched)
    log = math.log1p(total)
    return [log, max(m[0] for m in matched), math.log1p(1000 * total / (n + 20)), *[log * sum(m[j] for m in matched) / total for j in (1, 2, 3)], math.log1p(sum(m[4] for m in matched))]


def _counted(sample: DataFrame) -> DataFrame:
    """(key, fold, toxic, docs): labelled documents that hold each stem and word."""

    def count(batches):
        for pdf in batches:
            counts: Counter = Counter()
            for text, fold, toxic in zip(pdf["text"], pdf["fold"].tolist(), pdf["toxic"].tolist(), strict=True):
                words = {w for w in TOKEN.findall((text or "").lower()) if w not in PUNCTUATION}
                keys = {f"^{w[:k]}" for w in words for k in STEM if len(w) >= k} | {f"{w}$" for w in words}
                counts.update((key, fold, toxic) for key in keys)
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["key", "fold", "toxic", "docs"])
        give_back()

    with batch_rows(sample.sparkSession, 500):
        counts = sample.mapInPandas(count, "key string, fold int, toxic int, docs long")
        at = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("docs")).otherwise(0)).alias(f"n{y}{f}") for y in (0, 1) for f in range(FOLDS)]
        held = counts.groupBy("key").agg(*at)
        toxic = sum((F.col(f"n1{f}") for f in range(FOLDS)), F.lit(0))
        return stored(held.where(toxic >= LEAST_DOCS), "toxic-keys")


def _weights(c0: np.ndarray, c1: np.ndarray, n0: int, n1: int) -> tuple[np.ndarray, np.ndarray]:
    """(log odds, log-likelihood ratio) of keys held by c0 of n0 clean and c1 of n1 toxic documents."""
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    rate = (c0 + c1) / max(n0 + n1, 1)
    part = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)
    return odds, 2 * sum(part(c, n * rate) + part(n - c, n * (1 - rate)) for c, n in ((c0, n0), (c1, n1)))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[dict[str, float], list[float]]:
    """(keys and weights, coefficients of [1, *FEATURES]) from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    Learned from ``fit_docs`` documents of each label at most, those with the smallest hashes of their ids; shares of
    labels are those of all labelled rows.  A doc_id with several labels has the largest; null labels do not count.
    Where one label is missing nothing is learned, and only the words of the closed classes score.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(7))
    both = None
    for y in (0, 1):
        some = marked.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(fit_docs)
        both = some if both is None else both.unionByName(some)
    both = stored(both.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int")), "toxic-sample")
    share = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(both), "doc_id"), "toxic-texts")  # 2 * fit_docs rows of three numbers
    n = np.zeros((2, FOLDS))
    for r in sample.groupBy("toxic", "fold").count().collect():
        n[r["toxic"], r["fold"]] = r["count"]
    if not n.sum(1).all():
        return {}, [-3.0, 1.5, *[0.0] * (len(FEATURES) - 1)]
    table = _counted(sample)
    totals = [sum((F.col(f"n{y}{f}") for f in range(FOLDS)), F.lit(0)) for y in (0, 1)]
    ratio = totals[1] * float(n[0].sum()) - totals[0] * float(n[1].sum())
    rows = table.where(ratio > 0).orderBy(F.desc(ratio), "key").limit(KEYS).collect()  # KEYS rows at most
    keys = [r["key"] for r in rows]
    c = np.array([[[r[f"n{y}{f}"] for r in rows] for f in range(FOLDS)] for y in (0, 1)], np.float64).reshape(2, FOLDS, len(rows))

    def lexicon(left_out: int | None) -> dict[str, float]:
        keep = [f for f in range(FOLDS) if f != left_out]
        odds, g = _weights(c[0, keep].sum(0), c[1, keep].sum(0), n[0, keep].sum(), n[1, keep].sum())
        at = np.flatnonzero((g >= LEAST_G) & (odds >= LEAST_ODDS) & (c[1, keep].sum(0) >= LEAST_DOCS))
        return {keys[i]: float(odds[i]) for i in at}

    folds = [lexicon(f) for f in range(FOLDS)]

    def measure(batches):
        known: dict[int, Lexicon] = {}
        for pdf in batches:
            out = []
            for text, fold in zip(pdf["text"], pdf["fold"].tolist(), strict=True):
                if fold not in known:
                    known[fold] = Lexicon(folds[fold])
                out.append(features(text, known[fold]))
            yield pdf[["toxic"]].assign(x=out)
        give_back()

    with batch_rows(docs.sparkSession, 500):
        seen = sample.mapInPandas(measure, "toxic int, x array<double>").collect()  # 2 * fit_docs rows of seven numbers
    x, y = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], np.float64)
    beta = logistic(x, y)
    beta[0] += math.log(share[1] / share[0]) - math.log(n[1].sum() / n[0].sum())
    return lexicon(None), beta.tolist()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept."""
    design = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score(docs: DataFrame, keys: dict[str, float], beta: list[float]) -> DataFrame:
    """``docs`` and toxicity (0 to 1) of each text, null and empty ones as texts without a clause; no shuffle.

    A column of ``docs`` named ``toxicity`` keeps its name and the result gets an underscore.
    """
    (name,) = free_names(docs, "toxicity")

    def run(batches):
        lexicon = Lexicon(keys)
        for pdf in batches:
            x = np.array([features(t, lexicon) for t in pdf["text"]], np.float64).reshape(len(pdf), len(FEATURES))
            yield pdf.assign(**{name: 1 / (1 + np.exp(-np.clip(beta[0] + x @ np.array(beta[1:]), -30, 30)))})
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInPandas(run, docs.select(*own_columns(docs)).schema.add(name, "double"))


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from documents whose crc32(doc_id as text) mod 5 is not 0.

    Whole texts are scored; rows without a doc_id are scored too and not held out; repeated rows have a row each.
    """
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    keys, beta = fit(docs.select("doc_id", "text"), labels.where(~held()), fit_docs)
    scored = score(docs.select("doc_id", held().alias("held_out"), "text"), keys, beta)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
