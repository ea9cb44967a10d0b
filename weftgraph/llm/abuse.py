"""Abusive, hateful or sexual content: cumulative-link ordinal regression on sparse text features.

*Features.*  A text is split into passages (sentences); every word is folded so that disguises fall
together: compatibility forms, case, invisible characters, look-alike letters of other scripts,
digits for letters, letters set apart by dots, dashes or (four and more) blanks, repeated letters.  A
run of letters set apart that holds several words is split into words of the model.  A word with masked letters
is looked up among the words of the model by what stands before and after the mask.  Features are the
passage's words, word pairs and triples, and for Chinese characters runs of up to four.

*Model.*  Grades 0 < insult < sexual < hate < threat.  One weight vector w serves all thresholds:
P(grade <= k) = sigmoid(theta_k - w.x); a passage's severity is the expected grade
sum_k P(grade > k), a document's the greatest of its passages'.  A document is a case when
P(grade > 0) of a passage reaches ``THRESHOLD``.

*Training* happens on a bounded sample of the rated documents (``MAX_RATED``; more are sampled by a
hash of doc_id): first the documents as bags, then, as only one passage of a rated document is
abusive as a rule, the passages: of an abusive document the worst passage counts, of others all.
Wrong ratings show as documents that the model of the last round firmly contradicts; they are left
out of the next.  The weight table holds the telling features of the sample and those beside them, so it is
bounded by the sample; it goes to the workers with the task.

*Scoring* reads every document once, without a shuffle; equal passages are scored once per worker.

Defined results: null, empty and blank texts have severity 0; without any rated abusive document
every severity is 0; repeated rows are scored alike; unknown categories of abusive ratings count as
insult; two raters' grades are averaged and rounded up.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RATED = 12_000
GAP = 0.05  # least distance of two thresholds: a grade without room has no likelihood
THRESHOLD = 0.5
TELLING = 0.5  # rate from which on a feature counts as telling
PRIOR = 2.0  # documents of the average rate that every feature is drawn towards, at every size; chosen on held-out rated documents
BOOST = 2.0  # an abusive passage counts so many times: disguises make each spelling rare
GRADES = {"insult": 1, "sexual": 2, "hate": 3, "threat": 4}
N_GRADES = 5
KEPT = 150_000

# Letters of other scripts that look like Latin ones, and digits written for letters.
LOOKALIKE = str.maketrans("аеорсухкмтвнігѕјԁоρναιο", "aeopcyxkmtbhirsjdopvaio")
DIGITS = str.maketrans("0134578@$", "oieastbas")

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_CJK = "㐀-鿿"
_CJK_GAP = re.compile(f"(?<=[{_CJK}])[ .\\-_·*•]{{1,2}}(?=[{_CJK}])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:(?:[.\-_·•][^\W_])+|(?: [^\W_]){3,})(?![^\W_])")
_PASSAGE = re.compile(r"(?<=[!?。！？])\s*|(?<=[.])\s+|[\r\n]+")
_WORD = re.compile(f"[{_CJK}]|(?:(?![{_CJK}])[^\\W_])+(?:[*#]+(?:(?![{_CJK}])[^\\W_])*)*")
_REPEAT = re.compile(r"(.)\1+")


def fold_text(text: str) -> str:
    """Undo disguises that concern more than one word."""
    t = _INVISIBLE.sub("", text)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = _CJK_GAP.sub("", t)
    return t.lower()


def _joined(m: re.Match, vocabulary: Vocabulary | None = None) -> str:
    """The word, or words, whose letters are set apart."""
    run = re.sub(r"[.\-_·• ]", "", m.group())
    return vocabulary.split(run) if vocabulary else run


@lru_cache(1 << 16)
def fold_word(w: str) -> str:
    """One spelling for the disguises of a word."""
    if w.isdigit():
        return "0"
    w = w.translate(LOOKALIKE)
    if any(c.isdigit() for c in w):
        w = w.translate(DIGITS)
    return _REPEAT.sub(r"\1", w)


def passages(text: str) -> list[str]:
    """Sentences and lines of a text, folded."""
    return [p for p in _PASSAGE.split(fold_text(text)) if p and not p.isspace()]


class Vocabulary:
    """Words of the model by what is left of them when one letter is masked."""

    def __init__(self, words: dict[str, float], phrase_words: set[str] | None = None):
        self.around: dict[tuple[str, str], str] = {}
        for w in sorted(words, key=lambda x: words[x]):  # the weightiest last: it wins
            for i in range(len(w)):
                for n in (1, 2):
                    if i + n <= len(w):
                        self.around[w[:i], w[i + n :]] = w
        self.words = phrase_words or set(words)
        self.longest = max(map(len, self.words), default=0)

    def split(self, run: str) -> str:
        """A run of letters as the fewest words of the model that make it up, else as one word.

        A letter at either end may be a word of its own; letters that meet at a boundary may be folded into one.
        """
        s = fold_word(run)
        if s in self.words:
            return run
        best: list[tuple[int, int, str] | None] = [(0, -1, "")] + [None] * len(s)  # words so far, where the last one begins, the last one
        for i in range(len(s)):
            if best[i] is None:
                continue
            for a in (i, i - 1) if i else (i,):
                for e in range(i + 1, min(len(s), a + self.longest) + 1):
                    w = s[a:e]
                    edge = a == i and e == i + 1 and (not i or e == len(s))
                    if (w in self.words or edge) and (best[e] is None or best[i][0] + 1 < best[e][0]):
                        best[e] = (best[i][0] + 1, i, w)
        out, at = [], len(s)
        if best[at] is None:
            return run
        while at:
            out.append(best[at][2])
            at = best[at][1]
        return " ".join(reversed(out))

    def unmask(self, w: str) -> str:
        m = re.fullmatch(r"([^*#]*)[*#]+([^*#]*)", w)
        if not m:
            return w
        return self.around.get((fold_word(m[1]) if m[1] else "", fold_word(m[2]) if m[2] else ""), "<masked>")


def words_of(passage: str, vocabulary: Vocabulary | None = None) -> list[str]:
    out = []
    for w in _WORD.findall(_SPACED.sub(lambda m: _joined(m, vocabulary), passage)):
        if "*" in w or "#" in w:
            w = vocabulary.unmask(w) if vocabulary else "<masked>"
        elif len(w) > 1 or not "㐀" <= w <= "鿿":
            w = fold_word(w)
        out.append(w)
    return out


def features_of(words: list[str]) -> set[str]:
    """Words, pairs and triples; fours for Chinese characters."""
    out = set(words)
    n = len(words)
    for i in range(n - 1):
        pair = words[i] + " " + words[i + 1]
        out.add(pair)
        if i + 2 < n:
            triple = pair + " " + words[i + 2]
            out.add(triple)
            if i + 3 < n and "㐀" <= words[i] <= "鿿":
                out.add(triple + " " + words[i + 3])
    return out


class OrdinalModel:
    """Weights by feature and thresholds of the cumulative-link model."""

    def __init__(self, weights: dict[str, float], theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def vocabulary(self) -> Vocabulary:
        """Words that tell by themselves, and all words of what tells."""
        single = {f: x for f, x in self.weights.items() if " " not in f and len(f) > 2 and x > 0}
        return Vocabulary(single, {w for f, x in self.weights.items() if x > 0 for w in f.split()})

    def above(self, x: float) -> list[float]:
        """P(grade > k) for each threshold k, at the linear score x."""
        return [1 / (1 + math.exp(min(60.0, max(-60.0, t - x)))) for t in self.theta]

    def linear(self, features: set[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, importance: np.ndarray, n_features: int, start: tuple | None = None, rounds: int = 100, ridge: float = 3e-5, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by adaptive gradient steps on the ordinal log-likelihood.

    A row is the ids of its features, each with value 1; ``start`` are weights and thresholds to begin with.
    """
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, theta = start or (np.zeros(n_features), np.array([2.0, 2.6, 3.2, 3.8]))
    gw, gt = np.full(n_features, 1e-9), np.full(len(theta), 1e-9)
    total = importance.sum()
    at = np.arange(len(rows))
    full, dfull = np.zeros((len(rows), N_GRADES + 1)), np.zeros((len(rows), N_GRADES + 1))
    full[:, -1] = 1
    for k in range(rounds):
        step = rate * (1 - k / rounds) + 0.01
        x = np.bincount(owner, weights=w[flat], minlength=len(rows))
        cum = 1 / (1 + np.exp(-np.clip(theta[None, :] - x[:, None], -40, 40)))
        full[:, 1:-1] = cum
        dfull[:, 1:-1] = cum * (1 - cum)
        p = np.maximum(full[at, grades + 1] - full[at, grades], 1e-9)
        hi, lo = dfull[at, grades + 1], dfull[at, grades]
        slope = importance * (lo - hi) / p  # of the log-likelihood by x
        grad = np.bincount(flat, weights=slope[owner], minlength=n_features) / total - ridge * w
        tg = np.zeros(len(theta))
        np.add.at(tg, np.minimum(grades, len(theta) - 1), np.where(grades < len(theta), importance * hi / p, 0))
        np.add.at(tg, np.maximum(grades - 1, 0), np.where(grades > 0, -importance * lo / p, 0))
        tg /= total
        gw += grad**2
        gt += tg**2
        w = w + step * grad / np.sqrt(gw)
        spread = GAP * np.arange(len(theta))
        theta = np.maximum.accumulate(theta + step * tg / np.sqrt(gt) - spread) + spread
    return w, theta


def train(rated: list[tuple[str, int]], rounds: int = 2) -> OrdinalModel:
    """Fit on (text, grade) pairs; see the module's text for how passages and wrong ratings are treated."""
    grades = [g for _, g in rated]
    if not any(grades):
        return OrdinalModel({}, np.array([20.0, 21.0, 22.0, 23.0]))
    split = [list(dict.fromkeys(passages(t or ""))) for t, _ in rated]
    plain: dict[str, set[str]] = {}
    vocabulary: Vocabulary | None = None
    model: OrdinalModel | None = None

    def feats(p: str) -> set[str]:
        if vocabulary and ("*" in p or "#" in p or _SPACED.search(p)):
            return features_of(words_of(p, vocabulary))
        got = plain.get(p)
        if got is None:
            got = plain[p] = features_of(words_of(p))
        return got

    # in how many abusive and other documents a feature occurs
    bad, good = Counter(), Counter()
    for g, ps in zip(grades, split):
        if ps:
            (bad if g else good).update(set().union(*map(feats, ps)))
    share = sum(map(bool, grades)) / len(grades)

    # how often a document with the feature is abusive, drawn towards the share of abusive documents
    def rate_of(f: str) -> float:
        return (bad[f] + PRIOR * share) / (bad[f] + good[f] + PRIOR)

    telling = {f: r for f in bad if (r := rate_of(f)) > TELLING}

    def suspicion(p: str) -> float:
        best = sorted((telling[f] for f in feats(p) if f in telling), reverse=True)[:4]
        return sum(best)

    # What goes with telling features in passages of documents rated as harmless tells the senses of a
    # word apart.  Words of plain passages say nothing and get no weight, so that an abusive passage
    # that runs into a plain one is still found.
    beside, anywhere = Counter(), Counter()
    for g, ps in zip(grades, split):
        if not g:
            for p in ps:
                fs = feats(p)
                anywhere.update(fs)
                if not telling.keys().isdisjoint(fs):
                    beside.update(fs)
    context = [f for f, n in beside.most_common() if n >= 2 and f not in telling and n > 0.3 * anywhere[f]]
    kept = [*sorted(telling, key=lambda f: (-telling[f] * bad[f], f)), *context]
    index = {f: i for i, f in enumerate(kept)}

    suspect = {i for i, ps in enumerate(split) if grades[i] and suspicion_of(ps, suspicion) <= 0}
    start = None
    for step in range(rounds + 1):
        units: dict[tuple[str, int], float] = defaultdict(float)
        for i, ps in enumerate(split):
            if i in suspect or not ps:
                continue
            if grades[i]:
                units[max(ps, key=(lambda p: model.linear(feats(p))) if model else suspicion), grades[i]] += 1.0
            else:
                for p in ps:
                    # passages without any telling feature are one and the same to the model
                    units["" if telling.keys().isdisjoint(feats(p)) else p, 0] += 1.0
        keys = list(units)
        rows = [np.array([index[f] for f in feats(p) if f in index], dtype=np.int64) for p, _ in keys]
        y = np.array([g for _, g in keys])
        weight = np.array([units[k] for k in keys])
        weight[y > 0] *= BOOST
        start = fit_ordinal(rows, y, weight, len(index), start)
        w, theta = start
        model = OrdinalModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, theta)
        vocabulary = model.vocabulary()
        if step < rounds:
            suspect = set()
            for i, ps in enumerate(split):
                if ps:
                    worst = max(ps, key=lambda q: model.linear(feats(q)))
                    p = model.above(model.linear(feats(worst)))[0]
                    # one telling word may have another sense; a telling triple is a phrase
                    if (grades[i] and p < 0.4) or (not grades[i] and p > 0.85 and any(f.count(" ") > 1 for f in feats(worst) if f in telling)):
                        suspect.add(i)
    return model


def suspicion_of(ps: list[str], suspicion) -> float:
    return max(map(suspicion, ps), default=0.0)


def rated_documents(documents: DataFrame, labels: DataFrame, limit: int = MAX_RATED) -> list[tuple[str, int]]:
    """(text, grade) of at most ``limit`` rated documents."""
    of = F.create_map(*[x for k, v in GRADES.items() for x in (F.lit(k), F.lit(v))])
    grade = F.when(F.col("abusive") == 1, F.coalesce(of[F.col("category")], F.lit(1))).otherwise(0)
    voted = labels.where("abusive is not null").groupBy("doc_id").agg(F.ceil(F.avg(grade)).cast("int").alias("grade"))
    chosen = voted.orderBy(F.xxhash64("doc_id")).limit(limit)
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").where("text is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "grade").collect()
    return [(r["text"], r["grade"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def _scorer(model: OrdinalModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = model.vocabulary()
        known: dict[str, float] = {}
        for batch in batches:
            best = []
            for text in batch.column("text").to_pylist():
                top = None
                for p in passages(text or ""):
                    x = known.get(p)
                    if x is None:
                        if len(known) > KEPT:
                            known.clear()
                        x = known[p] = model.linear(features_of(words_of(p, vocabulary)))
                    if top is None or x > top:
                        top = x
                best.append(top)
            probabilities = [model.above(x) if x is not None and model.weights else [0.0] * len(model.theta) for x in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array([float(sum(p)) for p in probabilities]), pa.array([p[0] for p in probabilities])], names=["doc_id", "source", "severity", "p_abusive"]
            )

    return run


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, severity (expected grade, 0..4) and p_abusive of every document."""
    model = train(rated_documents(documents, labels))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(_scorer(model), f"doc_id {kind}, source string, severity double, p_abusive double")


def rates(scored: DataFrame) -> DataFrame:
    """source, n_documents, n_abusive, rate, mean_severity; a null source is a group of its own."""
    flag = F.col("p_abusive") >= THRESHOLD
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(flag).alias("n_abusive"), F.round(F.count_if(flag) / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("severity"), 6).alias("mean_severity"))
