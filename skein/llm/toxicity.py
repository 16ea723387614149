"""Toxicity by a weighted finite-state grammar over clauses.

A word is first given a class by a lexicon: insult, threat, target, negation or report (verbs of reported speech).
Quotation marks and the ends of clauses and lines are classes of their own. Five small transducers read the classes
from left to right and rewrite what they know: negation and reported speech mark the insults and threats in their
scope, a target raises those of its clause. Every arc has a weight, the logarithm of a factor; the transducers are
composed into one machine, in which the weights of the arcs passed at once are added. A hit counts its word's weight
times the factor of its path. What clauses sum up to, by kind of hit, is what a logistic function scores.

The lexicon has the listed words, and words and beginnings of words learned from labelled rows: those that stand in
toxic documents so much oftener than in others that chance can't explain it are insults; other words of clauses with a
hit are learned as targets where such clauses are tied to toxic documents, and as reports where to others. Listed words
keep their class. So languages that aren't listed are covered.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

INSULT, THREAT, TARGET, NEGATION, REPORT = "insult", "threat", "target", "negation", "report"

LISTED = {
    INSULT: "idiot idiots moron morons loser losers stupid scum trash worthless pathetic disgusting clown fool dumb imbecile vermin filth coward garbage ugly".split(),
    THREAT: "kill murder destroy hurt beat stab shoot burn hang strangle punish crush".split(),
    TARGET: "you your yours u he she they them him her his their tu vous du ihr sie ustedes usted él ella ellos il elle ils".split(),
    NEGATION: "not no never neither nor nobody isn't aren't don't doesn't didn't wasn't won't cannot can't without nicht kein keine nie ne pas jamais nunca ni".split(),
    REPORT: "said says say told claimed claims wrote writes reported quoted quotes according called calls sagte schrieb laut dit écrit selon dijo escribió según".split(),
}

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n|]|[\"“”„«»]")
END, BREAK, QUOTE, OPEN, CLOSE = "end", "break", "quote", "open", "close"
#: A line's end closes what was left open; straight and curved double quotes open and close in turn, as languages differ.
_MARKS = {**dict.fromkeys(".!?;:|", END), "\n": BREAK, **dict.fromkeys("\"“”", QUOTE), "„": OPEN, "«": OPEN, "»": CLOSE}


#: Factors of a hit's weight.
NEGATED, REPORTED, AGAIN, AIMED = 0.1, 0.15, 0.4, 1.4


class Transducer:
    """Deterministic: (state, symbol) to (state, symbol, weight); a symbol without an arc passes unchanged, keeps the state and weighs 0."""

    def __init__(self, start, arcs: dict[tuple, tuple]):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads, and weights are added. States are pairs, made as they are reached."""
        return Composed(self, other)


class Composed(Transducer):
    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second = first, second
        super().__init__((first.start, second.start), {})

    def step(self, state, symbol: str):
        if (state, symbol) not in self.arcs:
            a, middle, x = self.first.step(state[0], symbol)
            b, out, y = self.second.step(state[1], middle)
            self.arcs[state, symbol] = ((a, b), out, x + y)
        return self.arcs[state, symbol]


def grammar() -> Transducer:
    """Negation, then reported speech, then insult, threat and target, composed into one machine."""
    log = math.log
    hits, ends = (INSULT, THREAT), (END, BREAK)
    # A negation holds for the next hit of its clause only; a second one before it takes it back.
    negation = {("+", NEGATION): ("-", NEGATION, 0.0), ("-", NEGATION): ("+", NEGATION, 0.0)}
    negation |= {("-", h): ("+", f"negated_{h}", log(NEGATED)) for h in hits} | {("-", e): ("+", e, 0.0) for e in ends}
    # From a verb of reporting to the end of its clause or of the quotation it opens; a quotation may have many clauses, but not many lines.
    report = {("own", REPORT): ("said", REPORT, 0.0), ("said", END): ("own", END, 0.0)}
    report |= {(s, q): ("quoted", q, 0.0) for s in ("own", "said") for q in (QUOTE, OPEN)} | {("quoted", q): ("own", q, 0.0) for q in (QUOTE, CLOSE)}
    report |= {(s, BREAK): ("own", BREAK, 0.0) for s in ("said", "quoted")}
    report |= {(s, x): (s, f"reported_{h}", log(REPORTED)) for s in ("said", "quoted") for h in hits for x in (h, f"negated_{h}")}
    # A second hit of a clause adds less than the first.
    again = lambda h: {("0", h): ("1", h, 0.0), ("1", h): ("1", f"more_{h}", log(AGAIN))} | {("1", e): ("0", e, 0.0) for e in ends}
    # A target anywhere before a hit aims it; after one, it raises the clause.
    target = {("none", TARGET): ("aimed", TARGET, 0.0), ("hit", TARGET): ("aimed", "aims", log(AIMED))}
    target |= {("aimed", h): ("aimed", f"aimed_{h}", log(AIMED)) for h in hits} | {("none", h): ("hit", h, 0.0) for h in hits}
    target |= {(s, e): ("none", e, 0.0) for s in ("aimed", "hit") for e in ends}
    return Transducer("+", negation).then(Transducer("own", report)).then(Transducer("0", again(INSULT))).then(Transducer("0", again(THREAT))).then(Transducer("none", target))


def words_alone() -> Transducer:
    """The machine without any arc, which leaves isolated words: for comparison."""
    return Transducer("", {})


KINDS = ("insult", "aimed_insult", "more_insult", "negated_insult", "reported_insult", "threat", "aimed_threat", "more_threat", "negated_threat", "reported_threat", "aims")


_KINDS = set(KINDS)


@dataclass
class Model:
    #: Whole words, and beginnings of words, to (class, weight).
    words: dict[str, tuple[str, float]] = field(default_factory=dict)
    starts: dict[str, tuple[str, float]] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: np.array([1.2] * 5 + [0.9] * 5 + [0.3, 0.0]))
    bias: float = -3.0

    def classify(self, word: str) -> tuple[str, float] | None:
        best = self.words.get(word)
        for n in LENGTHS:
            if len(word) >= n and (x := self.starts.get(word[:n])) and (best is None or x[1] > best[1]):
                best = x
        return best


LENGTHS = (4, 5, 6, 8)


def candidates(text: str) -> set[str]:
    out = set()
    for w in set(_TOKEN.findall(text.lower())):
        if w[0].isalpha():
            out.add("=" + w)
            out.update(w[:n] for n in LENGTHS if len(w) >= n)
    return out


def tie(k: int, of_k: int, j: int, of_j: int) -> float:
    """The log-likelihood ratio of k of of_k and j of of_j being unlike shares."""

    def ratio(k: int, m: int, p: float) -> float:
        return (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m > k else 0)

    p = (k + j) / (of_k + of_j)
    return 2 * (ratio(k, of_k, k / of_k) + ratio(j, of_j, j / of_j) - ratio(k, of_k, p) - ratio(j, of_j, p))


def learn_lexicon(sample: list[tuple[str, int]], purity: float = 0.9, most: int = 5000) -> tuple[dict, dict]:
    """Words and beginnings whose tie to label 1 has a log-likelihood ratio above twice the logarithm of their number plus 6."""
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for text, y in sample:
        n[y] += 1
        (toxic if y else clean).update(candidates(text))
    words = {w: (c, 1.0) for c, ws in LISTED.items() for w in ws}
    starts: dict[str, tuple[str, float]] = {}
    if not all(n):
        return words, starts
    need = 2 * math.log(len(toxic) + len(clean)) + 6

    found = []
    for w, k in toxic.items():
        j = clean[w]
        a, b = k / n[1], j / n[0]
        if a <= b or a / (a + b) < purity:
            continue
        g = tie(k, n[1], j, n[0])
        if g > need:
            found.append((g, w, math.log((a + 0.5 / n[1]) / (b + 0.5 / n[0]))))
    for _, w, weight in sorted(found, reverse=True)[:most]:
        if w[0] != "=":
            starts[w] = (INSULT, 1 + weight / 4)
        elif words.get(w[1:], (INSULT,))[0] in (INSULT, THREAT):
            words[w[1:]] = (words.get(w[1:], (INSULT,))[0], 1 + weight / 4)
    return words | learn_context(sample, Model(words, starts)), starts


def learn_context(sample: list[tuple[str, int]], model: Model) -> dict[str, tuple[str, float]]:
    """Words that aren't in the lexicon but go with hits: targets where such clauses are tied to toxic documents, reports where to others.

    A word must be tied to the label among clauses with a hit, and to hits among all clauses of documents of that label
    that have one, in shares of all words there; so it isn't merely a frequent word of longer clauses, or of a language
    that has more of either.
    """
    with_word, n = {(y, hit): Counter() for y in (0, 1) for hit in (0, 1)}, Counter()
    for text, y in sample:
        clauses = []
        for clause in re.split(r"[.!?;:\n|]", text.lower()):
            known = {w: model.classify(w) for w in set(_TOKEN.findall(clause)) if w not in _MARKS}
            clauses.append((int(any(x and x[0] in (INSULT, THREAT) for x in known.values())), [w for w, x in known.items() if x is None], len(known)))
        if any(hit for hit, _, _ in clauses):
            for hit, words, many in clauses:
                n[y, hit] += many
                with_word[y, hit].update(words)
    if min(n[k] for k in with_word) == 0:
        return {}
    words = with_word[0, 1].keys() | with_word[1, 1].keys()
    need, out = 2 * math.log(len(words) + 1) + 6, {}
    share = lambda w, k: with_word[k][w] / n[k]
    tied = lambda w, a, b: share(w, a) > share(w, b) and tie(with_word[a][w], n[a], with_word[b][w], n[b]) > need
    for w in words:
        for y, kind in ((1, TARGET), (0, REPORT)):
            if tied(w, (y, 1), (1 - y, 1)) and tied(w, (y, 1), (y, 0)):
                out[w] = (kind, 1.0)
    return out


class Scorer:
    """Keeps the composed machine and the classes of words met so far (at most `most`)."""

    def __init__(self, model: Model, most: int = 200_000, machine: Transducer | None = None):
        self.model, self.machine, self.most = model, machine or grammar(), most
        self.known: dict[str, tuple[str, float] | None] = {}

    def classes(self, word: str):
        if len(self.known) >= self.most:
            self.known.clear()
        self.known[word] = x = (_MARKS[word], 0.0) if word in _MARKS else self.model.classify(word)
        return x

    def features(self, text: str) -> np.ndarray:
        """The summed weights of each kind of hit, damped, and the share of clauses with an unmarked hit."""
        known, sums = self.known, defaultdict(float)
        found = [known[w] if w in known else self.classes(w) for w in _TOKEN.findall(text.lower())]
        clauses, hit_clauses, state, hit = 1, 0, self.machine.start, False
        for x in found:
            if x is None:
                continue
            state, out, path = self.machine.step(state, x[0])
            if out in _KINDS:
                sums[out] += (x[1] or 1.0) * math.exp(path)
                hit |= out in HITS
            elif out == END or out == BREAK:
                clauses += 1
                hit_clauses += hit
                hit = False
        hit_clauses += hit
        return np.array([math.log1p(sums[k]) for k in KINDS] + [hit_clauses / clauses])

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.model.coef + self.model.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


HITS = {"insult", "aimed_insult", "more_insult", "threat", "aimed_threat", "more_threat"}


def fit(sample: list[tuple[str, int]], prior: float | None = None, steps: int = 2000, rate: float = 0.05, machine: Transducer | None = None) -> Model:
    """The lexicon, then a logistic fit of the clause sums, shrunk to what is set without labels; scores are shifted to the prior."""
    words, starts = learn_lexicon(sample)
    model = Model(words, starts)
    if len({y for _, y in sample}) < 2:
        return model
    scorer = Scorer(model, machine=machine)
    x, y = np.stack([scorer.features(t) for t, _ in sample]), np.array([y for _, y in sample], dtype=float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w0, w, b = model.coef.copy(), model.coef.copy(), model.bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        e = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y)
        g = np.append(x.T @ e / len(y) + 1e-3 * (w - w0), e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    if prior is not None and 0 < prior < 1:
        b += math.log(prior / (1 - prior))
    model.coef, model.bias = w, float(b)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs plus score double and predicted int, for every row; a null text is scored as the empty one.

    Repeated rows stay repeated, an empty table gives an empty result, and columns of those two names are replaced.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = [scorer.score(t.as_py() or "") for t in b.column(b.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())])).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
