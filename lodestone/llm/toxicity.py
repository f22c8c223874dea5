"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, reported speech, other); a transducer for each phenomenon
rewrites the class string of a clause, and their composition, built once as one table, reads it in one pass:

    negation: an insult or threat up to three words after a negation is a negated one
    reported speech: one after a reporting word in the clause is a reported one
    target: one up to three words from an address is an aimed one

What comes out are matched clauses by kind, each with the weight of its strongest word. The score is logistic in the
logarithms of the kinds' sums.

A short list of insults is fixed. What is learned, from at most ``SAMPLE`` labelled rows (least hash first): insults, as whole words and as
beginnings of four or five letters, whose share of toxic texts is beyond chance after correction for the number of
candidates; and the weights of the kinds, drawn to ``PRIOR`` where labels say nothing. The small closed classes
are fixed lists in English, German, French and Spanish.

Defined cases: null or empty text has no clause and the score of the bias alone. Labels of one doc_id that differ count
as toxic; rows of labels without doc_id or toxic are ignored. Without labels only the fixed insults count. Repeated or null
doc_ids keep their rows (held_out of null is null); other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import small_batches, stored, tidy

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: Learned insults, at most: those with the most evidence.
LEXICON = 4_000
CLASSES = ("other", "insult", "threat", "target", "negation", "report", "end")
KINDS = ("insult", "aimed insult", "threat", "aimed threat", "negated", "reported")
#: Weight of the bias and of each kind before labels.
PRIOR = (-3.0, 2.0, 3.0, 1.0, 3.0, 0.2, 0.5)
REACH = 3
SEED_WEIGHT = 1.5
#: Least share of toxic texts among those with a learned insult.
PURE = 0.8

# Closed word classes, and common insults that count before anything is learned.
INSULT = "idiot idiots moron morons imbecile stupid dumb loser losers pathetic scum worthless trash disgusting clown jerk bastard arschloch trottel dummkopf abschaum connard imbécile crétin salaud imbécil estúpido cabrón gilipollas"
TARGET = "you your yours yourself he she they him her them du dich dir ihr euch sie er tu toi te vous il elle ils elles ti usted ustedes él ella ellos"
NEGATION = "not no never none nobody neither without isn aren wasn don doesn nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás sin ningún"
REPORT = "said says say told tells wrote writes called calls quoted quotes claims claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó"
THREAT = "kill murder hurt destroy shoot stab beat töten umbringen schlagen erschießen tuer frapper détruire matar golpear destruir"

_WORD = re.compile(r"[^\W\d_]+|[.!?;\n]")


@dataclass
class Transducer:
    """A sequential transducer: (state, symbol) -> (state, symbol put out). A symbol without entry is put out as it is."""

    start: int
    step: dict[tuple[int, str], tuple[int, str]]
    default: dict[int, int] = field(default_factory=dict)  # the next state for other symbols

    def move(self, state: int, symbol: str) -> tuple[int, str]:
        return self.step.get((state, symbol), (self.default.get(state, state), symbol))


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that reads as ``first`` and puts out what ``second`` makes of it; reachable states only."""
    numbers, todo, step = {(first.start, second.start): 0}, [(first.start, second.start)], {}
    alphabet = list(alphabet)
    while todo:
        a, b = pair = todo.pop()
        for x in alphabet:
            na, y = first.move(a, x)
            nb, z = second.move(b, y)
            if (na, nb) not in numbers:
                numbers[(na, nb)] = len(numbers)
                todo.append((na, nb))
            step[(numbers[pair], x)] = (numbers[(na, nb)], z)
    return Transducer(0, step)


def negation() -> Transducer:
    """State n: words that the last negation still reaches."""
    step = {}
    for n in range(REACH + 1):
        step[(n, "negation")] = (REACH, "other")
        step[(n, "end")] = (0, "end")
        if n:
            step |= {(n, x): (n - 1, "negated") for x in ("insult", "threat")}
    return Transducer(0, step, {n: max(0, n - 1) for n in range(REACH + 1)})


def reporting() -> Transducer:
    """State 1: a reporting word stands before in the clause."""
    step = {(s, "report"): (1, "other") for s in (0, 1)} | {(1, x): (1, "reported") for x in ("insult", "threat")}
    return Transducer(0, step | {(1, "end"): (0, "end")})


def aiming() -> Transducer:
    """State n: words that the last address still reaches, after it."""
    step = {}
    for n in range(REACH + 1):
        step[(n, "target")] = (REACH, "target")
        step[(n, "end")] = (0, "end")
        if n:
            step |= {(n, x): (n - 1, f"aimed {x}") for x in ("insult", "threat")}
    return Transducer(0, step, {n: max(0, n - 1) for n in range(REACH + 1)})


def grammar() -> Transducer:
    """All phenomena in one."""
    return compose(compose(negation(), reporting(), CLASSES), aiming(), CLASSES)


@dataclass
class Model:
    """Learned insults with weights (whole words; beginnings end in ``*``) and the weights of bias and kinds."""

    lexicon: dict[str, float]
    weights: tuple[float, ...] = PRIOR

    def __post_init__(self) -> None:
        self.grammar = grammar()
        self.closed = {w: c for c, ws in (("threat", THREAT), ("target", TARGET), ("negation", NEGATION), ("report", REPORT)) for w in ws.split()}
        self.lexicon = dict.fromkeys(INSULT.split(), SEED_WEIGHT) | self.lexicon
        self.stems = {w[:-1] for w in self.lexicon if w.endswith("*")}

    def insult(self, word: str) -> float:
        """The word's weight as an insult, 0 if it is none."""
        w = self.lexicon.get(word, 0.0)
        if not w and len(word) > 5 and self.stems:
            w = self.lexicon.get(word[:5] + "*", 0.0) or self.lexicon.get(word[:4] + "*", 0.0)
        return w

    def kinds(self, text: str) -> np.ndarray:
        """Sum over clauses of the strongest match of each kind."""
        out = np.zeros(len(KINDS))
        words = _WORD.findall(text.lower())
        known = {w: s for w in set(words) if (s := self.insult(w)) > 0}
        if not known and not any(self.closed.get(w) == "threat" for w in set(words)):
            return out
        clause: list[str] = []
        for w in [*words, "."]:
            if len(w) == 1 and w in ".!?;\n":
                self._clause(clause, known, out)
                clause = []
            else:
                clause.append(w)
        return out

    def _clause(self, words: list[str], known: dict[str, float], out: np.ndarray) -> None:
        classes = ["insult" if w in known else self.closed.get(w, "other") for w in words]
        if "insult" not in classes and "threat" not in classes:
            return
        state, strongest = self.grammar.start, {}
        ahead = [any(c == "target" for c in classes[i + 1 : i + 1 + REACH]) for i in range(len(classes))]
        for w, c, before in zip(words, classes, ahead, strict=True):
            state, kind = self.grammar.move(state, c)
            if before and kind in ("insult", "threat"):  # an address that follows aims as well
                kind = f"aimed {kind}"
            if kind in KINDS:
                strongest[kind] = max(strongest.get(kind, 0.0), known.get(w, 1.0))
        for kind, weight in strongest.items():
            out[KINDS.index(kind)] += weight

    def score(self, text: str | None) -> float:
        """From 0 to 1."""
        x = self.weights[0] + float(np.dot(self.weights[1:], np.log1p(self.kinds(text)))) if text else self.weights[0]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and beginnings that stand in toxic texts beyond chance."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    # Copies of one text are one witness: of rows with one label and the same set of words one stays, of others all.
    sample = stored(sample.select("toxic", F.array_sort(words).alias("w")).distinct(), "witnesses")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return {}
    share = toxic / n
    stems = lambda k: F.transform(F.filter("w", lambda x: F.char_length(x) > 5), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))
    every = sample.select("toxic", F.explode(F.array_distinct(F.concat("w", stems(4), stems(5)))).alias("feature"))
    counts = stored(every.groupBy("feature").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).filter("a >= 3"), "features")
    tested = max(1, counts.count())
    p = F.col("a") / F.col("n")
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - share))).otherwise(0.0)
    evidence = F.col("n") * (p * F.log(p / F.lit(share)) + rest)
    odds = F.log((F.col("a") + 0.5) / (F.col("n") - F.col("a") + 0.5)) - F.lit(math.log(share / (1 - share)))
    good = counts.select("feature", odds.alias("odds"), evidence.alias("evidence"), p.alias("p")).filter((F.col("evidence") > math.log(tested) + 3) & (F.col("p") >= PURE))
    return {f: min(4.0, o) for f, o, *_ in good.orderBy(F.desc("evidence"), "feature").limit(LEXICON).collect()}


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, drawn to the prior; weights of unnegated kinds stay at or above 0."""
    prior, w = np.array(PRIOR), np.array(PRIOR)
    x = np.column_stack((np.ones(len(x)), np.log1p(x)))
    pull = np.array([0.01] + [0.05] * len(KINDS))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    w[1:5] = np.maximum(w[1:5], 0)
    return tuple(float(v) for v in w)


def held_out(doc_id=None):
    """crc32 of the doc_id as text leaves 0 modulo 5."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("long").cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit a model on labelled rows of ``docs`` that are not held out."""
    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(slim.join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").select("text", "toxic"), "labelled")
    lexicon = _lexicon(sample)
    first = Model(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [first.kinds(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(tidy(features), "toxic int, x array<double>").collect()  # SAMPLE rows at most
    if not rows or len({r.toxic > 0 for r in rows}) < 2:
        return first
    return Model(lexicon, _fit(np.array([r.x for r in rows]), np.array([float(r.toxic > 0) for r in rows])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return slim.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` less the rows with a score of 0.5 or more; all columns stay, nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
