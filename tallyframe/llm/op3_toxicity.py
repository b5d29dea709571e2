"""Toxicity by weak supervision.

Many weak voters look at a text: words of an insult lexicon, patterns of style,
and beginnings of words that are far more frequent in the toxic than in the
clean rows of one half of a bounded labelled sample.  The labels of the other
half are one more noisy voter, which abstains on rows without a label.  A
generative model with one hidden class looks at those rows and at as many
unlabelled ones, and estimates by expectation-maximisation how often each voter
fires in either class (its accuracy, the given label's too, from a prior that
labels are mostly right) and which voters
fire together beyond that (a tree of the strongest conditional dependencies, so
that two voters that see the same word aren't counted twice).  It starts from the
voters' rates in the mining half, not from the labels of the rows it looks at.
Its posterior labels choose the terms of a sparse linear classifier and train it;
that scores whole texts.

Only samples (``max_train`` labelled and ``max_unlabelled`` other rows at most),
as votes and term numbers, and the terms that tell the classes apart beyond
chance (``least_z``) reach the driver.

Cases: a null or empty text has no terms and gets the score of none; a very long
one counts each different token once.  Rows of ``labels`` without a label teach
nothing; of several for a doc_id the larger counts.  If no toxic row can be
learned from, every score is 0.  Repeated rows keep a row each.  An empty table
gives no rows.  Other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import held_out, in_arrow, kept, slices
from tallyframe.llm.op2_language import ftrl

MAX_TRAIN, MAX_UNLABELLED = 6000, 6000
#: Signed root of the likelihood ratio by which a term must tell the classes apart; 4 is chance once in 30,000 terms.
LEAST_Z = 4.0
#: Log odds of toxic rows from which a term is a voter, which judges rows that have no label, and is in the classifier.
VOTER_ODDS, TERM_ODDS = 4.0, 1.0
#: How often a label calls a clean and a toxic text toxic, before any data.
LABEL_BELIEF = (0.001, 0.95)

#: Insults that the lexicon voters look for.
LEXICON = (
    "bastard bitch clown coward creep crap cretin damn degenerate dimwit disgusting dumb dumbass filth fool freak fuck "
    "garbage hate idiot imbecile jerk kill liar loser lunatic maggot moron nasty parasite pathetic pig rat retard scum "
    "shit sick slut stupid trash traitor ugly vermin whore worthless"
).split()
_LETTERS = re.compile(r"[^\W\d_]+")
_BLUNT = re.compile(r"\b(?:you|your|you're|u)\b(?:\W+\w+){0,3}\W+(?:" + "|".join(LEXICON) + r")\b")
_ORDERS = re.compile(r"\b(?:shut up|get lost|go away|drop dead|go to hell)\b")
STYLE = (
    lambda text, low: bool(_BLUNT.search(low)),
    lambda text, low: bool(_ORDERS.search(low)),
    lambda text, low: "!!" in text,
    lambda text, low: len(text) >= 20 and sum(map(str.isupper, text)) > 0.5 * len(text),
)


class Terms(dict):
    """For a token, the terms in it: its words and their beginnings of 3 to 7 letters."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        out: set[str] = set()
        for word in _LETTERS.findall(token.lower()):
            out.add(word)
            out.update(f"{word[:n]}*" for n in range(3, 8) if len(word) >= n)
        if len(self) > 200_000:
            self.clear()
        self[token] = terms = tuple(out)
        return terms


def terms_of(text: str | None, memo: Terms) -> Counter[str]:
    """How many different tokens of the text hold each term."""
    found: Counter[str] = Counter()
    for terms in map(memo.__getitem__, set((text or "").split())):
        found.update(terms)
    return found


def value(n: int) -> float:
    """A term's weight in a text that holds it in ``n`` different tokens."""
    return 1.0 + math.log(n)


@dataclass
class LabelModel:
    """Firing rates of voters in class 0 and 1 given their parent in the dependency tree, and of the given label."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray  # class x parent's vote x voter
    label_rates: np.ndarray  # class: how often a label says 1
    accuracy: np.ndarray = field(default_factory=lambda: np.empty(0))

    def posterior(self, votes: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """P(class 1) of each row; ``given`` is 1, 0, or -1 where there is no label.

        A voter that doesn't fire abstains: a text without one insult may have another.
        """
        above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        at = np.arange(votes.shape[1])
        logs = np.empty((len(votes), 2))
        for y in (0, 1):
            rate = self.rates[y, above, at]
            logs[:, y] = np.where(votes == 1, np.log(rate), 0.0).sum(axis=1) + np.log(self.prior if y else 1 - self.prior)
            if given is not None:
                logs[:, y] += np.select([given == 1, given == 0], [np.log(self.label_rates[y]), np.log(1 - self.label_rates[y])], 0.0)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)


def _tree(votes: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree of conditional mutual information; -1 for roots."""
    m = votes.shape[1]
    information = np.zeros((m, m))
    for w in (p1, 1 - p1):
        n = w.sum() + 4e-3
        v = votes.astype(np.float64)
        both = ((v * w[:, None]).T @ v + 1e-3) / n
        one = np.clip(((v * w[:, None]).sum(axis=0) + 2e-3) / n, 1e-9, 1 - 1e-9)
        for a in (0, 1):
            for b in (0, 1):
                joint = both if a and b else (one[:, None] - both if a else (one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both))
                joint = np.maximum(joint, 1e-12)
                alone = np.where(a, one, 1 - one)[:, None] * np.where(b, one, 1 - one)[None, :]
                information += (n / len(votes)) * joint * np.log(joint / alone)
    np.fill_diagonal(information, -np.inf)
    parent, best, source = np.full(m, -1), np.full(m, -np.inf), np.zeros(m, int)
    if m:
        done = np.zeros(m, bool)
        done[0] = True
        best, source = information[0].copy(), np.zeros(m, int)
        for _ in range(m - 1):
            i = int(np.argmax(np.where(done, -np.inf, best)))
            parent[i] = source[i] if best[i] > 1e-4 else -1
            done[i] = True
            closer = ~done & (information[i] > best)
            best[closer], source[closer] = information[i][closer], i
    return parent


def fit_label_model(votes: np.ndarray, start: np.ndarray, given: np.ndarray | None = None, prior: float = 0.5, turns: int = 25, label_belief: float = 1.0) -> LabelModel:
    """EM from the posteriors ``start``; ``votes`` is rows x voters of 0 and 1, ``given`` a voter that may abstain (-1).

    ``prior`` is the share of class 1, which abstaining voters can't tell.  The
    rates of ``given`` are estimated from a prior that is worth
    ``label_belief`` times the labelled rows, so data can overrule it.
    """
    p1, model = np.clip(start, 0.02, 0.98), None
    given = np.full(len(votes), -1) if given is None else given
    for turn in range(turns):
        if turn % 5 == 0:
            parent = _tree(votes, p1)
        above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
        rates, labels = np.empty((2, 2, votes.shape[1])), np.empty(2)
        for y, w in ((0, 1 - p1), (1, p1)):
            base = ((votes * w[:, None]).sum(axis=0) + 0.5 * votes.mean(axis=0) + 1e-3) / (w.sum() + 0.5 + 2e-3)
            for a in (0, 1):
                at = w[:, None] * (above == a)
                rates[y, a] = ((votes * at).sum(axis=0) + 2 * base) / (at.sum(axis=0) + 2)
            weight = label_belief * (given >= 0).sum() + 1
            labels[y] = (w[given == 1].sum() + weight * LABEL_BELIEF[y]) / (w[given >= 0].sum() + weight)
        model = LabelModel(float(np.clip(prior, 1e-3, 0.999)), parent, np.clip(rates, 1e-5, 1 - 1e-5), np.clip(labels, 1e-5, 1 - 1e-5))
        p1 = model.posterior(votes, given)
    fired = np.maximum(votes.sum(axis=0), 1)
    model.accuracy = (votes * p1[:, None]).sum(axis=0) / fired
    return model


@dataclass
class Classifier:
    places: dict[str, int]
    weights: np.ndarray
    bias: float


def telling_terms(rows: DataFrame, least_z: float, least_odds: float = TERM_ODDS) -> dict[str, tuple[float, float]]:
    """Terms that mark class 1 beyond chance, with their rates in class 0 and 1; ``rows`` has text and p, P(class 1).

    Each task adds up its own terms first; only those that pass are collected.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, n, toxic = Terms(), Counter(), Counter()
        for batch in slices(batches):
            for text, p in zip(batch.column("text").to_pylist(), batch.column("p").to_pylist(), strict=True):
                for term in terms_of(text, memo):
                    n[term] += 1
                    toxic[term] += p
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.float64()), pa.array([toxic[t] for t in n], pa.float64())], names=["term", "n", "c1"])

    total, n1 = rows.agg(F.count(F.lit(1)), F.sum("p")).first()
    n0 = total - n1
    counts = in_arrow(rows.select("text", "p"), step, "term string, n double, c1 double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("c1").alias("c1"))
    counts = counts.withColumn("c0", F.greatest(F.lit(0.0), F.col("n") - F.col("c1")))
    rate1, rate0 = (F.col("c1") + 0.5) / (n1 + 1), (F.col("c0") + 0.5) / (n0 + 1)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = F.col("n") / total
    ratio = part(F.col("c1"), share * n1) + part(F.col("c0"), share * n0) + part(n1 - F.col("c1"), (1 - share) * n1) + part(n0 - F.col("c0"), (1 - share) * n0)
    found = counts.filter((F.log(rate1) - F.log(rate0) > least_odds) & (2 * ratio >= least_z**2)).select("term", rate0.alias("rate0"), rate1.alias("rate1"))
    return {r["term"]: (r["rate0"], r["rate1"]) for r in found.collect()}


def sampled(docs: DataFrame, labels: DataFrame, max_train: int, max_unlabelled: int) -> DataFrame:
    """(row, doc_id, text, toxic, mining): labelled rows that may be learned from, and rows without a label (toxic -1)."""
    usable = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    others = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").distinct()
    others = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(-1).alias("toxic"))
    both = kept(chosen.unionByName(others), "toxic-chosen")  # bounded by the two parameters
    mining = (F.col("toxic") >= 0) & (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)) == 0)
    rows = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").repartition(16)
    return kept(rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text", "toxic", mining.alias("mining")), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_unlabelled: int = MAX_UNLABELLED, least_z: float = LEAST_Z) -> Classifier:
    """Fit to rows that aren't held out; ``labels`` has doc_id and toxic."""
    sample = sampled(docs, labels, max_train, max_unlabelled)
    n = {(r["mining"], r["toxic"]): r["count"] for r in sample.filter("toxic >= 0").groupBy("mining", "toxic").count().collect()}
    if not n.get((True, 1)):
        return Classifier({}, np.zeros(0), -40.0)
    mined = telling_terms(sample.filter("mining").select("text", F.col("toxic").cast("double").alias("p")), least_z, VOTER_ODDS)
    names = sorted(mined)
    prior = n[(True, 1)] / (n[(True, 1)] + n.get((True, 0), 0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Terms()
        for batch in slices(batches):
            votes = []
            for text in batch.column("text").to_pylist():
                found, text = terms_of(text, memo), text or ""
                low = text.lower()
                votes.append([*[w in found for w in LEXICON], *[p(text, low) for p in STYLE], *[t in found for t in names]])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "toxic", "mining")], pa.array(votes, pa.list_(pa.bool_()))], names=["row", "toxic", "mining", "votes"])

    got = in_arrow(sample.select("row", "text", "toxic", "mining"), look, "row long, toxic int, mining boolean, votes array<boolean>").toPandas().sort_values("row", ignore_index=True)
    votes = np.array(got["votes"].tolist(), dtype=np.int8).reshape(len(got), -1)
    given, rest = got["toxic"].to_numpy(), ~got["mining"].to_numpy()
    # Where to start: the mined voters' rates in the mining half; the others say nothing yet.
    rate = np.array([mined[t] for t in names]).reshape(-1, 2)
    own = votes[:, len(votes[0]) - len(names) :]
    z = np.log(prior / (1 - prior)) + (own @ (np.log(rate[:, 1]) - np.log(rate[:, 0]))) / np.sqrt(1 + own.sum(axis=1))
    some = votes[rest].any(axis=0)
    votes = np.unique(votes[:, some], axis=1)  # voters that always agree are one
    model = fit_label_model(votes[rest], 1 / (1 + np.exp(-z[rest])), given[rest], prior)
    posterior = model.posterior(votes, given)
    spark = docs.sparkSession
    told = (given >= 0) | votes.any(axis=1)  # a row on which every voter abstains teaches nothing
    judged = spark.createDataFrame(list(dict(zip(got["row"][told].tolist(), posterior[told].tolist(), strict=True)).items()), "row long, p double")
    judged = kept(sample.select("row", "text").join(F.broadcast(judged), "row"), "toxic-judged")  # a row of the sample each

    places = {t: i for i, t in enumerate(sorted({*telling_terms(judged, least_z), *LEXICON}))}

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Terms()
        for batch in slices(batches):
            out = {"row": batch.column("row").to_pylist(), "p": batch.column("p").to_pylist(), "terms": [], "values": []}
            for text in batch.column("text").to_pylist():
                found = terms_of(text, memo)
                mine = sorted(found.keys() & places.keys())
                out["terms"].append([places[t] for t in mine])
                out["values"].append([value(found[t]) for t in mine])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.int64()), ("p", pa.float64()), ("terms", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))

    got = in_arrow(judged, terms, "row long, p double, terms array<int>, values array<double>").toPandas().sort_values("row")
    rows = [(np.asarray(t, dtype=np.int64), np.asarray(x, dtype=np.float64), np.array([1 - p, p])) for t, x, p in zip(got["terms"], got["values"], got["p"], strict=True)]
    weights, bias = ftrl(rows, 2, len(places), alpha=0.1, beta=1.0, l1=1.0, l2=0.1, epochs=10)
    return Classifier(places, weights[:, 1] - weights[:, 0], float(bias[1] - bias[0]))


def predict(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score and predicted of every row; a pass over the texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = held.value, Terms()
        weight = {t: float(m.weights[i]) for t, i in m.places.items() if m.weights[i]}

        class Telling(dict):
            """For a token, the terms in it that have a weight; mostly none."""

            def __missing__(self, token: str) -> tuple[str, ...]:
                self[token] = terms = tuple(t for t in Terms.__missing__(memo, token) if t in weight)
                return terms

        telling = Telling()
        for batch in slices(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                found: Counter[str] = Counter()
                for terms in filter(None, map(telling.__getitem__, set((text or "").split()))):
                    found.update(terms)
                z = m.bias + sum(weight[t] * value(found[t]) for t in sorted(found))
                scores.append(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
            if len(telling) > 400_000:
                telling.clear()
            memo.clear()
            score = np.array(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_arrow(docs.select("doc_id", "text"), step, "doc_id long, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    return predict(docs, train(docs, labels, max_train)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
