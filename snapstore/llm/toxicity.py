"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

*Terms* are all words of the examples (lower case, marks at the ends cut); a run of more than 24 characters without
white space also gives all its pieces of 4 to 9 characters, so nothing in it is passed over.  A term is its 64-bit hash.

*Weights*: (1 + log tf) x idf x |log odds ratio of the label|, the last two with half a row added to each count ("delta
TF-IDF").  No term is selected or left out: a word that tells nothing about the label weighs next to nothing.  An
example is the unit vector of its whole text.

*Index*: the postings of a term are cut into blocks of examples, and each block knows its largest weight.  The
largest weights bound the cosine of any example of a block.  The blocks of the best bounds are scored first; then all
blocks whose bound reaches the k-th best cosine: the result is the exact k nearest.

*Score*: votes of the neighbours weighted by cosine, with the prior's vote beside them, made a probability by
isotonic regression on leave-one-out votes of the examples.  The neighbours are the evidence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import batches, lean, materialise, ship, with_decisions

#: A longer run without white space gives its pieces too, and is not kept in memos.
RUN_CHARS, PIECE_CHARS = 24, range(4, 10)


def word_of(token: str) -> str:
    """The word of a white-space token: lower case, marks at its ends cut."""
    word = token.lower()
    if not word.isalnum():
        a, b = 0, len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while b > a and not word[b - 1].isalnum():
            b -= 1
        word = word[a:b]
    return word


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))


def pieces_of(word: str) -> list[str]:
    """All pieces of a long run; none of others."""
    return [word[k : k + n] for n in PIECE_CHARS for k in range(len(word) - n + 1)] if len(word) > RUN_CHARS else []


_MARKS = frozenset(".,;:!?")


class TermCounter:
    """Distinct terms of whole texts, sorted, and how often they occur.  A bounded memo of white-space tokens spares most
    of the hashing; with ``known`` words (lower case) given, a plain word outside them is passed over at once."""

    def __init__(self, limit: int = 120_000, known: frozenset[str] | None = None):
        self.limit, self.known = limit, known
        self.memo: dict[str, int] = {w: _hash(w) for w in known or ()}
        self.limit += len(self.memo)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        memo, known, tokens, more = self.memo, self.known, (text or "").split(), []
        found = list(map(memo.get, tokens))
        if None in found:
            for j, h in enumerate(found):
                if h is None:
                    token = tokens[j]
                    if known is not None and len(token) <= RUN_CHARS:
                        core = token[:-1] if token[-1] in _MARKS else token
                        if core.isalpha() and (core if core.islower() else core.lower()) not in known:
                            found[j] = 0
                            continue
                    word = word_of(token)
                    found[j] = h = _hash(word) if word else 0
                    if len(word) > RUN_CHARS:
                        more += map(_hash, pieces_of(word))
                    elif len(memo) < self.limit and len(token) <= 2 * RUN_CHARS:
                        memo[token] = h
        terms, n = np.unique(np.array(found + more, dtype="u8"), return_counts=True)
        return (terms[1:], n[1:]) if len(terms) and not terms[0] else (terms, n)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of several runs, one after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class BlockMaxIndex:
    """Unit vectors of labelled examples by term, with the largest weight of each term in each block.

    Postings of terms that a sixteenth of the examples have are kept as rows of a matrix, all others as lists.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64):
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        term = np.concatenate([np.zeros(0, "i8"), *(t for t, _ in vectors)]).astype("i8")
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]).astype("i8")
        order = np.argsort(term, kind="stable")
        term, self.example, self.weight = term[order], example[order], weight[order]
        home = term * max(self.blocks, 1) + self.example // block
        self.start = np.flatnonzero(np.diff(home, prepend=-1))
        self.size = np.diff(self.start, append=len(home))
        self.home = home[self.start] % max(self.blocks, 1)
        self.most = np.maximum.reduceat(self.weight, self.start) if len(home) else np.zeros(0)
        self.of_term = np.searchsorted(term[self.start], np.arange(terms + 1))
        common = np.flatnonzero(16 * np.bincount(term, minlength=terms) > self.n)
        self.row = np.full(terms, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n))
        own = self.row[term] >= 0
        self.rows[self.row[term[own]], self.example[own]] = self.weight[own]
        self.size[self.row[term[self.start]] >= 0] = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of largest cosine over 0, largest first, ties by place; ``without`` is left out."""
        size = self.of_term[terms + 1] - self.of_term[terms]
        parts, own = _runs(self.of_term[terms], size), np.repeat(weights, size)
        home = self.home[parts]
        bound = np.bincount(home, own * self.most[parts], self.blocks)
        row = self.row[terms]
        common = row >= 0
        scores = weights[common] @ self.rows[row[common]]
        listed = np.flatnonzero(self.size[parts])
        parts, own, home = parts[listed], own[listed], home[listed]
        chosen = np.zeros(self.blocks, bool)
        chosen[np.argsort(-bound, kind="stable")[: -(-k // self.block) + 1]] = True
        self._score(scores, parts, own, chosen[home])
        done = np.repeat(chosen, self.block)[: self.n]
        if without >= 0:
            done[without] = False
        some = scores[done]
        least = np.partition(some, -k)[-k] if len(some) > k else 0.0
        rest = (bound + 1e-9 >= least) & ~chosen
        if rest.any():
            self._score(scores, parts, own, rest[home])
            done |= np.repeat(rest, self.block)[: self.n]
            if without >= 0:
                done[without] = False
        best = np.flatnonzero(done)
        cosine = np.round(scores[best], 12)
        if len(best) > k:
            high = cosine >= np.partition(cosine, -k)[-k]
            best, cosine = best[high], cosine[high]
        order = np.lexsort((best, -cosine))[:k]
        return [(s, e) for s, e in zip(cosine[order].tolist(), best[order].tolist(), strict=True) if s > 0]

    def _score(self, scores: np.ndarray, parts: np.ndarray, own: np.ndarray, chosen: np.ndarray) -> None:
        parts, own = parts[chosen], own[chosen]
        size = self.size[parts]
        at = _runs(self.start[parts], size)
        scores += np.bincount(self.example[at], self.weight[at] * np.repeat(own, size), self.n)


def isotonic(x: np.ndarray, y: np.ndarray, prior: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators with one prior vote a pool: increasing knots (votes, probability)."""
    weight = np.ones(len(x)) if weight is None else weight
    values, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for value, positive, n in zip(values, np.bincount(at, y * weight), np.bincount(at, weight), strict=True):
        pools.append([value, value, float(positive), float(n)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots_x, knots_y = [], []
    for low, high, positive, n in pools:
        p = (positive + prior) / (n + 1)
        knots_x += [low, high] if high > low else [low]
        knots_y += [p, p] if high > low else [p]
    return np.array(knots_x), np.maximum.accumulate(np.array(knots_y))


class ToxicityModel:
    """The index, the labels of its examples, and the calibration.

    ``examples``: (id, label, terms, how often they occur), terms as ``TermCounter`` gives them.  ``words``: all words
    of the examples, where they are at hand (others are then passed over without hashing).  ``weights``: how many
    rows one example without and with the label stands for, relative to the mean.
    """

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], prior: float, k: int = 25, block: int = 64, weights: tuple[float, float] = (1.0, 1.0), words: frozenset[str] | None = None):
        # texts of one language lie together, which keeps the blocks' bounds low
        examples = sorted(examples, key=lambda x: (int(x[2][np.argmax(x[3])]) if len(x[2]) else -1, x[0]))
        self.ids, self.labels = [x[0] for x in examples], np.array([x[1] for x in examples], dtype="i8")
        self.place = {d: e for e, d in enumerate(self.ids)}
        self.prior, self.k, self.weights = prior, k, weights
        every = np.concatenate([np.zeros(0, "u8"), *(x[2] for x in examples)])
        marked = np.repeat(self.labels, [len(x[2]) for x in examples])
        self.terms, at = np.unique(every, return_inverse=True)
        n, positive = len(examples), int(self.labels.sum())
        have = np.bincount(at, minlength=len(self.terms))
        have_with = np.bincount(at, marked, len(self.terms))
        have_without = have - have_with
        odds = (have_with + 0.5) / (positive - have_with + 0.5) / ((have_without + 0.5) / (n - positive - have_without + 0.5))
        self.value = (np.log((n + 1) / (have + 1)) + 1) * np.abs(np.log(odds))
        self.index = BlockMaxIndex([self.vector(t, c) for _, _, t, c in examples], len(self.terms), block)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.words, self.counter = words, None

    def vector(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms and their weights in the unit vector."""
        if not len(self.terms) or not len(terms):
            return np.zeros(0, "i8"), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        at, n = at[known], n[known]
        w = (1 + np.log(n)) * self.value[at]
        norm = math.sqrt(float((w * w).sum()))
        return (at, w / norm) if norm else (at[:0], w[:0])

    def nearest(self, text: str | None, without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, place) of the nearest examples; the example of id ``without`` is left out."""
        if self.counter is None:
            self.counter = TermCounter(known=self.words)
        terms, weights = self.vector(*self.counter.of(text))
        return self.index.nearest(terms, weights, self.k, self.place.get(without, -1)) if len(terms) else []

    def vote(self, nearest: list[tuple[float, int]], prior_votes: float = 0.5) -> float:
        votes = [(s * self.weights[self.labels[e]], self.labels[e]) for s, e in nearest]
        return float((sum(s for s, y in votes if y) + prior_votes * self.prior) / (sum(s for s, _ in votes) + prior_votes))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        if len(votes):
            self.knots = isotonic(votes, labels.astype(float), self.prior, np.array(self.weights)[labels])
        else:
            self.knots = np.array([0.0]), np.array([self.prior])

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """Probability of the label, and (cosine, id) of the neighbours."""
        nearest = self.nearest(text)
        p = float(np.interp(self.vote(nearest), *self.knots))
        return min(1.0, max(0.0, p)), [(s, self.ids[e]) for s, e in nearest]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = 2000, k: int = 25) -> ToxicityModel:
    """Learn from at most ``sample_rows`` labelled documents, those of each class whose ids have the smallest hashes.

    If not all rows fit, rows with the label come first: all of them up to a quarter of the sample, or up to their own
    share where that is larger.  Votes, prior and calibration weigh each class back to its share of all rows.

    Rows with a null id or label are left out; of several labels for one id the largest counts; of rows that
    repeat an id the smallest text is taken, and equal texts with one label are one example.  Without any labelled row the
    model knows the prior 0.5 only.  The sample's term counts are what reaches the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label_col].cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    total, total_with = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    take_with = total_with if total <= sample_rows else min(total_with, max(sample_rows // 4, round(sample_rows * total_with / total)))
    take_without = min(total - total_with, sample_rows - take_with)
    of_class = lambda c, m: slim.where(c).orderBy(F.xxhash64("id"), "id").limit(m)
    chosen = of_class("label > 0", take_with).unionAll(of_class("label <= 0", take_without))
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    # sample_rows bounds the broadcast
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = materialise(sample.groupBy("text", (F.col("label") > 0).cast("int").alias("label")).agg(F.min("id").alias("id")).select("id", "label", "text").repartition(16, "id"), "toxicity")

    def vectors(source):
        counter, seen = TermCounter(), set()
        for batch in batches(source, "text"):
            texts = batch.column("text").to_pylist()
            found = [counter.of(t) for t in texts]
            own = pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([c.astype("i4").tobytes() for _, c in found], pa.binary())
            new = sorted({w for t in texts for w in map(word_of, t.split()) if 0 < len(w) <= RUN_CHARS} - seen)
            seen.update(new)
            words = pa.array([" ".join(new), *[None] * (len(texts) - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *own, words], ["id", "label", "terms", "n", "words"])

    rows = sample.mapInArrow(lean(vectors), "id long, label int, terms binary, n binary, words string").collect()
    words = frozenset(w for r in rows if r["words"] for w in r["words"].split())
    examples = [(r["id"], r["label"], np.frombuffer(bytes(r["terms"]), "u8"), np.frombuffer(bytes(r["n"]), "i4")) for r in rows]
    n, positive = len(examples), sum(x[1] for x in examples)
    each = (total - total_with) / max(take_without, 1), total_with / max(take_with, 1)  # rows that one of the sample stands for
    mean = (each[0] * (n - positive) + each[1] * positive) / max(n, 1) or 1.0
    weights = each[0] / mean, each[1] / mean
    model = ToxicityModel(examples, (weights[1] * positive + 0.5) / (n + 1), k, weights=weights, words=words)
    shared = spark.sparkContext.broadcast(model)  # sample_rows bounds it

    def left_out(source):
        for batch in batches(source, "text"):
            votes = [shared.value.vote(shared.value.nearest(t, without=i)) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(votes, pa.float64())], ["label", "vote"])

    held = sample.mapInArrow(lean(left_out), "label int, vote double").collect()
    model.calibrate(np.array([r["vote"] for r in held]), np.array([r["label"] for r in held], dtype="i8"))
    shared.unpersist()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """Columns ``row`` (the document's own), ``score``, ``predicted`` (1 from ``threshold`` on) and ``evidence``
    (cosine and id of all examples that voted).  One pass without a shuffle.  Null and empty texts have no terms and
    get the score of texts without evidence; repeated rows get the same score; nothing but the text is an input.
    The broadcast model is bounded by ``sample_rows`` texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = shared.value

        def decide(_, texts):
            found = [scorer.score(t) for t in texts]
            return [p for p, _ in found], [int(p >= threshold) for p, _ in found], [[{"similarity": s, "doc_id": d} for s, d in e] for _, e in found]

        return decide

    return with_decisions(docs, "doc_id", "text", make, "score double, predicted int, evidence array<struct<similarity double, doc_id long>>")


def may_learn(doc_id) -> F.Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(doc_id.cast("string")) % 3 != 1
