"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon (whole words, and stems that any ending may follow) is learned from
labelled texts and laid out as a trie.  Walking a token runs the intersection of
the trie with the Levenshtein automaton of the token: a state is the set of
(trie node, edits so far), built lazily and shared by all tokens, so a token
that leaves the lexicon's neighbourhood costs a few look-ups.  Each hit is then
read in its context window: hits inside quotation marks, or reported by a verb
of saying, count apart from those that address someone.  A logistic model over
the counts gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, free_name, long_ids, map_texts, small_batches, stored

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 16_000
#: Independent toxic texts that an entry must occur in.
SUPPORT = 4
#: Times that an entry's share of the toxic texts exceeds its share of the clean ones.
RATIO = 8.0
#: Nats by which the two shares must be likelier than one, against the many entries that are tried.
GAIN = 10.0
THRESHOLD = 0.3
#: States of the automaton that a task holds at about; beyond that it begins anew.
STATES = 20_000
EDGE = string.punctuation + "«»„“”‘’‹›…–—¿¡|"
STEM_LENGTHS = range(4, 8)
#: Tokens either side of a hit that are its context.
CONTEXT = 6

# Quotation marks, verbs of saying and words of address.
OPENING, CLOSING = "\"«„“‹", "\"»“”›"
SAYING = frozenset("said says called quoted quote wrote writes calling term word slur reported sagte nannte schrieb zitat wort dit appelé écrit citation mot dijo llamó escribió cita palabra".split())
ADDRESS = frozenset("you your you're u ye du dich dir dein ihr euch tu te toi vous ton votre tú ti usted vos ustedes".split())

FEATURES = ("exact", "stem", "fuzzy", "quoted", "reported", "addressed", "any", "repeated")


def edits_for(length: int, stem: bool) -> int:
    """Edits allowed against an entry of this length."""
    if stem:
        return 1 if length >= 6 else 0
    return 0 if length < 5 else 1 if length < 10 else 2


class Trie:
    """A lexicon trie with its lazily built product with the Levenshtein automaton."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_edits: dict[int, int] = {}
        self.stem_edits: dict[int, int] = {}
        for entries, ends, stem in ((words, self.word_edits, False), (stems, self.stem_edits, True)):
            for entry in entries:
                node = 0
                for c in entry:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                ends[node] = edits_for(len(entry), stem)
        self.alphabet = frozenset(c for kids in self.children for c in kids)
        self.most = max([0, *self.word_edits.values(), *self.stem_edits.values()])
        self.reach = [0] * len(self.children)  # most edits that any entry below a node allows
        for node in reversed(range(len(self.children))):
            self.reach[node] = max([self.word_edits.get(node, 0), self.stem_edits.get(node, 0), *(self.reach[k] for k in self.children[node].values())])
        self._begin()

    def _begin(self) -> None:
        """Forget all states; they are built again as tokens need them."""
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int | None, int | None]] = []
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The state of these nodes, closed under leaving out characters of entries; -1 if none is left."""
        todo = list(edits.items())
        while todo:
            node, e = todo.pop()
            for kid in self.children[node].values():
                if e + 1 <= self.reach[kid] and edits.get(kid, 99) > e + 1:
                    edits[kid] = e + 1
                    todo.append((kid, e + 1))
        key = tuple(sorted(edits.items()))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            word = min((e for n, e in key if e <= self.word_edits.get(n, -1)), default=None)
            stem = min((e for n, e in key if e <= self.stem_edits.get(n, -1)), default=None)
            self.ends.append((word, stem))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.reach[node] and after.get(node, 99) > e:
                after[node] = e

        for node, e in self.sets[state]:
            for k, kid in self.children[node].items():
                put(kid, e if k == c else e + 1)
            put(node, e + 1)
        return self._state(after)

    def match(self, token: str) -> tuple[int | None, int | None]:
        """Edits to the nearest word, and to the nearest stem that the token begins with, where allowed."""
        if len(self.sets) > STATES:
            self._begin()
        state, stem = self.start, None
        for c in token:
            if c not in self.alphabet:
                c = "\0"
            moves = self.moves[state]
            if c not in moves:
                moves[c] = self._move(state, c)
            state = moves[c]
            if state < 0:
                return None, stem
            found = self.ends[state][1]
            if found is not None and (stem is None or found < stem):
                stem = found
        return self.ends[state][0], stem


@dataclass
class Model:
    """A fitted lexicon, the words that are known to be harmless, and the weights."""

    words: list[str]
    stems: list[str]
    harmless: frozenset[str]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def __post_init__(self) -> None:
        self.trie = Trie(self.words, self.stems)
        self.known: dict[str, int] = {}

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.harmless, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems, self.harmless, self.weights = state
        self.__post_init__()

    def kind(self, token: str) -> int:
        """0 no hit, 1 exact word, 2 exact stem, 3 misspelled; ``token`` is lower-cased."""
        found = self.known.get(token)
        if found is None:
            bare = token.strip(EDGE)
            word, stem = self.trie.match(bare) if bare else (None, None)
            found = 1 if word == 0 else 2 if stem == 0 else 3 if (word is not None or stem is not None) and bare not in self.harmless else 0
            if len(self.known) > 150_000:
                self.known.clear()
            self.known[token] = found
        return found

    def features(self, text: str) -> list[float]:
        """Counts of the hits of a whole text, by kind and context."""
        tokens = text.lower().split()
        known, kind = self.known, self.kind
        hits = []
        for i, t in enumerate(tokens):
            k = known.get(t)
            if k is None:
                k = kind(t)
            if k:
                hits.append((i, k))
        count = Counter()
        for i, k in hits:
            before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
            opened = tokens[i][0] in OPENING or any(t[0] in OPENING and t[-1:] not in CLOSING for t in before)
            closed = tokens[i].rstrip(".,;:!?")[-1:] in CLOSING or any(t.rstrip(".,;:!?")[-1:] in CLOSING for t in after)
            said = any(t.strip(EDGE) in SAYING for t in before)
            spoken = any(t.strip(EDGE) in ADDRESS for t in before + after)
            if opened and closed:
                count["quoted"] += 1
            elif said and not spoken:
                count["reported"] += 1
            else:
                count[FEATURES[k - 1]] += 1
                count["addressed"] += spoken
        counts = [math.log1p(count[f]) for f in FEATURES[:-2]]
        return [*counts, float(count["exact"] > 0), float(count["exact"] + count["stem"] > 1)]

    def score(self, texts: list[str]) -> np.ndarray:
        """Probabilities of the toxic label."""
        if not texts:
            return np.empty(0)
        x = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-(x @ self.weights[1:] + self.weights[0])))


#: Bias and weights before any label is seen: direct hits count, quotation hardly does.
PRIOR = np.array([-3.0, 2.0, 2.0, 0.5, 0.2, 0.4, 0.5, 1.0, 1.0])


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards the prior where labels say little."""
    x = np.c_[np.ones(len(x)), x]
    w = PRIOR.copy()
    pull = np.full(len(w), strength)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, sketch, toxic) for the words and stems of each labelled text; sketch tells independent texts apart."""
    for batch in batches:
        entries, groups, toxic = [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {t for t in (raw.strip(EDGE) for raw in (text or "").lower().split()) if t.isalpha()}
            if not words:
                continue
            sketch = min(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words)
            found = words | {f"{w[:n]}*" for w in words for n in STEM_LENGTHS if len(w) > n}
            entries += found
            groups += [int.from_bytes(sketch, "big", signed=True)] * len(found)
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entries, pa.string()), "sketch": pa.array(groups, pa.int64()), "toxic": pa.array(toxic, pa.int32())})


def gain(p: int, n: int, toxic: int, clean: int) -> float:
    """Nats by which two shares, p of the toxic and n of the clean texts, are likelier than one."""
    every = toxic + clean
    cells = ((p, toxic), (n, clean), (toxic - p, toxic), (clean - n, clean))
    share = (p + n) / every, 1 - (p + n) / every
    return sum(x * math.log(x / (side * share[k > 1])) for k, (x, side) in enumerate(cells) if x > 0)


def telling(counted: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The rows (entry, p, n) that ``choose`` can take, with their gain.

    An entry needs ``SUPPORT`` toxic texts and a share of them that is ``RATIO``
    times its share of the clean ones, by a gain beyond chance.
    """
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    cells = ((p, toxic, False), (n, clean, False), (toxic - p, toxic, True), (clean - n, clean, True))
    both = (p + n) / max(1, toxic + clean)
    nats = sum((F.when(x > 0, x * F.log(x / (side * ((1 - both) if out else both)))).otherwise(0.0) for x, side, out in cells if side), F.lit(0.0))
    enough = (p >= SUPPORT) & (p / max(1, toxic) > RATIO * (n + 0.5) / max(1, clean))
    return counted.where(enough).withColumn("gain", nats).where(F.col("gain") > GAIN)


def choose(rows: list[tuple[str, int, float]]) -> tuple[list[str], list[str]]:
    """Words and stems out of telling entries (entry, toxic texts, gain), in which like texts count once; those that tell most come first.

    Of a stem and a longer one that begins with it only the one that tells more
    is taken, and a stem counts only where it gathers clearly more texts than any
    word of it.
    """
    rows = sorted(rows, key=lambda r: (-r[2], len(r[0]), r[0]))
    words = {e: p for e, p, _ in rows if not e.endswith("*")}
    starts = lambda w: {w[:k] for k in STEM_LENGTHS if k <= len(w)}
    best: dict[str, int] = {}
    for w, p in words.items():
        for s in starts(w):
            best[s] = max(best.get(s, 0), p)
    stems: list[str] = []
    taken: set[str] = set()
    within: set[str] = set()
    for entry, p, _ in rows:
        if not entry.endswith("*"):
            continue
        stem = entry[:-1]
        most = best.get(stem, 0)
        if p >= 1.5 * most and p >= most + SUPPORT // 2 and stem not in within and not starts(stem) & taken:
            stems.append(stem)
            taken.add(stem)
            within |= starts(stem)
    return [w for w in words if not starts(w) & taken], stems


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, toxic, and a hash of the text as text_hash where it is at hand); rows with a null label are left out.

    At most ``sample`` distinct pairs of text and label are used, those of least
    hash.  The model takes every entry that tells toxic texts from clean ones by
    its gain; each needs ``SUPPORT`` of the sample's toxic texts.  Without
    toxic rows the lexicon is empty and every score is the prior's.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.col("text_hash") if "text_hash" in labelled.columns else F.xxhash64(text)
    rows = labelled.where(F.col("toxic").isNotNull()).select(text.alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"), hashed.alias("text_hash"))
    taken = stored(bounded_sample(rows, ["text_hash", "toxic"], sample), "toxicity-sample")
    totals = {r["toxic"]: r["n"] for r in taken.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = taken.repartition(64).mapInArrow(_entries, "entry string, sketch long, toxic int").groupBy("entry").agg(
        F.countDistinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("p"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("sketch"))).alias("n")
    )
    counted = stored(counted, "toxicity-entries")
    found = telling(counted, totals.get(1, 0), totals.get(0, 0)).collect()
    words, stems = choose([(r["entry"], r["p"], r["gain"]) for r in found])
    draft = Model(words, stems, frozenset())
    usual = counted.where(~F.col("entry").endswith("*")).where("n >= 2").select("entry")
    near = usual.mapInPandas(_near(draft), "entry string").collect()  # words of the bounded sample that lie within the edits of an entry
    model = Model(draft.words, draft.stems, frozenset(r[0] for r in near))
    counts = map_texts(taken, lambda texts: [[model.features(t) for t in texts]], "x array<double>", keep=("toxic",)).collect()
    if counts:
        model.weights = fit_weights(np.array([r["x"] for r in counts]), np.array([r["toxic"] for r in counts], float))
    return model


def _near(model: Model):
    """Of usual words, those that the automaton would take for a misspelling."""

    def run(batches):
        for pdf in batches:
            yield pdf[[model.kind(w) == 3 for w in pdf["entry"]]]

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs`` (doc_id, text, and any others).

    Null and empty texts have no hits and get the score of none.  Repeated rows
    each get a row.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_texts(long_ids(docs), lambda texts: [broadcast.value.score(texts)], "score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns as they are, then the score and whether it reaches the threshold (0 or 1).

    The two are named ``score`` and ``predicted``, with underscores after them
    where ``docs`` has columns of these names.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    name, verdict = free_name(docs.columns, "score"), free_name(docs.columns, "predicted")
    scored = map_texts(docs, lambda texts: [broadcast.value.score(texts)], f"{name} double", keep=docs.columns)
    return scored.withColumn(verdict, (F.col(name) >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, as they are, whose score is below the threshold."""
    scored = with_scores(docs, model, threshold)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*[f"`{c}`" for c in docs.columns])
