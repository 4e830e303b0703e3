"""Toxicity scores from misspelled lexicon terms and their context (operator 4).

Learning. From the labelled rows (at most ``SAMPLE`` of each label, those with the smallest
hash of their id, each with the weight known / taken of its label) the words are counted per label; words that toxic texts use significantly
more often become the lexicon, with their log odds as weights.

Matching. The lexicon is a trie. A Levenshtein automaton for one or two edits, by length of
the term, runs over the trie and the word at once, so a word is compared with all terms in
one walk that ends as soon as no term can be reached. Two edits are allowed from nine letters,
one from five, none below, where most words are one edit from another; two neighbours that
changed places are one edit. The pairs (place in the trie, edits) that a prefix leads to are one state; states and their successors are kept, so the product
becomes a deterministic automaton as far as the words need it.

Context. A match within quotation marks counts apart from the others; an opening mark pairs with the next
closing one at any distance, and a mark without one quotes nothing. Also, the largest sum
of weights in any window of ``CONTEXT`` words tells a burst of abuse from a word in passing.
A logistic regression on these figures gives the score; language, source and id are no input.

Missing texts count as empty; texts without a match get the lowest score there is. Rows
with a missing id are scored but never learned from; labels that are missing are passed over, of several for one
id the highest counts. Without labels of both kinds every score is the share of toxic labels, 0 if
there are none. Every row gives one row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import kept, pieces
from tidewright.session import materialize

#: Labelled rows of each label that are learned from at most.
SAMPLE = 20_000
#: Terms of the lexicon at most, the most significant ones; bounds what is sent to the workers.
MAX_TERMS = 4_000
#: Likelihood ratio (G squared) and log odds a term must reach, and its length. Of n words that are tested a ratio of
#: 2 ln n is asked for, so that hardly any is taken by chance.
LEAST_G2, LEAST_ODDS, LEAST_LENGTH = 15.0, 1.5, 3
#: Words in a context window.
CONTEXT = 20
#: Words and automaton states that a worker remembers before it starts anew.
MEMORY, STATES = 100_000, 100_000
WORD = re.compile(r"\w+(?:[*@$!'’]+\w+)*")
MARK = re.compile("[\"“”„«»]")
#: The marks that end what each mark begins.
CLOSING = {'"': '"', "“": "”", "„": "“”", "«": "»"}
FEATURES = ("plain", "plain_best", "misspelt", "misspelt_best", "quoted", "burst", "density")


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """Deterministic product of a lexicon trie and Levenshtein automata, grown as words need it.

    With ``swaps`` two neighbours that changed places are one edit. Of such a pair a state holds, after its first
    letter, the place behind both as a negative number; only the letter that is still due leads there.
    """

    def __init__(self, weights: dict[str, float], swaps: bool = False):
        self.swaps = swaps
        self.children: list[dict[str, int]] = [{}]
        self.due = [""]  # the letter before the one that leads to a place
        self.limit = [0]
        self.weight: list[tuple[float, int] | None] = [None]
        for term, weight in weights.items():
            node, allowed, last = 0, edits_allowed(len(term)), ""
            self.limit[0] = max(self.limit[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.due.append(last)
                    self.limit.append(0)
                    self.weight.append(None)
                node, last = self.children[node][c], c
                self.limit[node] = max(self.limit[node], allowed)
            self.weight[node] = (weight, allowed)
        self.letters = {c for children in self.children for c in children}
        self.forget()

    def forget(self) -> None:
        start = self._closed({0: 0})
        self.states = [start]
        self.ids = {tuple(sorted(start.items())): 0}
        self.next: list[dict[str, int]] = [{}]
        self.accepts = [self._accept(start)]

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """Add the places reached by leaving out letters of terms; each place with its fewest edits."""
        queue = list(state.items())
        while queue:
            node, edits = queue.pop()
            if node < 0 or edits > state[node]:
                continue
            for child in self.children[node].values():
                if edits < self.limit[child] and edits + 1 < state.get(child, 99):
                    state[child] = edits + 1
                    queue.append((child, edits + 1))
        return state

    def _accept(self, state: dict[int, int]) -> tuple[int, float] | None:
        """Fewest edits, then highest weight, of the terms that end here."""
        ends = [(edits, -self.weight[n][0]) for n, edits in state.items()
                if n >= 0 and self.weight[n] and edits <= self.weight[n][1]]
        best = min(ends, default=None)
        return best and (best[0], -best[1])

    def _step(self, state: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.limit[abs(node)] and edits < out.get(node, 99):
                out[node] = edits

        for node, edits in state.items():
            if node < 0:
                if self.due[-node] == letter:
                    reach(-node, edits)
                continue
            reach(node, edits + 1)
            for c, child in self.children[node].items():
                reach(child, edits + (c != letter))
                if self.swaps and c != letter and letter in self.children[child]:
                    reach(-self.children[child][letter], edits + 1)
        return self._closed(out)

    def match(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the nearest term within its allowed edits."""
        at = 0
        for letter in word:
            letter = letter if letter in self.letters else "\0"  # all foreign letters behave alike
            follow = self.next[at].get(letter)
            if follow is None:
                state = self._step(self.states[at], letter)
                key = tuple(sorted(state.items()))
                follow = self.ids.get(key)
                if follow is None:
                    follow = self.ids[key] = len(self.states)
                    self.states.append(state)
                    self.next.append({})
                    self.accepts.append(self._accept(state))
                self.next[at][letter] = follow
            at = follow
            if not self.states[at]:
                return None
        return self.accepts[at]


def quotations(text: str) -> list[tuple[int, int]]:
    """Begin and end of each quotation, in order."""
    marks = [(m.group(), m.start()) for m in MARK.finditer(text)]
    out, k, unpaired = [], 0, set()
    while k < len(marks):
        mark, begin = marks[k]
        k += 1
        if mark not in CLOSING or mark in unpaired:
            continue
        end = next((j for j in range(k, len(marks)) if marks[j][0] in CLOSING[mark]), None)
        if end is None:
            unpaired.add(mark)  # nor has any later one of its kind
        else:
            out.append((begin, marks[end][1] + 1))
            k = end + 1
    return out


@dataclass
class Matcher:
    """Matches of words, remembered: most words of a corpus come back."""

    automaton: LexiconAutomaton
    seen: set = field(default_factory=set)
    hits: dict = field(default_factory=dict)

    def learn(self, words: list[str]) -> None:
        if len(self.seen) > MEMORY:
            self.seen.clear()
            self.hits.clear()
        if len(self.automaton.states) > STATES:
            self.automaton.forget()
        for word in set(words) - self.seen:
            self.seen.add(word)
            found = self.automaton.match(word)
            if found:
                self.hits[word] = found

    def figures(self, text: str) -> list[float]:
        lowered = text.lower()
        words = WORD.findall(lowered)
        self.learn(words)
        if self.hits.keys().isdisjoint(words):
            return [0.0] * len(FEATURES)
        quotes = quotations(lowered)
        sums = dict.fromkeys(("plain", "misspelt", "quoted"), 0.0)
        best = dict.fromkeys(("plain", "misspelt", "quoted"), 0.0)
        places: list[tuple[int, float]] = []
        quote, burst, window, first = 0, 0.0, 0.0, 0
        for i, found in enumerate(WORD.finditer(lowered)):
            hit = self.hits.get(found.group())
            if hit is None:
                continue
            while quote < len(quotes) and quotes[quote][1] <= found.start():
                quote += 1
            edits, weight = hit
            kind = "quoted" if quote < len(quotes) and quotes[quote][0] < found.start() else "misspelt" if edits else "plain"
            sums[kind] += weight
            best[kind] = max(best[kind], weight)
            if kind != "quoted":
                places.append((i, weight / (1 + edits)))
                window += places[-1][1]
                while places[first][0] <= i - CONTEXT:
                    window -= places[first][1]
                    first += 1
                burst = max(burst, window)
        return [math.log1p(sums["plain"]), best["plain"], math.log1p(sums["misspelt"]), best["misspelt"],
                math.log1p(sums["quoted"]), math.log1p(burst),
                math.log1p(100 * (sums["plain"] + sums["misspelt"] / 2) / len(words))]


def figures(df: DataFrame, weights: dict[str, float], text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and the ``FEATURES`` of every text."""
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{f}` double" for f in FEATURES])

    sent = df.sparkSession.sparkContext.broadcast(weights)  # MAX_TERMS words at most

    def run(batches):
        # The matcher stays with all it has learned for the next task of this worker.
        matcher = kept("lexicon", sent.value, lambda: Matcher(LexiconAutomaton(sent.value, swaps=True)))
        for batch in pieces(batches):
            rows = [matcher.figures(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *(pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES)))],
                names=[*keep, *FEATURES])

    return df.select(*keep, F.col(text).cast("string").alias("text to score")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(``doc_id``, ``toxic``, ``weight``) of the rows to learn from: not held out, at most ``SAMPLE`` of each label.

    A row stands for ``weight`` known ones, so the labels keep their shares whatever is left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()) \
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = lambda k: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) \
        .withColumn("weight", F.lit(max(1.0, n.get(k, 0) / SAMPLE)))
    return part(0).unionByName(part(1))


def _counted(batches):
    for batch in pieces(batches):
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({w for w in WORD.findall((text or "").lower()) if len(w) >= LEAST_LENGTH})
        words = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays([
            pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()),
            pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "toxic", "clean"])


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the words that toxic texts of ``sample`` (text, toxic) use significantly more often."""
    counts = sample.select("text", "toxic").mapInArrow(_counted, "word string, toxic long, clean long") \
        .groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.sum("clean").cast("double").alias("c")).where("t > 1")
    counts = materialize(counts, "toxicity-words")
    least = max(LEAST_G2, 2 * math.log(max(counts.count(), 1)))
    share = n_toxic / (n_toxic + n_clean)
    g2 = 2 * (F.col("t") * F.log(F.col("t") / ((F.col("t") + F.col("c")) * share))
              + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / ((F.col("t") + F.col("c")) * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    kept = counts.select("word", g2.alias("g2"), odds.alias("odds")).where((F.col("g2") >= least) & (F.col("odds") >= LEAST_ODDS))
    return {r.word: r.odds for r in kept.orderBy(F.desc("g2"), "word").limit(MAX_TERMS).collect()}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    intercept: float
    coefficients: tuple[float, ...]

    def score(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """``keep`` and ``score`` of every row; higher means likelier toxic."""
        if not self.weights:
            return df.select(*keep, (F.lit(1.0) / (1 + F.exp(F.lit(-self.intercept)))).alias("score"))
        linear = F.lit(self.intercept)
        for name, weight in zip(FEATURES, self.coefficients, strict=True):
            linear += F.col(name) * weight
        return figures(df, self.weights, text, keep).select(*keep, (1 / (1 + F.exp(-linear))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> ToxicityModel:
    # The sample has at most two times SAMPLE rows of three numbers, so its join may be broadcast.
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col(text).cast("string").alias("text")) \
        .join(F.broadcast(labelled(labels)), "doc_id")
    sample = materialize(rows.select("text", "toxic", "weight"), "toxicity-sample")
    n = {r.toxic: r for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("known")).collect()}
    n_toxic, n_clean = (n[k].rows if k in n else 0 for k in (1, 0))
    weights = lexicon(sample, n_toxic, n_clean) if n_toxic and n_clean else {}
    if not weights:
        odds = math.log(n[1].known / n[0].known) if n_toxic and n_clean else 700.0 if n_toxic else -700.0
        return ToxicityModel({}, odds, ())
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        figures(sample, weights, "text", ("toxic", "weight"))).select("features", "toxic", "weight")
    found = LogisticRegression(labelCol="toxic", weightCol="weight", regParam=0.003, maxIter=50).fit(materialize(vectors, "toxicity-vectors"))
    return ToxicityModel(weights, float(found.intercept), tuple(float(c) for c in found.coefficients))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    model = fit(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return model.score(rows, "text", ("row",)).where("score < 0.5").select("row.*")
