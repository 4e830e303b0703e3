"""Stretches of periodic words, found on a Re-Pair grammar (operator 11).

Grammar. The texts of an Arrow batch are sequences of word ids. In rounds, pairs of neighbouring symbols that occur
twice or more are replaced by nonterminals: a pair is replaced where it is more frequent than the pairs that
overlap it, so a round does many of Re-Pair's steps at once, and the next one counts anew. When no pair occurs
twice, what is left of each text is halved into a balanced tree. Every replacement is kept with its place, so the
occurrences of a nonterminal, fewer than the words of the batch in all, are its derivation positions.

Runs. A run lies across the middle of exactly one node that holds all of it. So each nonterminal is looked at once,
at its first occurrence: the word before its middle and the equal words after it, and the word after its middle and
the equal words before it, give the possible periods; prefix hashes tell how far a period reaches within the
node. What has two periods and ``LEAST`` words is moved to all occurrences. There a run may be cut at the end of a
node; a larger node then has all of it, so of intervals of one period those within others go.

The result does not depend on the grammar, and texts that share a batch change nothing but the work. Prefix hashes are
of 64 bits, and modulo a prime besides. A missing or empty text has no words and no runs; a text is never cut. Repeated rows
repeat, an empty table gives an empty result, other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import U64, Words, mix, sized, words

#: Words of the shortest run.
LEAST = 12
#: Rounds of replacement before the rest is halved, and candidates that are looked at together.
ROUNDS, CANDIDATES = 64, 1 << 18
_PRIME, _BASE = np.int64((1 << 31) - 1), np.int64(1_103_515_245)
_RATIO = U64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Occurrences:
    """Nodes with room for a run: their nonterminal, and where they begin, are divided and end."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, rule: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> None:
        large = np.flatnonzero(end - start >= LEAST)
        if len(large):
            self.parts.append((rule[large], start[large], middle[large], end[large]))

    def sorted(self) -> tuple[np.ndarray, ...]:
        """``rule``, ``start``, ``middle``, ``end``, those of one nonterminal together."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4
        rule, *rest = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(rule, kind="stable")
        return rule[order], *(c[order] for c in rest)


def _replaceable(pair: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of pairs of higher rank than the pairs that overlap them; of pairs like 'aa' in a row every second."""
    n = len(pair)
    like_last = np.zeros(n, bool)
    like_last[1:] = (pair[1:] == pair[:-1]) & (rank[1:] > 0) & (rank[:-1] > 0)
    number = np.arange(n)
    even = (number - np.maximum.accumulate(np.where(like_last, 0, number))) % 2 == 0
    fits = (rank > 0) & even
    fits[1:] &= like_last[1:] | (rank[1:] > rank[:-1])
    fits[:-1] &= like_last[1:] | (rank[:-1] > rank[1:])
    return np.flatnonzero(fits)


def grammar(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences of all nonterminals over the texts ``ids[first[d]:first[d + 1]]``."""
    symbol, text = ids.astype(np.int64), np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(len(ids))
    end = start + 1
    found = _Occurrences()
    fresh = int(symbol.max(initial=-1)) + 1
    known, rules = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def replace(at: np.ndarray, rule: np.ndarray) -> None:
        nonlocal symbol, text, start, end
        found.add(rule, start[at], start[at + 1], end[at + 1])
        symbol[at], end[at] = rule, end[at + 1]
        rest = np.ones(len(symbol), bool)
        rest[at + 1] = False
        symbol, text, start, end = symbol[rest], text[rest], start[rest], end[rest]

    for _ in range(ROUNDS):
        pair = (symbol[:-1] << np.int64(32)) | symbol[1:]
        valid = np.flatnonzero(text[1:] == text[:-1])
        distinct, which, count = np.unique(pair[valid], return_inverse=True, return_counts=True)
        count[count < 2] = 0
        rank = np.zeros(len(pair), np.int64)
        rank[valid] = np.where(count > 0, (count << 32) | (mix(distinct.astype(U64)) >> U64(32)).astype(np.int64), 0)[which]
        at = _replaceable(pair, rank)
        if not len(at):
            break
        new, which = np.unique(pair[at], return_inverse=True)
        old = np.searchsorted(known, new)
        has = np.zeros(len(new), bool)
        if len(known):
            has = known[np.minimum(old, len(known) - 1)] == new
        rule = np.empty(len(new), np.int64)
        rule[has] = rules[old[has]]
        rule[~has] = fresh + np.arange((~has).sum())
        fresh += int((~has).sum())
        known, rules = np.concatenate([known, new[~has]]), np.concatenate([rules, rule[~has]])
        order = np.argsort(known, kind="stable")
        known, rules = known[order], rules[order]
        replace(at, rule[which])
    while len(symbol):
        place = np.arange(len(text)) - np.searchsorted(text, text)
        at = np.flatnonzero((place[:-1] % 2 == 0) & (text[1:] == text[:-1]))
        if not len(at):
            break
        replace(at, fresh + np.arange(len(at)))
        fresh += len(at)
    return found.sorted()


class _Prefixes:
    """Whether two stretches of words are equal, from two running sums of hashes."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        up = np.full(n + 1, _RATIO, U64)
        up[0] = 1
        self.up = np.cumprod(up)
        self.sum = np.concatenate([np.zeros(1, U64), np.cumsum(weights * self.up[:n])])
        power = np.ones(1, np.int64)
        while len(power) <= n:  # powers of the base modulo the prime, twice as many at a time
            power = np.concatenate([power, power * (power[-1] * _BASE % _PRIME) % _PRIME])
        self.power = power[:n + 1]
        small = (weights >> U64(33)).astype(np.int64)
        self.residue = np.concatenate([np.zeros(1, np.int64), np.cumsum(small * self.power[:n] % _PRIME)])

    def equal(self, at: np.ndarray, shift: np.ndarray, length: int) -> np.ndarray:
        a, b = at, at + shift
        same = (self.sum[a + length] - self.sum[a]) * self.up[shift] == self.sum[b + length] - self.sum[b]
        some = np.flatnonzero(same)
        a, b, shift = a[some], b[some], shift[some]
        left = (self.residue[a + length] - self.residue[a]) % _PRIME * self.power[shift] % _PRIME
        same[some] = left == (self.residue[b + length] - self.residue[b]) % _PRIME
        return same

    def reach(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """For how many words from ``at`` on (or before it), ``most`` at most, each equals the word ``shift`` later."""
        out = np.zeros(len(at), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            some = np.flatnonzero(out + step <= most)
            begin = at[some] - out[some] - step if back else at[some] + out[some]
            out[some[self.equal(begin, shift[some], step)]] += step
            step >>= 1
        return out


def crossing(ids: np.ndarray, prefixes: _Prefixes, start: np.ndarray, middle: np.ndarray, end: np.ndarray):
    """(node, begin, stop, period) of the runs across the middle of each node, as far as they reach in it."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    places = ids[order] * n + order  # ascending: all places of a word, in order
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    half = (end - start) // 2
    out = []
    for after in (True, False):
        anchor = middle - 1 if after else middle
        reach = np.minimum(half, end - middle if after else middle - start)
        key = ids[anchor] * n + anchor
        if after:
            low, high = rank[anchor] + 1, np.searchsorted(places, key + reach, "right")
        else:
            low, high = np.searchsorted(places, key - reach, "left"), rank[anchor]
        count = high - low
        upto = np.cumsum(count)
        a = 0
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES, "right")))
            node = np.repeat(np.arange(a, b), count[a:b])
            at = np.arange(len(node)) - np.repeat(upto[a:b] - count[a:b] - (upto[a - 1] if a else 0), count[a:b]) + low[node]
            period = np.abs(order[at] - anchor[node])
            out.append(_confirmed(ids, prefixes, node, start[node], middle[node], end[node], period, after))
            a = b
    node, begin, stop, period = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((period, stop, begin, node))
    node, begin, stop, period = node[order], begin[order], stop[order], period[order]
    new = np.ones(len(node), bool)  # multiples of a period reach as far: the smallest counts
    new[1:] = (node[1:] != node[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    return node[new], begin[new], stop[new], period[new]


def _confirmed(ids, prefixes, node, start, middle, end, period, after):
    """Those candidates that are runs; ``base`` and the word a period later are compared to both sides."""
    base = middle if after else middle - period
    last = len(ids) - 1
    follows = (base + period < end) & (ids[base] == ids[np.minimum(base + period, last)])
    if after:  # the word before the middle agrees; a run of LEAST words needs one more beside it
        more = follows | ((base - 2 >= start) & (ids[base - 2] == ids[base - 2 + period]))
    else:
        more = ((base - 1 >= start) & (ids[base - 1] == ids[base - 1 + period])) | (
            (base + period + 1 < end) & (ids[base + 1] == ids[np.minimum(base + period + 1, last)]))
    some = np.flatnonzero(more)
    node, start, middle, end, period, base = (c[some] for c in (node, start, middle, end, period, base))
    forth = prefixes.reach(base, period, end - base - period, back=False)
    back = prefixes.reach(base, period, base - start, back=True)
    begin, stop = base - back, base + period + forth
    whole = np.flatnonzero((stop - begin >= np.maximum(LEAST, 2 * period)) & (begin < middle) & (stop > middle))
    return node[whole], begin[whole], stop[whole], period[whole]


def runs_of(ids: np.ndarray, weights: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, stop, period) of all runs of all texts, by place; ``weights`` are the hashes of the words."""
    rule, start, middle, end = grammar(ids, first)
    none = (np.zeros(0, np.int64),) * 3
    if not len(rule):
        return none
    example = np.flatnonzero(np.diff(rule, prepend=rule[0] - 1))
    node, begin, stop, period = crossing(ids, _Prefixes(weights), start[example], middle[example], end[example])
    if not len(node):
        return none
    # To all derivation positions of the nonterminal.
    uses = np.diff(np.append(example, len(rule)))[node]
    run = np.repeat(np.arange(len(node)), uses)
    use = example[node][run] + np.arange(len(run)) - np.repeat(np.cumsum(uses) - uses, uses)
    shift = start[use] - start[example[node]][run]
    begin, stop, period = begin[run] + shift, stop[run] + shift, period[run]
    # Of one period, what lies within another is the same run, cut at the end of a node.
    order = np.lexsort((-stop, begin, period))
    begin, stop, period = begin[order], stop[order], period[order]
    far = stop + period * np.int64(len(ids) + 1)
    widest = np.maximum.accumulate(far)
    kept = np.ones(len(begin), bool)
    kept[1:] = far[1:] > widest[:-1]
    begin, stop, period = begin[kept], stop[kept], period[kept]
    order = np.lexsort((period, begin))
    return begin[order], stop[order], period[order]


def _joined(found: Words, kept: np.ndarray) -> pa.Array:
    """Per text the kept words, with one blank between."""
    chosen = np.flatnonzero(kept)
    size = found.stop[chosen] - found.start[chosen] + 1
    where = np.cumsum(size)
    data = np.append(found.data, np.uint8(0x20))
    begin = where - size
    data = data[np.repeat(found.start[chosen] - begin, size) + np.arange(int(size.sum()))] if len(chosen) else data[:0]
    data[where - 1] = 0x20
    edges = np.concatenate([[0], where])[np.searchsorted(chosen, found.first)]
    # The blank after the last word of a text is left out.
    stops = np.maximum(edges[1:] - 1, edges[:-1])
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1], stops, strict=True)], pa.string())


def periodic_runs(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its words, its ``runs`` by start, then period, and the text ``collapsed``: of each run one period stays."""
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        for batch in sized(batches, 1):
            found = words(batch.column(1))
            weights = found.hashes()
            _, ids = np.unique(weights, return_inverse=True)
            begin, stop, period = runs_of(ids.astype(np.int64), weights, found.first)
            gone = np.zeros(len(weights) + 1, np.int64)
            np.add.at(gone, begin + period, 1)
            np.add.at(gone, stop, -1)
            collapsed = _joined(found, np.cumsum(gone)[:-1] == 0)
            edges = np.searchsorted(begin, found.first)
            own = np.repeat(found.first[:-1], np.diff(edges))
            listed = pa.StructArray.from_arrays(
                [pa.array(begin - own), pa.array(stop - begin), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.counts(), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(edges, pa.int32()), listed), collapsed],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, RESULT)


def longest(runs: Column) -> Column:
    """Of a list of runs the one with the greatest length, then the smallest start, then period; null without runs."""
    return F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))


def report(df: DataFrame) -> DataFrame:
    runs = F.col("runs")
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    best = F.col("best")
    return periodic_runs(df).withColumn("best", longest(runs)).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"),
        (-best["shorter"]).alias("length"), best["period"].alias("period"),
        F.expr("-1000 * best.shorter div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def replayed(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``text``): in a tenth of the texts, chosen by their ids, a stretch of words is repeated to the end.

    With h the CRC-32 of the decimal id and g = h div 10, texts with h mod 10 = 0 keep their words up to number
    a = g mod n and go on with the 1 + (n - a) div (3 + g mod 8) words from there, again and again up to n
    words. Others, and those without id or words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")) \
        .withColumn("words", F.when(h % 10 == 0, F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), ""))) \
        .select("doc_id", "text", "words", F.size("words").alias("n"), F.floor(h / 10).alias("g")) \
        .withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)")) \
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), "
                   "cast((n - a - 1) div p + 1 as int)))), 1, n), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
