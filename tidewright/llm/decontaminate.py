"""Benchmark decontamination by embedded edit distance (operator 1).

Texts are compared as words: letters A-Z in lower case, ASCII punctuation as blank. The CGK
embedding walks over a window of words for three times its length and at each step writes the word
it stands on; a random bit of that word and step decides whether it moves on. Windows within a small edit
distance so agree in most places, whatever was inserted or left out. Repeated bit-sampling
LSH takes ``BITS`` places as a key, ``SAMPLES`` times for each of ``WALKS`` walks. Equal samples count once, and a key
is only formed where all of its words are words of items, as it meets none elsewhere.

Windows are sized by the item: the largest power of two w with 1.5 w - 1 words or fewer than the item has.
An item is indexed at every word, texts are probed at every eighth of a window, so a passage with a whole item holds
four or more probes (two, of windows of four words) that begin where a window of the item begins. A probe that meets a key is followed by the exact
edit distance (Myers' bit vectors, in characters, best place within the text around it); a
passage counts if that is at most ``SHARE`` of the item's length. Places whose trigrams rule so few edits out have none found:
an edit spoils three trigrams at most, and k edits move a passage over k + 1 diagonals at most (see ``may_hold``).

Of 300 passages each, of 8 to 62 words, all were met with a tenth of the words changed, and 97.7 % or more with a fifth.
Typos that reach many more words than that, and items of few or long words without blanks, are met less often: keys are of
whole words, while ``SHARE`` counts characters. Keys of fewer places would often be met by chance, by texts that repeat
frequent words.

Items of fewer than ``LEAST_WORDS`` words, such as a sentence in a script without blanks, are searched for exactly as they are, by one
automaton for all. Below ``LEAST_BYTES`` bytes they prove nothing and are passed over.

Items are sent to the workers in blocks of bounded size, each compared with all texts. Missing items and those without words are passed
over; missing texts hold nothing. Of several matches of an item in a text the nearest counts, then the first. Repeated rows
repeat; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import U64, Words, flat, kept, mix, sized, words

#: Items with fewer words are searched for as they are, if they have so many bytes in UTF-8.
LEAST_WORDS, LEAST_BYTES = 8, 30
#: Up to 16 samples, each a bit of a number.
WALKS, SAMPLES, BITS = 4, 14, 5
#: Steps of a walk from which places are taken, in words of the window.
REACH = 1.25
SHARE = 0.2
#: Bytes of item texts that are compared with all documents at once.
BLOCK_BYTES = 8 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _PLAIN[_c] = 32
_FILTER_BITS = 18
#: Pairs whose distances are found together; fewer are done one by one.
_PAIRS, _FEW = 1024, 256
#: Words looked at together.
_SPAN = 1 << 14
#: Probes whose keys are held at once, bytes of texts, and places that meet before equal ones are dropped.
_PROBES, _TEXT_BYTES, _MET = 1 << 14, 1 << 21, 1 << 18
#: Letters of an item whose trigrams are compared together, and equal trigrams, as a multiple of all, that are compared at most.
_PIECE, _REPEATS = 128, 16


def plain_words(column: pa.Array) -> Words:
    data, offsets = flat(column)
    shown = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_PLAIN[data])])
    return words(shown)


def window_of(n_words: int) -> int:
    """Words of a window for an item of so many words."""
    size = 4
    while 3 * size - 1 <= n_words:
        size *= 2
    return size


@lru_cache(None)
def _places(size: int, walk: int) -> np.ndarray:
    """Sampled steps of each key, one from each of ``BITS`` equal parts of the walk; equal samples once.

    A walk stays on a word for two steps on average, so steps side by side say little. The latest steps mostly
    stand behind the window's end, and an edit is likelier to lie before a late step than an early one.
    """
    rng = np.random.default_rng([size, walk, 11])
    edges = np.linspace(0, REACH * size, BITS + 1).astype(int)
    drawn = [[rng.integers(a, max(b, a + 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)] for _ in range(SAMPLES)]
    return np.unique(drawn, axis=0)


def seeded(hashes: np.ndarray, size: int, walk: int) -> list[np.ndarray]:
    """The words' hashes for each 64 steps of a walk; they serve smaller windows as well."""
    seeds = [mix(hashes ^ U64(1 + walk + 64 * part)) for part in range(int(_places(size, walk).max()) // 64 + 1)]
    return [np.concatenate([s, np.zeros(size, U64)]) for s in seeds]  # a walk may end behind the last word


def walked(seeds: list[np.ndarray], starts: np.ndarray, size: int, walk: int):
    """(step, places, words) of the embedded windows of ``size`` words from each start on; ``seeds`` as from ``seeded``."""
    at, stop = starts.astype(np.int64), starts + size
    for step in range(int(_places(size, walk).max()) + 1):
        word = seeds[step // 64].take(at, mode="clip")
        if step >= size:
            word[at >= stop] = 0
        yield step, at, word
        word >>= U64(step % 64)
        word &= U64(1)
        at += word.view(np.int64)


def keys(seeds: list[np.ndarray], starts: np.ndarray, size: int, walk: int) -> np.ndarray:
    """(samples, windows) keys of the embedded windows of ``size`` words from each start on; ``seeds`` as from ``seeded``."""
    places = _places(size, walk)
    # A key is the sum of its words' hashes. Which of the words stood where is left to the exact distance.
    out = np.zeros((len(places), len(starts)), U64)
    for step, _, word in walked(seeds, starts, size, walk):
        for sample in np.flatnonzero((places == step).any(1)):
            out[sample] += word
    return out


@lru_cache(None)
def _others(size: int, walk: int) -> dict[int, np.uint16]:
    """For each sampled step a bit for each of the samples that do not take it."""
    places = _places(size, walk)
    return {step: np.uint16(sum(1 << s for s, row in enumerate(places.tolist()) if step not in row)) for step in np.unique(places).tolist()}


def possible(seeds: list[np.ndarray], size: int, walk: int, known: np.ndarray, behind: bool) -> np.ndarray:
    """For the window from each word on, a bit for each sample of whose words each is one that items have in that sample.

    ``known`` has these bits for each word. Found from the last step back to the first, for all words at once:
    what holds from a word and step on holds from the same or the next word and the next step on. If the walk of some window of an item
    is sampled ``behind`` its end, windows whose walk may go there have all bits.
    """
    others, every = _others(size, walk), np.uint16((1 << len(_places(size, walk))) - 1)
    last, n = max(others), len(seeds[0])
    out = np.empty(n, np.uint16)
    for a in range(0, n, _SPAN):
        own = slice(a, a + _SPAN + last + 1)
        sure, moved = known[own], np.zeros(len(known[own]), np.uint16)
        bits = sure | others[last]
        for step in range(last - 1, -1, -1):
            if step % 16 == 15 or step == last - 1:
                part = np.ascontiguousarray(seeds[step // 64][own].view("<u2").reshape(-1, 4)[:, step % 64 // 16])
            # All bits where the walk moves on.
            moves = ((part << np.uint16(15 - step % 16)).view(np.int16) >> np.int16(15)).view(np.uint16)
            for what in (bits, moved) if behind and step < size else (bits,):
                change = what[1:] ^ what[:-1]
                change &= moves[:-1]
                what[:-1] ^= change
            if behind and step < size:
                moved -= moves
            if step in others:
                bits &= sure | others[step]
        if behind:
            bits[moved >= 2 * size - last] = every
        out[a:a + _SPAN] = bits[:_SPAN] & every
    return out


def possible_keys(seeds: list[np.ndarray], starts: np.ndarray, size: int, walk: int, bits: np.ndarray):
    """Each sample that windows have the bit of, those windows, and their keys as from ``keys``."""
    places = _places(size, walk)
    sampled = set(places.ravel().tolist())
    words_at = {step: word.copy() for step, _, word in walked(seeds, starts, size, walk) if step in sampled}
    for sample, row in enumerate(places.tolist()):
        some = np.flatnonzero(bits & np.uint16(1 << sample))
        if not len(some):
            continue
        column = words_at[row[0]].take(some, mode="clip")
        for step in row[1:]:
            column += words_at[step].take(some, mode="clip")
        yield sample, some, column


def grams(chars: np.ndarray) -> np.ndarray:
    """A 16-bit hash of each three neighbouring code points."""
    out = chars[:-2] * np.uint32(0x9E3779B1)
    out += chars[1:-1] * np.uint32(0x85EBCA77)
    out += chars[2:] * np.uint32(0xC2B2AE3D)
    return (out >> np.uint32(16)).astype(np.uint16)


def may_hold(items: list[np.ndarray], owner: np.ndarray, texts: list[np.ndarray], share: float) -> np.ndarray:
    """For each text whether a part of it may be within ``share`` of its item's length in edits; items and texts as ``grams``.

    Of pieces of an item at least one bears no more than its share of the edits. Of its trigrams all but three an edit stand in the
    text, and the differences of their places there and in the piece lie within as many neighbours as there are edits, and one.
    Where that cannot be ruled out, or trigrams repeat too often to be counted, the answer is true.
    """
    size = np.array([len(items[i]) + len(t) for i, t in zip(owner, texts, strict=True)], np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // (8 * _SPAN))) + 1), len(size)]
    parts = [_may_hold(items, owner[a:b], texts[a:b], share) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _ranges(count: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(U64) * U64(0x9E3779B97F4A7C15)) >> U64(44)).view(np.int64)


def _may_hold(items: list[np.ndarray], owner: np.ndarray, texts: list[np.ndarray], share: float) -> np.ndarray:
    used, item = np.unique(owner, return_inverse=True)
    n_grams = np.array([len(items[i]) for i in used])
    length = n_grams + 2
    edits = (share * length).astype(np.int64)
    pieces = -(-length // _PIECE)
    # The trigrams of all pieces, sorted; those across an edge belong to none.
    of, place = np.repeat(np.arange(len(used)), n_grams), _ranges(n_grams)
    piece, last = (((place + more) * pieces[of] - 1) // length[of] for more in (1, 3))
    within = np.flatnonzero(piece == last)
    key = (of << 16 | np.concatenate([items[i] for i in used]))[within]
    order = within[np.argsort(key, kind="stable")]
    key, place, piece = np.sort(key), place[order], piece[order]
    # How many of a piece's trigrams must stand within how many neighbouring differences.
    of_piece, nth = np.repeat(np.arange(len(used)), pieces), _ranges(pieces)
    letters = (nth + 1) * length[of_piece] // pieces[of_piece] - nth * length[of_piece] // pieces[of_piece]
    borne = edits[of_piece] * letters // length[of_piece]
    least = letters - 2 - 3 * borne
    # Each text has a line of counts for each piece of its item.
    size = np.array([len(t) for t in texts])
    width = size + length[item] + edits[item] + 1
    lines = pieces[item]
    begin = np.cumsum(lines * width) - lines * width
    text, at = np.repeat(np.arange(len(texts)), size), _ranges(size)
    wanted = item[text] << 16 | np.concatenate(texts)
    seen = np.zeros(1 << 20, bool)
    seen[_slot(key)] = True
    some = np.flatnonzero(seen.take(_slot(wanted)))
    text, at, wanted = text[some], at[some], wanted[some]
    low, high = (np.searchsorted(key, wanted, side) for side in ("left", "right"))
    count = high - low
    many = np.bincount(text, count, len(texts)) > _REPEATS * width
    count[many[text]] = 0
    j = np.repeat(low, count) + _ranges(count)
    text, at = np.repeat(text, count), np.repeat(at, count)
    found = np.bincount(begin[text] + piece[j] * width[text] + at - place[j] + length[item[text]], minlength=int((lines * width).sum()))
    upto = np.concatenate([[0], np.cumsum(found)])
    of_line = np.repeat((np.cumsum(pieces) - pieces)[item], lines) + _ranges(lines)
    line_width = np.repeat(width, lines)
    ends = np.arange(len(found)) + np.repeat(borne[of_line] + 1, line_width)
    near = upto.take(ends, mode="clip") - upto[:-1]
    holds = np.maximum.reduceat(near, np.cumsum(line_width) - line_width) >= least[of_line]
    return np.logical_or.reduceat(holds, np.cumsum(lines) - lines) | many


def infix_distance(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a part of ``text``, and where the first such part ends."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def infix_distances(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """For each pair the least edit distance of the item to a part of the text, both as code points; all pairs step by step together."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (-(-len(items[i]) // 64), len(texts[i])))
    for a in range(0, len(order), _PAIRS):
        own = order[a:a + _PAIRS]
        out[own] = _infix_distances([items[i] for i in own], [texts[i] for i in own])
    return out


def _infix_distances(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    n, size = len(items), np.array([len(x) for x in items])
    letters = np.unique(np.concatenate(items))
    last, steps = (size - 1) // 64, max(len(t) for t in texts)
    least, blocks = int(last.min()), int(last.max()) + 1
    # Bits of the item's places that hold a letter; the last line is of letters no item has.
    masks = np.zeros((blocks, n, len(letters) + 1), U64)
    coded = np.full((steps, n), len(letters))
    for i, (item, text) in enumerate(zip(items, texts, strict=True)):
        place = np.arange(len(item))
        np.bitwise_or.at(masks[:, i], (place // 64, np.searchsorted(letters, item)), U64(1) << (place % 64).astype(U64))
        found = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        coded[:len(text), i] = np.where(letters[found] == text, found, len(letters))
    coded += np.arange(n) * (len(letters) + 1)
    masks, one, none = masks.reshape(blocks, -1), U64(1), np.zeros(n, U64)
    up, down = np.full((blocks, n), ~U64(0)), np.zeros((blocks, n), U64)
    top = [np.where(last == b, (size - 1) % 64, 63).astype(U64) for b in range(blocks)]
    ends = [last == b for b in range(blocks)]
    length = np.array([len(t) for t in texts])
    score, best = size.copy(), size.copy()
    for step in range(steps):
        plus_in = minus_in = none  # a part may begin anywhere
        for b in range(blocks):
            eq, pv, mv = masks[b].take(coded[step]), up[b], down[b]
            xv = eq | mv
            eq |= minus_in
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            minus = xh & pv
            xh |= pv
            plus = ~xh
            plus |= mv
            plus_out, minus_out = plus >> top[b], minus >> top[b]
            plus_out &= one
            minus_out &= one
            plus <<= one
            plus |= plus_in
            minus <<= one
            minus |= minus_in
            np.bitwise_and(plus, xv, out=mv)
            xv |= plus
            np.invert(xv, out=pv)
            pv |= minus
            if b >= least:
                score += (plus_out - minus_out).view(np.int64) * ends[b]
            plus_in, minus_in = plus_out, minus_out
        score[step >= length] = size[step >= length]  # behind its text a pair changes no more
        np.minimum(best, score, out=best)
    return best


def _lead(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - _FILTER_BITS)).view(np.int64)


def _once(parts: list[np.ndarray]) -> np.ndarray:
    """Columns of all parts, equal ones once, in order."""
    rows = np.concatenate(parts, 1)
    rows = rows[:, np.lexsort(rows[::-1])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    return rows[:, new]


class _Spelled:
    """The words of some texts with a blank after each, in code points."""

    def __init__(self, found: Words):
        size = found.stop - found.start + 1
        upto = np.cumsum(size)
        data = np.append(found.data, np.uint8(32))[np.repeat(found.start - (upto - size), size) + np.arange(int(size.sum()))]
        data[upto - 1] = 32
        self.chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        #: Where each word begins, and at the end where one more would.
        begins = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))
        self.word = begins[np.concatenate([[0], upto])]

    def between(self, a: int, b: int) -> np.ndarray:
        """Words a to b, without the blank at the end."""
        return self.chars[self.word[a]:max(self.word[a], self.word[b] - 1)]

    @cached_property
    def _grams(self) -> np.ndarray:
        return grams(self.chars)

    def grams(self, a: int, b: int) -> np.ndarray:
        """``grams`` of ``between``."""
        return self._grams[self.word[a]:max(self.word[a], self.word[b] - 3)]


def _text(chars: np.ndarray) -> str:
    return chars.tobytes().decode("utf-32-le")


class ItemIndex:
    """Keys of all windows of a block of items, by window size, walk and sample."""

    def __init__(self, items: list[tuple[int, str]]):
        found = plain_words(pa.array([t for _, t in items], pa.string()))
        hashes, first = found.hashes(), found.first
        spelled = _Spelled(found)
        #: Id, text in words with one blank between, and number of words of every item.
        self.items: list[tuple[int, np.ndarray, int]] = []
        #: Trigrams of every item.
        self.grams: list[np.ndarray] = []
        #: A number for each of the leading bits that hashes of items' words have, 0 for all others.
        self.word = np.zeros(1 << _FILTER_BITS, np.int32)
        lead = np.unique(_lead(hashes))
        self.word[lead] = np.arange(1, len(lead) + 1)
        word, n_words = self.word[_lead(hashes)], len(lead) + 1
        #: By window size and walk a bit for each sample in which items have a word of that number, at whatever step: keys are sums.
        self.known: dict[tuple[int, int], np.ndarray] = {}
        #: Window sizes and walks of which a sampled step stands behind the end of some item's window.
        self.behind: set[tuple[int, int]] = set()
        #: Per table the sorted keys, the items and the words at which their windows begin, and which leading bits occur.
        self.tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        #: Items of few words, searched for as they are.
        self.short = ahocorasick.Automaton()
        by_size = defaultdict(list)
        for i, (item_id, _) in enumerate(items):
            a, b = first[i], first[i + 1]
            self.items.append((item_id, spelled.between(a, b), b - a))
            self.grams.append(spelled.grams(a, b))
            if b - a >= LEAST_WORDS:
                by_size[window_of(b - a)].append(i)
            elif b > a and len((own := _text(self.items[i][1])).encode()) >= LEAST_BYTES:
                # Whole words, or a part of one where the item has no blank, as in scripts that write none.
                key = f" {own} " if " " in own else own
                self.short.add_word(key, (*self.short.get(key, ()), i))
        if len(self.short):
            self.short.make_automaton()
        self.sizes = sorted(by_size)
        #: Bytes of texts to be looked at together: fewer where the longest walk needs many hashes of a word.
        self.text_bytes = _TEXT_BYTES // (1 + int(max((_places(size, 0).max() for size in self.sizes), default=0)) // 64)
        for size, members in by_size.items():
            at = np.concatenate([np.arange(first[i], first[i + 1] - size + 1) for i in members])
            owner = np.concatenate([np.full(first[i + 1] - first[i] - size + 1, i) for i in members])
            for walk in range(WALKS):
                self.known[size, walk] = known = np.zeros(n_words, np.uint16)
                for step, place, _ in walked(seeded(hashes, size, walk), at, size, walk):
                    if step in _others(size, walk):
                        here, inside = np.zeros(n_words, bool), place < at + size
                        here[word[place[inside]]] = True
                        known[here] |= ~_others(size, walk)[step]
                        if not inside.all():
                            self.behind.add((size, walk))
                for sample, column in enumerate(keys(seeded(hashes, size, walk), at, size, walk)):
                    order = np.argsort(column, kind="stable")
                    bits = np.zeros(1 << _FILTER_BITS, bool)
                    bits[_lead(column)] = True
                    self.tables[size, walk, sample] = (
                        column[order], owner[order].astype(np.int32), (at - first[owner])[order].astype(np.int32),
                        np.packbits(bits, bitorder="little"))

    def probe(self, found: Words) -> dict[int, set[tuple[int, int]]]:
        """Per text: the items it may hold, each with the words at which the item would begin."""
        hashes, first = found.hashes(), found.first
        word = self.word.take(_lead(hashes))
        met, pending = [], 0
        probed = {}
        for size in self.sizes:
            n = np.diff(first)
            stride = max(1, size // 8)
            count = np.maximum(0, (n - size) // stride + 1) * (n >= size)
            if count.any():
                probed[size] = np.repeat(np.arange(len(n)), count), np.repeat(first[:-1], count) + _ranges(count) * stride
        for walk in range(WALKS) if probed else ():
            seeds = seeded(hashes, max(probed), walk)
            for size, (text, at) in probed.items():
                known = np.concatenate([self.known[size, walk].take(word), np.zeros(max(probed), np.uint16)])
                bits = possible(seeds, size, walk, known, (size, walk) in self.behind).take(at)
                which = np.flatnonzero(bits)
                for a in range(0, len(which), _PROBES):
                    probes = which[a:a + _PROBES]
                    for sample, some, column in possible_keys(seeds, at[probes], size, walk, bits[probes]):
                        key, owner, offset, filled = self.tables[size, walk, sample]
                        lead = _lead(column)
                        likely = np.flatnonzero(filled.take(lead >> 3) >> (lead & 7).astype(np.uint8) & 1)
                        if not len(likely):
                            continue
                        low, high = (np.searchsorted(key, column[likely], side) for side in ("left", "right"))
                        count = high - low
                        if not count.any():
                            continue
                        # The windows of items that windows of texts meet, a bounded number at once.
                        edges = np.flatnonzero(np.diff(np.cumsum(count) // _MET)) + 1
                        for b, c in zip([0, *edges], [*edges, len(count)], strict=True):
                            own = count[b:c]
                            if not own.any():
                                continue
                            j = np.repeat(low[b:c] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                            k = np.repeat(probes[some[likely[b:c]]], own)
                            met.append(np.stack([text[k], owner[j], at[k] - first[text[k]] - offset[j]]))
                            pending += len(j)
                            if pending > _MET:
                                met, pending = [_once(met)], 0
        out = defaultdict(set)
        for k, item, begin in _once(met).T.tolist() if met else ():
            out[k].add((item, begin))
        return out

    def _short_matches(self, found: Words, spelled: _Spelled):
        """(text, items, first and last word) wherever an item of few words stands."""
        for text in range(len(found.first) - 1 if len(self.short) else 0):
            a, b = spelled.word[found.first[text]], spelled.word[found.first[text + 1]]
            for end, items in self.short.iter(" " + _text(spelled.chars[a:b])):
                size = len(self.items[items[0]][1])
                stop = a + end - (self.items[items[0]][1] == 32).any()  # a blank goes before the text, another behind the item
                w0, w1 = (int(np.searchsorted(spelled.word, at, "right")) - 1 for at in (stop - size, stop - 1))
                yield text, items, w0, w1

    def matches(self, column: pa.Array, share: float) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """Per text: (item_id, distance, item length, first byte, end byte) of each item it holds."""
        found = plain_words(column)
        if not len(found.start):
            return {}
        _, offsets = flat(column)
        spelled = _Spelled(found)
        places = []  # text, item, first and last word around the place at which the item may be
        for text, wanted in self.probe(found).items():
            base, total = int(found.first[text]), int(found.first[text + 1] - found.first[text])
            looked: dict[int, int] = {}
            for item, begin in sorted(wanted):
                n = self.items[item][2]
                slack = 2 + int(share * n)
                if begin <= looked.get(item, -total - n):
                    continue
                looked[item] = begin + slack // 2
                a, b = base + max(0, begin - slack), base + min(total, begin + n + 2 * slack)
                places.append((text, item, a, b))
        hold = may_hold(self.grams, np.array([i for _, i, _, _ in places], np.int64), [spelled.grams(a, b) for _, _, a, b in places], share)
        places = [places[k] for k in np.flatnonzero(hold)]
        if len(places) >= _FEW:
            distances = infix_distances([self.items[i][1] for _, i, _, _ in places], [spelled.between(a, b) for _, _, a, b in places])
            places = [p for p, distance in zip(places, distances.tolist(), strict=True) if distance <= share * len(self.items[p[1]][1])]
        out = defaultdict(dict)
        for text, item, a, b in places:
            around, wanted = _text(spelled.between(a, b)), _text(self.items[item][1])
            distance, end = infix_distance(wanted, around)
            if distance > share * len(wanted):
                continue
            _, back = infix_distance(wanted[::-1], around[max(0, end - len(wanted) - distance):end][::-1])
            edges = spelled.word[a:b + 1] - spelled.word[a]
            w0 = a + int(np.searchsorted(edges, end - back, "right")) - 1
            w1 = max(w0, a + int(np.searchsorted(edges, end, "left")) - 1)
            here = (distance, int(found.start[w0] - offsets[text]), int(found.stop[w1] - offsets[text]))
            out[text][item] = min(out[text].get(item, here), here)
        for text, items, w0, w1 in self._short_matches(found, spelled):
            here = (0, int(found.start[w0] - offsets[text]), int(found.stop[w1] - offsets[text]))
            for item in items:
                out[text][item] = min(out[text].get(item, here), here)
        return {text: sorted((self.items[i][0], d, len(self.items[i][1]), a, b) for i, (d, a, b) in best.items()) for text, best in out.items()}


def blocks(items: DataFrame, id: str = "item_id", text: str = "text") -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_BYTES``, one job per block; items without text are left out."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(id).cast("long").alias("item"), F.col(text).cast("string").alias("words"))
    total = rows.agg(F.sum(F.octet_length("words"))).collect()[0][0] or 0
    n = -(-total // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item", "words"), F.lit(max(n, 1)))
    return [sorted({(r.item, r.words) for r in rows.where(part == k).collect()}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            for k in range(n)]


def find_items(df: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(``doc_id``, ``item_id``, ``distance``, ``item_chars``, ``start``, ``stop``): each item found in a text, in code points."""
    schema = "doc_id long, item_id long, distance long, item_chars long, start long, stop long"
    names = [f.split()[0] for f in schema.split(", ")]
    rows = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = df.sparkSession

    def finder(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            index = kept("items", sent.value, lambda: ItemIndex(sent.value))
            for batch in sized(batches, 1, max(1, index.text_bytes)):
                out = [[] for _ in names]
                for text, found in index.matches(batch.column(1), share).items():
                    raw = batch.column(1)[text].as_py().encode()
                    for item, distance, length, a, b in found:
                        row = (batch.column(0)[text].as_py(), item, distance, length, len(raw[:a].decode()), len(raw[:b].decode()))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
        return run

    out = spark.createDataFrame([], schema)
    for k, block in enumerate(blocks(items)):
        found = rows.mapInArrow(finder(block), schema)
        out = out.unionByName(found) if k else found
    return out


def drop_contaminated(df: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``df``, all columns, whose text holds none of the items."""
    spark = df.sparkSession

    def cleaner(block):
        sent = spark.sparkContext.broadcast(block)

        def run(batches):
            index = kept("items", sent.value, lambda: ItemIndex(sent.value))
            for batch in sized(batches, 0, max(1, index.text_bytes)):
                held = index.matches(batch.column(0), share)
                clean = np.ones(batch.num_rows, bool)
                clean[list(held)] = False
                yield batch.filter(pa.array(clean))
        return run

    out = df.select(F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    for block in blocks(items):
        out = out.mapInArrow(cleaner(block), out.schema)
    return out.select("row.*")
