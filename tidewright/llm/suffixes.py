"""Repeated byte strings removed by prefix-free parsing (operator 2).

Parse. A rolling hash over 26 bytes triggers where it is the least of 25 in a row; so every 50
bytes hold a trigger, and equal 50 bytes hold one at the same place. A phrase is a trigger
with what 50-byte strings around it can reach: 24 bytes before it and 50 from it on, fewer at the ends of a
text. Texts that repeat each other repeat phrases, and a text is the list of its phrases.

Dictionary. Triggers that occur in one text only are dropped first. Of the rest each distinct
phrase is kept once, with the least id of a text that has it. All 50-byte strings around an
occurrence of a phrase in a text with a larger id are repeats: no byte of them is looked at. Only
phrases that share their trigger with other phrases are looked at byte by byte: for every
offset their suffixes, cut after 50 bytes, are put in order by 64-bit hashes, and suffixes side by side that are equal take the
least id.

Corpus order. The result asks which 50-byte strings of the corpus are equal, not which comes first. So no array
of the dictionary's suffixes or of the parse is built: equality by hash takes the place of their order, and a phrase with its
answer for each of the 25 offsets stands for all its places.

Triggers, phrases and suffixes meet by hash, in buckets; no bucket grows with the copies of a
text, as every chunk of texts sends each distinct entry once. A trigger that more than ``HOT_CHUNKS`` chunks
have, such as one of a very common line, may begin any number of phrases. Its phrases do not meet at the
trigger: the 50-byte strings around it meet by their own hashes, each once per chunk.

A missing text counts as empty. Texts of equal id, such as repeated rows, do not remove each other's
bytes. A missing id is larger than all others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import U64, byte_grams, covered, flat, inside, marked, mix, span_hash
from tidewright.llm.chunks import LAST, answered, answers, ask, bounds, chunked, ids, meet, packed, unpacked, unpacked_bits
from tidewright.llm.substrings import runs

LENGTH, TRIGGER = 50, 26
OFFSETS = LENGTH - TRIGGER + 1  # places at which a string can begin, counted back from a trigger in it
BEFORE, WIDTH = OFFSETS - 1, OFFSETS - 1 + LENGTH
#: Bytes of text in a chunk, and of those that are hashed at once; each takes some dozens of bytes then.
CHUNK_BYTES, BLOCK = 2 << 20, 1 << 18
_TRIGGERS = "bucket int, chunk int, prints binary, spread binary"
#: Chunks that may have a trigger whose phrases meet at one place.
HOT_CHUNKS = 64
_PHRASES = "bucket int, chunk int, triggers binary, phrases binary, ids binary, strings binary"
_SUFFIXES = "bucket int, chunk int, triggers binary, bytes binary, before binary, after binary, ids binary"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    reach = 1
    while 2 * reach <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    return best(values[:len(values) - (width - reach)], values[width - reach:]) if reach < width else values


def triggers(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions whose hash is the least of some 25 in a row that lie within 50 bytes of one text."""
    order = (hashes >> U64(32)).astype(np.uint32) | np.uint32(1)
    if len(order) < OFFSETS:  # no 50 bytes: what is left of a text or of a block is too short to begin a string
        return np.zeros(0, np.int64)
    least = _sliding(order, OFFSETS, np.minimum)
    least = np.where(inside(offsets, LENGTH)[:len(least)], least, np.uint32(0))
    padded = np.concatenate([np.zeros(BEFORE, np.uint32), least, np.zeros(BEFORE, np.uint32)])
    return np.flatnonzero(_sliding(padded, OFFSETS, np.maximum) == order)


def blocks(total: int, before: int, after: int):
    """(a, b, lo, hi): positions a to b, and what has to be seen of their surroundings."""
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        yield a, b, max(0, a - before), min(total, b + after)


def all_triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the triggers of all texts, found block by block."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for a, b, lo, hi in blocks(len(data), BEFORE, BEFORE + TRIGGER):
        here = byte_grams(data[lo:hi], TRIGGER)
        if len(here):
            texts = slice(max(0, np.searchsorted(offsets, lo, "right") - 1), np.searchsorted(offsets, hi, "left") + 1)
            found = triggers(data[lo:hi], np.clip(offsets[texts] - lo, 0, hi - lo), here)
            found = found[(found >= a - lo) & (found < b - lo)]
            at.append(found + lo)
            hashes.append(here[found])
    return np.concatenate(at), np.concatenate(hashes)


def content_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of ``data[begin:end]`` around ascending positions ``at``, block by block."""
    out = np.zeros(len(at), U64)
    for a, b, lo, hi in blocks(len(data), BEFORE, LENGTH):
        i, j = np.searchsorted(at, (a, b))
        if i < j:
            out[i:j] = span_hash(data[lo:hi].astype(U64) + U64(977), begin[i:j] - lo, end[i:j] - lo)
    return out


class _Chunk:
    """Triggers of one chunk, then its phrases, then those of its phrases whose suffixes are in question."""

    def __init__(self, texts: pa.Table, buckets: int):
        self.texts, self.buckets, self.id = texts, buckets, ids(texts)
        self.data, self.offsets = flat(texts.column("text"))
        self.at, self.hash = all_triggers(self.data, self.offsets)
        self.text = np.searchsorted(self.offsets, self.at, "right") - 1
        order = np.argsort(self.hash, kind="stable")
        ordered = self.hash[order]
        begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(ordered))
        self.distinct = ordered[begins]
        self.group = np.empty(len(ordered), np.int64)
        self.group[order] = np.repeat(np.arange(len(begins)), ends - begins)
        self.spread = self.text[order[begins]] != self.text[order[ends - 1]] if len(begins) else np.zeros(0, bool)
        self.edges = bounds(self.distinct, buckets)

    def phrases(self, code: np.ndarray) -> None:
        """Phrases of the triggers with code 1, and the strings around those with code 2."""
        self._strings(self.at[code[self.group] == 2])
        held = code[self.group] == 1
        self.at, self.text, self.hash = self.at[held], self.text[held], self.hash[held]
        self.before = np.minimum(BEFORE, self.at - self.offsets[self.text])
        self.after = np.minimum(LENGTH, self.offsets[self.text + 1] - self.at)
        content = content_hashes(self.data, self.at - self.before, self.at + self.after, self.at)
        content = mix(content ^ (self.before * 64 + self.after).astype(U64))
        own = self.id[self.text]
        order = np.lexsort((own, content, self.hash))
        a, b = self.hash[order], content[order]
        begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        self.phrase_hash, self.phrase, self.least = a[begins], b[begins], own[order[begins]]
        self.example = order[begins]
        self.of = np.empty(len(a), np.int64)
        self.of[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(a))))
        self.phrase_edges = bounds(self.phrase_hash, self.buckets)

    def _strings(self, at: np.ndarray) -> None:
        """Distinct 50-byte strings that hold one of the given triggers, with the least id, and where they begin."""
        self.begin = np.zeros(0, np.int64)
        if len(at):
            valid = inside(self.offsets, LENGTH)
            near = covered(marked(np.maximum(at - BEFORE, 0), len(self.data)), OFFSETS)
            self.begin = np.flatnonzero(near[:len(valid)] & valid)
        hashes = content_hashes(self.data, self.begin, self.begin + LENGTH, self.begin)
        self.begin_id = self.id[np.searchsorted(self.offsets, self.begin, "right") - 1]
        self.string, self.string_of = np.unique(hashes, return_inverse=True)
        self.string_least = np.full(len(self.string), LAST)
        np.minimum.at(self.string_least, self.string_of, self.begin_id)
        self.string_edges = bounds(self.string, self.buckets)

    def open(self, code: np.ndarray) -> None:
        """Phrases that no smaller id has, but whose trigger other phrases share."""
        self.first = (code & 1) == 0
        self.asked = np.flatnonzero(code == 2)
        self.asked_edges = bounds(self.phrase_hash[self.asked], self.buckets)

    def removed(self, masks: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Mask of the bytes that repeats cover."""
        whole = ~self.first[self.of] | (self.id[self.text] > self.least[self.of])
        per_phrase = np.zeros(len(self.phrase), np.uint32)
        per_phrase[self.asked] = masks
        starts = marked(self.begin[known[self.string_of] | (self.begin_id > self.string_least[self.string_of])], len(self.data))
        for back in range(OFFSETS):
            some = (self.before >= back) & (self.after >= LENGTH - back) & (
                whole | ((per_phrase[self.of] >> np.uint32(back)) & np.uint32(1)).astype(bool))
            starts[self.at[some] - back] = True
        return covered(starts, LENGTH)


def _number(texts: pa.Table) -> int:
    return texts.column("chunk")[0].as_py()


def _send_triggers(buckets: int):
    def run(texts, _):
        c = _Chunk(texts, buckets)
        return packed(_number(texts), c.edges, prints=c.distinct.astype("<u4"), spread=c.spread)
    return run


def _shared(rows: pa.Table) -> pa.Table:
    prints, sizes = unpacked(rows.column("prints"), "<u4")
    _, where = np.unique(prints, return_inverse=True)
    seen = np.bincount(where, 1 + unpacked_bits(rows.column("spread"), sizes))
    chunks = np.bincount(where)
    return answers(rows, 1, sizes, ((seen >= 2) + (chunks > HOT_CHUNKS)).astype(np.uint8)[where])


def _send_phrases(buckets: int):
    def run(texts, replies):
        c = _Chunk(texts, buckets)
        c.phrases(answered(replies, 1, c.edges, "u1"))
        phrases = packed(_number(texts), c.phrase_edges, triggers=c.phrase_hash.astype("<u8"),
                         phrases=c.phrase.astype("<u8"), ids=c.least.astype("<i8"))
        strings = packed(_number(texts), c.string_edges, strings=c.string.astype("<u8"), ids=c.string_least.astype("<i8"))
        # Strings have buckets of their own, numbered on from those of the phrases.
        own = pc.add(strings.column("bucket"), pa.scalar(buckets, pa.int32()))
        strings = strings.set_column(0, "bucket", own)
        return pa.concat_tables([phrases, strings], promote_options="default").select(
            ["bucket", "chunk", "triggers", "phrases", "ids", "strings"])
    return run


def _meet_second(buckets: int):
    def run(rows):
        return _known(rows) if rows.column("bucket")[0].as_py() < buckets else _repeated(rows, buckets)
    return run


def _repeated(rows: pa.Table, buckets: int) -> pa.Table:
    """For each string whether a smaller id has it."""
    string, sizes = unpacked(rows.column("strings"), "<u8")
    id = unpacked(rows.column("ids"), "<i8")[0]
    distinct, where = np.unique(string, return_inverse=True)
    least = np.full(len(distinct), LAST)
    np.minimum.at(least, where, id)
    own = pc.subtract(rows.column("bucket"), pa.scalar(buckets, pa.int32()))
    return answers(rows.set_column(rows.schema.get_field_index("bucket"), "bucket", own), 4, sizes, id > least[where])


def _known(rows: pa.Table) -> pa.Table:
    """Bit 1: a smaller id has the phrase. Bit 2: its trigger begins other phrases too."""
    trigger, sizes = unpacked(rows.column("triggers"), "<u8")
    phrase, id = unpacked(rows.column("phrases"), "<u8")[0], unpacked(rows.column("ids"), "<i8")[0]
    order = np.lexsort((id, phrase, trigger))
    t, p, i = trigger[order], phrase[order], id[order]
    new_t = np.concatenate([[True], t[1:] != t[:-1]])
    new_p = new_t | np.concatenate([[True], p[1:] != p[:-1]])
    first = i[np.flatnonzero(new_p)][np.cumsum(new_p) - 1]
    several = np.bincount(np.cumsum(new_t) - 1, new_p) > 1
    code = np.empty(len(order), np.uint8)
    code[order] = (i > first) + 2 * several[np.cumsum(new_t) - 1]
    return answers(rows, 2, sizes, code)


def _send_suffixes(buckets: int):
    def run(texts, replies):
        c = _Chunk(texts, buckets)
        c.phrases(answered(replies, 1, c.edges, "u1"))
        c.open(answered(replies, 2, c.phrase_edges, "u1"))
        at = c.example[c.asked]
        window = np.zeros((len(at), WIDTH), np.uint8)
        for a in range(0, len(at), HASHED_ROWS):
            reach = c.at[at[a:a + HASHED_ROWS]][:, None] + np.arange(-BEFORE, LENGTH)
            window[a:a + HASHED_ROWS] = c.data[np.clip(reach, 0, len(c.data) - 1)]
        return packed(_number(texts), c.asked_edges, triggers=c.phrase_hash[c.asked].astype("<u8"), bytes=window,
                      before=c.before[at].astype(np.uint8), after=c.after[at].astype(np.uint8), ids=c.least[c.asked].astype("<i8"))
    return run


#: Phrases whose suffixes are put in order at once, if no trigger has more, and of those that are hashed at once.
ORDERED_ROWS, HASHED_ROWS = 16_384, 4_096


def _ordered(rows: pa.Table) -> pa.Table:
    """For each phrase the offsets (bits) at which a smaller id has the same 50 bytes."""
    trigger, sizes = unpacked(rows.column("triggers"), "<u8")
    before, after, id = (unpacked(rows.column(c), k)[0] for c, k in (("before", "u1"), ("after", "u1"), ("ids", "<i8")))
    content = unpacked(rows.column("bytes"), "u1")[0].reshape(-1, WIDTH)
    masks = np.zeros(len(trigger), "<u4")
    order = np.argsort(trigger, kind="stable")
    begins = np.flatnonzero(np.diff(trigger[order], prepend=trigger[order][:1] ^ U64(1))) if len(order) else np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        # Whole triggers, as many as there is room for.
        upto = np.searchsorted(begins, at + ORDERED_ROWS, "right") - 1
        end = len(order) if at + ORDERED_ROWS >= len(order) else int(begins[upto])
        if end <= at:
            later = begins[begins > at]
            end = int(later[0]) if len(later) else len(order)
        own = order[at:end]
        masks[own] = _suffix_masks(trigger[own], content[own], before[own], after[own], id[own])
        at = end
    return answers(rows, 3, sizes, masks)


def _suffix_masks(trigger, content, before, after, id) -> np.ndarray:
    masks = np.zeros(len(trigger), np.uint32)
    suffixes = np.empty((OFFSETS, len(trigger)), U64)
    for a in range(0, len(trigger), HASHED_ROWS):
        part = content[a:a + HASHED_ROWS]
        begin = np.arange(len(part)) * WIDTH + BEFORE - np.arange(OFFSETS)[:, None]
        suffixes[:, a:a + HASHED_ROWS] = span_hash(part.astype(U64).ravel() + U64(977), begin, begin + LENGTH)
    for back in range(OFFSETS):
        some = np.flatnonzero((before >= back) & (after >= LENGTH - back))
        if not len(some):
            continue
        order = np.lexsort((id[some], suffixes[back][some], trigger[some]))
        t, s, i = trigger[some][order], suffixes[back][some][order], id[some][order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        masks[some[order[i > least]]] |= np.uint32(1 << back)
    return masks


def _cut(buckets: int):
    def run(texts, replies):
        c = _Chunk(texts, buckets)
        c.phrases(answered(replies, 1, c.edges, "u1"))
        c.open(answered(replies, 2, c.phrase_edges, "u1"))
        gone = c.removed(answered(replies, 3, c.asked_edges, "u4"), answered(replies, 4, c.string_edges))
        spans, kept, removed = [], [], []
        for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True):
            own, text = gone[a:b], c.data[a:b]
            removed.append(int(own.sum()))
            spans.append([{"start": int(x), "stop": int(y)} for x, y in runs(own)] if removed[-1] else [])
            kept.append((text[~own] if removed[-1] else text).tobytes())
        return pa.table({
            "doc_id": texts.column("doc_id"), "n_bytes": pa.array(np.diff(c.offsets), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            "kept": pa.array(kept, pa.binary())})
    return run


def remove_known_bytes(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes and their ``spans``, and the ``kept`` bytes."""
    texts, buckets = chunked(df, id, text, CHUNK_BYTES)
    shared = meet(ask(texts, None, _send_triggers(buckets), _TRIGGERS), _shared)
    known = shared.unionByName(meet(ask(texts, shared, _send_phrases(buckets), _PHRASES), _meet_second(buckets)))
    ordered = known.unionByName(meet(ask(texts, known, _send_suffixes(buckets), _SUFFIXES), _ordered))
    return ask(texts, ordered, _cut(buckets), RESULT)


def report(df: DataFrame) -> DataFrame:
    return remove_known_bytes(df).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
