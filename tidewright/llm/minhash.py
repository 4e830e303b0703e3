"""MinHash near-duplicates with an LSH forest (operator 10).

Documents are linked if the Jaccard similarity of their sets of word shingles reaches a
threshold; every link is confirmed on the full sets. Rows with equal sets are one node from
the start, so a group of copies costs one row however large it is.

Forest. Every node has ``TREES`` keys, each a sequence of minimum hashes. Sorted by
such a key, nodes that share a longer prefix stand closer, so a prefix names a region of
neighbours. A region begins at the least depth; while it has more than ``REGION`` nodes it
is divided by the next hashes of the sequence, so crowded regions become deep and sparse
ones stay shallow. What equal prefixes of the greatest depth still hold together is dealt by a
hash of the node, another one in each tree. That connects most of a crowd, but parts some that are linked.

Crowds. So all nodes that lay in a region of more than ``REGION`` at the least depth are joined exactly. Shingles are put
in one order, rare ones first. Of two linked sets, the smaller has one of their common shingles among its first few, the larger
among a few more; how many follows from the sizes and the threshold. Nodes that share such a shingle meet, however many
they are: a crowd is dealt to parts, and of the parts every two meet, other than those in which all are connected already.

Links. Within a region the signatures tell which nodes might be linked though they are not
connected yet; only those fetch their full sets, in groups that might hang together. A group that several
regions have is looked at once: all pairs in it are compared by one matrix product. Of the links found a forest is kept. A first wave of trees connects most
groups; the second wave, of the other trees, and the third, of the crowds, only look at regions in
which unconnected candidates are left.

At the least depth d and t trees a pair of similarity s is missed with chance (1 - s^d)^t,
3e-5 at 0.85 with 18 trees and 7e-5 at 0.8 with 24.

A missing text has no words; such rows and texts without words are linked with nothing.
Repeated rows and ids are allowed: each input row gives one row. A missing id is never
the id of a component unless the component has no other, and then that id is missing too. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.arrowtext import U64, forget, gram_hashes, mix, pieces, span_hash, words
from tidewright.llm.components import components, partial_components
from tidewright.session import materialize

#: Hashes of a tree's prefix at its least depth, and further hashes at each step into a crowded region.
DEPTH, STEPS = 5, (3, 7, 11)
#: Nodes of a region at most, before it is divided.
REGION = 128
#: Minimum hashes of a signature; the trees use them in turn.
HASHES = 128
#: Standard errors below the threshold down to which an estimate makes a candidate.
ERRORS = 4.5
#: Bits of the filter by which texts are chosen, at most: 8 MB.
FILTER_BITS = 1 << 26
#: Trees of the first wave.
FIRST = 4
#: Leading bits of a shingle's hash by which it is counted: a megabyte of counts.
COUNT_BITS = 20
#: Kinds of nodes that have to meet in a crowd, see ``_paired``.
_MEET = {0: (1, 3), 1: (0, 1, 2, 3), 2: (1,), 3: (0, 1)}
_rng = np.random.default_rng(987654321)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | U64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    found = words(column, lower=True)
    hashes, first = found.hashes(), found.first
    grams = gram_hashes(hashes, size)
    sets = []
    for d in range(len(first) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            sets.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            sets.append(span_hash(hashes[a:b], np.array([0]), np.array([b - a])))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> U64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(low, (_A * short[at:at + 4096] + _B).min(axis=1), out=low)
    return low


def _node(shingles: np.ndarray) -> bytes:
    return np.array([mix(shingles).sum(dtype=U64), mix(shingles * U64(0xD6E8FEB86659FD93)).sum(dtype=U64)], "<u8").tobytes()


def signatures(df: DataFrame, size: int, trees: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles``, ``node`` (digest of the set), ``keys`` (one per tree) and ``sig``."""
    schema = "doc_id long, text_hash long, n_shingles long, node binary, keys array<long>, sig binary"
    picks = np.arange(trees)[:, None] * DEPTH + np.arange(DEPTH)

    def run(batches):
        forget()
        for batch in pieces(batches):
            sets = shingle_sets(batch.column(2), size)
            low = np.stack([minimum_hashes(s) for s in sets]) if sets else np.zeros((0, HASHES), np.uint32)
            key = np.zeros((len(sets), trees), U64) + np.arange(1, trees + 1, dtype=U64)
            for level in range(DEPTH):
                key = mix(key * U64(0x2545F4914F6CDD1D) + low[:, picks[:, level] % HASHES])
            short = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_node(s) for s in sets], pa.binary()), pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                pa.array([row.tobytes() for row in short], pa.binary())], names=[f.split()[0] for f in schema.split(", ")])

    return df.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def full_sets(rows: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """``node`` and ``shingles`` (sorted, packed) of the rows that pass the bitmap ``wanted``."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    probe = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(64 * len(wanted)))

    def run(batches):
        for batch in pieces(batches):
            at = batch.column(0).to_numpy()
            held = (sent.value[at // 64] >> (at % 64).astype(U64)) & U64(1)
            batch = batch.filter(pa.array(held.astype(bool)))
            if batch.num_rows:
                sets = shingle_sets(batch.column(1), size)
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.array(
                    [s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return rows.select(probe.alias("probe"), "text").mapInArrow(run, "node binary, shingles binary")


def _shared(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` occurs again, with the number ``n`` of rows that have it.

    The counts are written first, so that both sides of the join are tables.
    """
    counts = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "region-sizes")
    return rows.join(counts.withColumnRenamed("key", "its key"), F.col("key") == F.col("its key")).drop("its key")


def _shared_keys(nodes: DataFrame) -> DataFrame:
    """``node``, ``tree``, ``key`` and ``n``, as ``_shared``, of all keys of ``nodes``.

    Most keys are a single node's. A bitmap of the others keeps most of these from the shuffle; the join decides.
    """
    counts = materialize(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "region-sizes")
    bitmap = _bitmap(counts.select(F.col("key").alias("h")))
    sent = nodes.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            keys = batch.column(1)
            tree = np.arange(len(keys.flatten())) - np.repeat(keys.offsets.to_numpy()[:-1] - keys.offsets[0].as_py(), keys.value_lengths().to_numpy())
            at = keys.flatten().to_numpy() % (64 * len(sent.value))
            held = np.flatnonzero((sent.value[at // 64] >> (at % 64).astype(U64)) & U64(1))
            owner = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[held])), pa.array(tree[held].astype(np.int32)),
                                              keys.flatten().take(pa.array(held))], names=["node", "tree", "key"])

    rows = nodes.select("node", "keys").mapInArrow(run, "node binary, tree int, key long")
    return rows.join(counts.withColumnRenamed("key", "its key"), F.col("key") == F.col("its key")).drop("its key")


def regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions (``tree``, ``key``, ``node``, ``sig``) of all trees, and the nodes (``node``, ``sig``) that lay crowded."""
    rows = _shared_keys(nodes)
    rows = rows.join(nodes.select(F.col("node").alias("its node"), "sig"), F.col("node") == F.col("its node")).drop("its node")
    # The hashes that follow those of the key in the signature, which begins again at its end.
    at = (F.col("tree") * DEPTH + DEPTH) % HASHES + 1
    path = F.substring(F.concat("sig", "sig"), at, F.lit(STEPS[-1]))
    rows = materialize(rows.withColumn("path", path), "regions")
    return _divided(rows, 0, STEPS), rows.where(F.col("n") > REGION).select("node", "sig").distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """For each class of shingles (``COUNT_BITS`` leading bits) a number that grows with its occurrences; 0: one at most."""
    def run(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in pieces(batches):
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            total += np.bincount((held >> U64(64 - COUNT_BITS)).view(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = sets.select("shingles").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1") \
        .select(F.col("at").cast("int"), (1 + F.floor(8 * F.log2("n"))).cast("short").alias("level")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.uint8)
    out[found.column("at").to_numpy()] = found.column("level").to_numpy()
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``node``, ``key`` (a shingle) and ``first``: the shingles by which a node meets those its set may be linked to.

    In one order of all shingles, a set of n that shares c with another has one of these among its first n - c + 1. With
    sets no smaller than itself it shares 2pn / (100 + p) at least, which makes the ``first``; with any, pn / 100.
    """
    levels = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches):
        for batch in pieces(batches):
            keys, first, counts = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
            for packed in batch.column(1).to_pylist():
                own = np.frombuffer(packed, "<u8")
                n, level = len(own), levels.value[(own >> U64(64 - COUNT_BITS)).view(np.int64)]
                order = np.argsort(level, kind="stable")[:n + -percent * n // 100 + 1]
                some = level[order] > 0  # others have nobody to share them with
                keys.append(own[order][some].view(np.int64))
                first.append((np.arange(len(order)) <= n + -2 * percent * n // (100 + percent))[some])
                counts.append(len(keys[-1]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(np.concatenate(keys)),
                pa.array(np.concatenate(first))], names=["node", "key", "first"])

    return sets.select("node", "shingles").mapInArrow(run, "node binary, key long, first boolean")


def exact_regions(rows: DataFrame, nodes: DataFrame, crowded: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Regions (``key``, ``node``, ``sig``, ``root``) in which all crowded nodes meet that may be linked and that ``labels`` do not connect."""
    rooted = materialize(_rooted(crowded, labels), "rooted")
    sets = _sets(rows, nodes, crowded, size).join(crowded.select(F.col("node").alias("its node")), F.col("node") == F.col("its node"))
    held = materialize(_prefixes(materialize(sets.select("node", "shingles"), "sets"), percent), "prefixes")
    # Shingles that the same nodes have in common make one region.
    counts = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("some"), F.bit_xor(F.xxhash64("node", "first")).alias("who"))
    counts = materialize(counts.where("n > 1 AND some").groupBy("n", "who").agg(F.min("key").alias("its key")).drop("who"), "region-sizes")
    met = held.join(counts, F.col("key") == F.col("its key")).drop("its key")
    roots = rooted.select(F.col("node").alias("its node"), "root")
    met = materialize(met.join(roots, F.col("node") == F.col("its node")).drop("its node"), "met")
    several = materialize(met.groupBy(F.col("key").alias("its key")).agg(F.min("root").alias("a"), F.max("root").alias("b"))
                          .where("a < b").select("its key"), "several-roots")
    met = materialize(met.join(several, F.col("key") == F.col("its key")).drop("its key"), "unconnected")
    found, crowds = met.where(F.col("n") <= REGION).select("key", "node"), met.where(F.col("n") > REGION)
    if not crowds.isEmpty():
        found = found.unionByName(_paired(crowds))
    return found.join(rooted.withColumnRenamed("node", "its node"), F.col("node") == F.col("its node")).drop("its node")


def _paired(rows: DataFrame) -> DataFrame:
    """(``key``, ``node``): rows (key, node, first, root) of crowds dealt to parts of ``REGION``, with a new key for every two that have to meet.

    Of two nodes one has to hold the key among its ``first``, and not both may belong to the crowd's greatest component:
    its nodes are of the kinds 0 and 2, all others 1 and 3, the latter of each without ``first``.
    """
    main = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("key").alias("its key")).agg(F.max_by("root", "n").alias("main"))
    kind = F.when(F.col("root") == F.col("main"), 0).otherwise(1) + F.when(F.col("first"), 0).otherwise(2)
    rows = materialize(rows.join(materialize(main, "main-roots"), F.col("key") == F.col("its key")).select("key", "node", kind.alias("kind")), "kinds")
    parts = materialize(rows.groupBy(F.col("key").alias("its key")).agg(*(
        F.ceil(F.count_if(F.col("kind") == k) / REGION).cast("long").alias(f"parts{k}") for k in _MEET)), "parts")
    rows = rows.join(parts, F.col("key") == F.col("its key"))

    base = {k: F.lit(k << 32).cast("long") for k in _MEET}
    own = F.coalesce(*(F.when(F.col("kind") == k, base[k] + F.pmod(F.xxhash64("node"), F.col(f"parts{k}"))) for k in _MEET))
    others = F.concat(*(F.when(F.col("kind").isin(*_MEET[k]) & (F.col(f"parts{k}") > 0), F.sequence(base[k], base[k] + F.col(f"parts{k}") - 1))
                        .otherwise(F.array().cast("array<long>")) for k in _MEET))
    rows = rows.select("key", "node", own.alias("own"), F.explode(others).alias("other"))
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node")


def _divided(rows: DataFrame, begin: int, steps: tuple[int, ...]) -> DataFrame:
    """Regions of rows (key, node, sig, path, n): crowded ones are divided by ever more hashes of the path.

    Keys hold ``begin`` hashes of the path; each step makes it so many. Linked nodes that are parted here meet in ``exact_regions``.
    """
    found = [rows.where(F.col("n") <= REGION)]
    rest = rows.where(F.col("n") > REGION)
    for upto in steps:
        if rest.isEmpty():
            return _united(found)
        deeper = F.xxhash64("key", F.substring("path", begin + 1, upto - begin))
        rows = materialize(_shared(rest.drop("n").withColumn("key", deeper)), "regions")
        found.append(rows.where(F.col("n") <= REGION))
        rest, begin = rows.where(F.col("n") > REGION), upto
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") * 2 / REGION).cast("long"))
    found.append(rest.withColumn("key", F.xxhash64("key", part)))
    return _united(found)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("tree", "key", "node", "sig")
    for p in parts[1:]:
        out = out.unionByName(p.select("tree", "key", "node", "sig"))
    return out


def _groups(near: np.ndarray) -> np.ndarray:
    """For each node the least one that it hangs together with by the symmetric matrix ``near``."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _candidates(share: float):
    """For ``mapInArrow``: of each region the nodes that may be linked to one of another component.

    Each group that may hang together has a key of its own, which is the same in all regions that hold the same group.
    """
    least = HASHES * (share - ERRORS * (share * (1 - share) / HASHES) ** 0.5)

    def run(batches):
        for batch in pieces(batches):
            out = ([], [], [])
            for members in batch.column(0).to_pylist():
                sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(len(members), -1)
                root = np.array([m["root"] for m in members], object)
                near = np.stack([(sig == row).sum(1) for row in sig]) >= least
                near &= root[:, None] != root
                some = np.flatnonzero(near.any(1))
                if not len(some):
                    continue
                own = np.frombuffer(b"".join(members[i]["node"] for i in some), "<u8").reshape(len(some), 2)
                digest, label = mix(own[:, 0] ^ mix(own[:, 1])), _groups(near[np.ix_(some, some)])
                key = np.zeros(len(some), U64)
                np.add.at(key, label, digest)
                out[0].extend(mix(key[label]).view(np.int64).tolist())
                out[1].extend(members[i]["node"] for i in some)
                out[2].extend(members[i]["root"] for i in some)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                                              pa.array(out[2], pa.binary())], names=["key", "node", "root"])
    return run


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by a matrix product over blocks of the shingles that occur again."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = n > 1
    column = np.cumsum(again) - 1
    held = again[where]
    owner, where = owner[held], column[where[held]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    columns = int(again.sum())
    step = max(1, min(columns, (1 << 22) // len(sets)))
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for low in range(0, columns, step):
        a, b = np.searchsorted(where, (low, low + step))
        held = np.zeros((len(sets), step), np.float32)
        held[owner[a:b], where[a:b] - low] = 1
        out += np.rint(held @ held.T).astype(np.int64)
    out[np.arange(len(sets)), np.arange(len(sets))] = [len(s) for s in sets]
    return out


def _links(percent: int):
    """For ``mapInArrow``: a forest of the confirmed links of each region between different components."""
    def run(batches):
        for batch in pieces(batches):
            a, b = [], []
            for members in batch.column(1).to_pylist():
                sets = [np.frombuffer(m["shingles"], "<u8") for m in members]
                sizes = np.array([len(s) for s in sets])
                both = common(sets)
                linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
                root = {m["root"]: m["root"] for m in members}

                def top(x, root=root):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
                    x, y = top(members[i]["root"]), top(members[j]["root"])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(members[i]["node"])
                        b.append(members[j]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
    return run


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, trees: int = 24) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_shingles`` and ``component_id`` of every row of ``df`` (doc_id, text).

    ``component_id`` is the least id that can be reached over links, the own id included.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(rows, size, trees), "signatures")
    nodes = materialize(signed.where("n_shingles > 0").dropDuplicates(["node"]), "nodes")
    found, crowded = regions(nodes)
    crowded = materialize(crowded, "crowded")
    links = _confirmed(rows, nodes, found.where(F.col("tree") < FIRST).withColumn("root", F.col("node")), size, percent)
    others = _rooted(found.where(F.col("tree") >= FIRST), partial_components(links))
    labels = components(links.unionByName(_confirmed(rows, nodes, others, size, percent)))
    if not crowded.isEmpty():
        links = _confirmed(rows, nodes, exact_regions(rows, nodes, crowded, labels, size, percent), size, percent)
        if not links.isEmpty():
            labels = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return _labelled(signed, labels)


def _rooted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of each node, which is the node itself if nothing is linked with it."""
    labels = labels.withColumnRenamed("node", "its node")
    return rows.join(labels, F.col("node") == F.col("its node"), "left").withColumn("root", F.coalesce("root", "node")).drop("its node")


def _confirmed(rows: DataFrame, nodes: DataFrame, found: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) within the regions ``found`` (key, node, sig, root) between nodes of different roots."""
    grouped = found.groupBy("key").agg(F.collect_list(F.struct("node", "sig", "root")).alias("members"))
    asked = grouped.select("members").mapInArrow(_candidates(percent / 100), "key long, node binary, root binary")
    asked = materialize(asked.dropDuplicates(["key", "node"]), "candidates")
    # The sets are dealt by node once, for the copies among them as for the join.
    sets = _sets(rows, nodes, asked, size).withColumnRenamed("node", "its node")
    filled = asked.join(sets, F.col("node") == F.col("its node"))
    return materialize(filled.groupBy("key").agg(F.collect_list(F.struct("node", "shingles", "root")).alias("members"))
                       .mapInArrow(_links(percent), "a binary, b binary"), "links")


def _sets(rows: DataFrame, nodes: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """Full sets of the nodes in ``asked``, from the text that stands for each, and of some others that the filter lets pass."""
    wanted = asked.select(F.col("node").alias("its node")).distinct()
    one = nodes.join(wanted, F.col("node") == F.col("its node"), "left_semi")
    one = materialize(one.select(F.xxhash64("doc_id", "text_hash").alias("h")), "wanted")
    return full_sets(rows, size, _bitmap(one)).dropDuplicates(["node"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash (``h``), folded into 8 MB at most: a filter that lets all of them pass and few others.

    With more hashes than it has bits it lets everything pass, which costs time alone.
    """
    bits = 64
    n = hashes.count()
    while bits < min(64 * n, FILTER_BITS):
        bits *= 2
    at = F.pmod("h", F.lit(bits))
    found = hashes.groupBy((at / 64).cast("long").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("b")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in found:
        out[r.w] = r.b
    return out.view(U64)


def _labelled(signed: DataFrame, labels: DataFrame) -> DataFrame:
    least = signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = materialize(least.join(labels.withColumnRenamed("node", "its node"), F.col("node") == F.col("its node"), "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")), "placed")
    ids = materialize(placed.groupBy(F.col("root").alias("its root")).agg(F.min("least").alias("component_id")), "component-ids")
    by_node = materialize(placed.join(ids, F.col("root") == F.col("its root")).select(
        F.col("node").alias("its node"), "component_id"), "by-node")
    own = signed.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    alone = own.where("node IS NULL").withColumn("component_id", F.col("doc_id"))
    known = own.where("node IS NOT NULL").join(by_node, F.col("node") == F.col("its node"))
    columns = ("doc_id", "text_hash", "n_shingles", "node", "component_id")
    return known.select(*columns).unionByName(alone.select(*columns))


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def report(df: DataFrame) -> DataFrame:
    found = near_duplicates(df, size=3, percent=85, trees=18)
    return found.select("doc_id", "n_shingles", "component_id", kept().alias("kept"))


def drop_near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, trees: int = 24) -> DataFrame:
    """One row of each group, all columns: the one with the least id. Rows without words all stay."""
    found = near_duplicates(df, size, percent, trees).where(kept())
    group = ("component_id", F.when(F.col("component_id").isNull(), F.col("node")))
    same_row = found.where("node IS NOT NULL").groupBy(*group, "text_hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = same_row.groupBy(*same_row.columns[:2]).agg(F.min(F.struct("text_hash", "n")).alias("one")).select(
        F.col("component_id").alias("its id"), F.col("one.text_hash").alias("its hash"), F.col("one.n").alias("n"))
    wordless = found.where("node IS NULL").select(
        F.col("doc_id").alias("its id"), F.col("text_hash").alias("its hash"), F.lit(1).cast("long").alias("n")).distinct()
    one = materialize(chosen.unionByName(wordless), "kept")
    rows = df.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                     F.xxhash64(F.col("text").cast("string")).alias("h"))
    same = F.col("id").eqNullSafe(F.col("its id")) & (F.col("h") == F.col("its hash"))
    out = rows.join(one.where("n = 1"), same, "left_semi").select("row.*")
    repeated = one.where("n > 1")
    if repeated.isEmpty():
        return out
    again = rows.join(repeated, same, "left_semi").dropDuplicates(["id", "h"])
    return out.unionByName(again.select("row.*"))
