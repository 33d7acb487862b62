"""Near duplicates by SimHash: a binary trie of fingerprints is joined with itself under a Hamming budget.

Only distinct fingerprints are joined. By the pigeonhole principle, two that differ in at most ``bits`` places agree
on one of ``bits + 1`` blocks, so each is dealt to the subtrees of its blocks, each a trie whose first bits are that
block. A subtree of too many fingerprints is not capped: its free bits are cut into blocks again, and so on; once
sixteen bits are free it holds 65,536 at most. Inside a subtree node pairs descend together, differing bits add up, and
a pair over budget is dropped. Of the links found only a spanning forest leaves the task.

A budget wide enough for all near copies prunes little of a trie, and also joins texts that only resemble each other.
``keep_first_alike`` asks for alike word shingles by Jaccard as well, so it compares fingerprints only of texts that share
one of their first shingles in the order of hashes, as any two that are alike enough do. The groups joined so are
candidates: only pairs inside them whose shingles are alike enough are linked; a group of any size is confirmed in parts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIGHEST, as_null, narrow, null_as, released, store, whole
from .components import connected

SHINGLE, BITS, SEED = 3, 2, 42
#: Words of a compared shingle, and the Jaccard similarity that makes two texts near copies.
WORDS, SHARE = 5, 0.8
#: Fingerprints in a subtree beyond which it is divided again.
SUBTREE = 1 << 16
#: Node pairs that descend together; more wait on a stack.
FRONTIER = 1 << 18
#: A leaf of a trie holds no more fingerprints; its members are compared directly, so many pairs at a time.
LEAF, PAIRS = 64, 1 << 18
#: Fingerprints of texts with one shingle that are compared pair by pair, and beyond which they go to the trie of all such.
FEW, MANY = 16, 1 << 14
#: Texts whose shingles one task compares with as many others.
BLOCK = 256

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint; zero without words."""
    words = _WORD.findall(text.encode("utf-8").translate(_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), max(len(words) - shingle + 1, 1)
    for at in range(0, total, 1 << 16):  # bounded working memory for any length
        some = words[at : at + (1 << 16) + shingle - 1]
        pieces = zip(*(some[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        hashes = np.array([digest(b" ".join(p), SEED) for p in pieces], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """``(id, mark, fp)`` of ``rows (id, text, mark)``."""

    def run(batches):
        for batch in batches:
            fps = np.array([simhash(x.as_py(), shingle) for x in batch.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("id"), batch.column("mark"), pa.array(fps)], names=["id", "mark", "fp"])

    return rows.mapInArrow(released(run), f"id long, mark {rows.schema['mark'].dataType.simpleString()}, fp long")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """``(id, mark, fp)`` per row: ``mark`` hashes the text, ``fp`` is the fingerprint as a signed long."""
    rows = narrow(docs, id=null_as(doc_id, HIGHEST), text=whole(text)).withColumn("mark", F.xxhash64("text"))
    return _fingerprints(rows, shingle)


def _leaf_pairs(values: np.ndarray, pairs: np.ndarray, bits: int):
    """Members of leaves of a trie that are within ``bits`` places, so many leaf pairs at a time."""
    span, step = np.arange(LEAF), max(1, PAIRS // LEAF**2)
    for at in range(0, len(pairs), step):
        a0, a1, b0, b1, _ = (x[:, None] for x in pairs[at : at + step].T)
        left, right = a0 + span, b0 + span
        ours, theirs = (values[np.minimum(x, len(values) - 1)] for x in (left, right))
        near = np.bitwise_count(ours[:, :, None] ^ theirs[:, None, :]) <= bits
        near &= (left < a1)[:, :, None] & (right < b1)[:, None, :] & (left[:, :, None] < right[:, None, :])
        k, i, j = np.nonzero(near)
        if len(k):
            yield left[k, i], right[k, j]


def linked_pairs(values: np.ndarray, bits: int):
    """Index pairs of a sorted array of distinct uint64 within ``bits`` differing places, in blocks.

    A node is a range of the sorted array, a leaf one of at most ``LEAF`` values; both nodes of a pair are at the same
    depth. A prefix sum of each bit tells where a range divides.
    """
    n = len(values)
    ones = np.zeros((64, n + 1), dtype=np.int32)
    for bit in range(64):
        np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), out=ones[bit, 1:])
    depths = [d for d in range(64) if 0 < ones[d, n] < n]  # other bits are the same in all
    stack = [(0, np.array([[0, n, 0, n, 0]], dtype=np.int32))]
    while stack:
        at, pairs = stack.pop()
        leaves = (pairs[:, 1] - pairs[:, 0] <= LEAF) & (pairs[:, 3] - pairs[:, 2] <= LEAF)
        yield from _leaf_pairs(values, pairs[leaves], bits)
        pairs = pairs[~leaves]
        if not len(pairs):
            continue
        if len(pairs) > FRONTIER:
            stack += [(at, pairs[i : i + FRONTIER]) for i in range(0, len(pairs), FRONTIER)]
            continue
        count = ones[depths[at]]
        a0, a1, b0, b1, d = pairs.T
        a, b = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = a0 == b0
        below = [(a0, a, b0, b, d), (a, a1, b, b1, d), (a0, a, b, b1, d + 1)]
        children = [np.stack(x, axis=1) for x in below]
        children.append(np.stack((a, a1, b0, b, d + 1), axis=1)[~same])  # a self pair meets this one already
        children = np.concatenate(children)
        alive = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= bits)
        children = children[alive]
        if len(children):
            stack.append((at + 1, children))


def spanning_links(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(value, smallest value linked to it)`` within one subtree, one row per value that has a link."""
    values = np.unique(values)
    root = np.arange(len(values))
    for left, right in linked_pairs(values, bits):
        while True:
            a, b = root[left], root[right]
            apart = a != b
            if not apart.any():
                break
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    moved = root != np.arange(len(values))
    return values[moved], values[root[moved]]


def blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the free bits of a mask into as many nearly equal runs."""
    bits = [b for b in range(64) if free >> b & 1]
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, bits: int = BITS, subtree: int = SUBTREE) -> DataFrame:
    """``(src, dst)``: links that join all distinct ``fp`` within ``bits`` places, directly or by others as near."""
    if bits == 0:
        return fps.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).filter("false")

    def run(batches):
        def flush(groups, values):
            starts = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)])
            out = []
            for lo, hi in zip(starts, np.r_[starts[1:], len(groups)]):
                if hi - lo > 1:
                    out.append(spanning_links(values[lo:hi], bits))
            src = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
            dst = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.uint64)
            return pa.record_batch([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

        rest_g, rest_v = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            g = np.stack([batch.column("fixed").to_numpy(), batch.column("node").to_numpy()], axis=1)
            v = batch.column("fp").to_numpy().view(np.uint64)
            g, v = np.concatenate([rest_g, g]), np.concatenate([rest_v, v])
            if not len(g):
                continue
            last = len(g) - int(np.argmax((g[::-1] != g[-1]).any(axis=1))) if (g != g[-1]).any() else 0
            if last:
                yield flush(g[:last], v[:last])
            rest_g, rest_v = g[last:], v[last:]
        if len(rest_g):
            yield flush(rest_g, rest_v)

    found = None
    frees = [(1 << 64) - 1]
    level = fps.select("fp").distinct()
    level = level.withColumn("free", F.lit(-1).cast("long"))
    while True:
        parts = {}  # at most (bits + 1)^7 masks: each division leaves bits/(bits + 1) of the free bits
        for free in frees:
            parts[free] = blocks(free, bits + 1)
        table = [(_signed(f), [(_signed(((1 << 64) - 1) & ~(f & ~m)), _signed(f & ~m)) for m in ms]) for f, ms in parts.items()]
        spark = fps.sparkSession
        masks = spark.createDataFrame(table, "free long, into array<struct<fixed: long, free: long>>")
        dealt = (
            level.join(F.broadcast(masks), "free")
            .select("fp", F.explode("into").alias("x"))
            .select("fp", "x.fixed", "x.free", F.col("fp").bitwiseAND(F.col("x.fixed")).alias("node"))
        )
        dealt = store(dealt.distinct() if found is not None else dealt, "simhash-dealt")
        sizes = store(dealt.groupBy("fixed", "node").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
        fit = dealt.join(sizes.filter(f"n <= {subtree}").select("fixed", "node"), ["fixed", "node"])
        fit = fit.repartition("fixed", "node").sortWithinPartitions("fixed", "node").select("fixed", "node", "fp")
        some = store(fit.mapInArrow(run, "src long, dst long").distinct(), "simhash-links")
        found = some if found is None else found.unionByName(some)
        large = sizes.filter(f"n > {subtree}").select("fixed", "node")
        if large.isEmpty():
            return found
        level = dealt.join(large, ["fixed", "node"]).select("fp", "free")
        frees = sorted({f & ~m for f, ms in parts.items() for m in ms})


def near_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = BITS, subtree: int = SUBTREE
) -> DataFrame:
    """``(id, mark, fp, component)`` per row: the smallest id whose fingerprint is reachable by links.

    A missing text is empty; texts without words share the fingerprint zero; a missing id counts as the largest
    (``HIGHEST``); rows that repeat an id are rows of their own. An empty table gives none.
    """
    rows = store(fingerprints(docs, text, doc_id, shingle), "simhash-fingerprints")
    known = store(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-distinct")
    roots = connected(links(known, bits, subtree)).select(F.col("node").alias("fp"), "root")
    rooted = store(known.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-rooted")
    least = store(rooted.groupBy("root").agg(F.min("first").alias("component")), "simhash-least")
    named = store(rooted.join(least, "root").select("fp", "component"), "simhash-named")
    return rows.join(named, "fp").select("id", "mark", "fp", "component")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The input's rows and columns with one document, that of the smallest id, of each group of near duplicates."""
    classes = near_classes(docs, text, doc_id, shingle, bits)
    stays = classes.filter("id = component").groupBy("component").agg(F.min("mark").alias("mark"))
    stays = stays.select(F.struct(F.col("component").alias("id"), "mark").alias("key"))
    rows = docs.select(F.struct("*").alias("row"), F.struct(null_as(doc_id, HIGHEST).alias("id"), F.xxhash64(whole(text)).alias("mark")).alias("key"))
    return rows.join(stays, "key").dropDuplicates(["key"]).select("row.*")


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of so many words; of all words if there are fewer."""
    found = _WORD.findall(text.encode("utf-8").translate(_LOWER))
    if not found:
        return np.zeros(0, "<u8")
    pieces = zip(*(found[i:] for i in range(words))) if len(found) >= words else [found]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in pieces], dtype="<u8"))


def alike(one: np.ndarray, other: np.ndarray, share: float = SHARE) -> bool:
    """Whether the Jaccard similarity of two shingle sets reaches the share; texts without words are equal."""
    least, most = sorted((len(one), len(other)))
    if most == 0:
        return True
    if least / most < share:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (least + most - both) >= share


def alike_links(
    fps: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, label: np.ndarray, bits: int, share: float = SHARE
) -> list[tuple[int, int]]:
    """Index pairs that join all texts linked within ``bits`` places and alike.

    Texts of one ``label`` are joined already; labels grow together in place, and joined texts are not compared. With
    two sides only pairs across them count.
    """
    out, across = [], len(np.unique(sides)) > 1
    for i in range(len(fps) - 1):
        near = (np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) & (label[i + 1 :] != label[i])
        if across:
            near &= sides[i + 1 :] != sides[i]
        for j in np.flatnonzero(near) + i + 1:
            if label[j] != label[i] and alike(sets[i], sets[j], share):
                label[label == label[j]] = label[i]
                out.append((i, int(j)))
    return out


def _first_shingles(rows: DataFrame, words: int, share: float) -> DataFrame:
    """``(id, mark, fp, runs)`` of ``rows (id, text, mark)``: ``runs`` are the first shingles by hash.

    Two sets whose Jaccard similarity is ``share`` have that share of each in common at least; so the first of what they
    have in common is among the first of either, without the last ``share`` of its shingles but one.
    """

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            fps = np.array([simhash(x) for x in texts], dtype=np.uint64).view(np.int64)
            first = []
            for text in texts:
                found = shingles(text, words)
                first.append(found[: len(found) - math.ceil(share * len(found) - 1e-9) + 1])
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*first, np.zeros(0, "<u8")]).view(np.int64)))
            yield pa.record_batch([batch.column("id"), batch.column("mark"), pa.array(fps), runs], names=["id", "mark", "fp", "runs"])

    return rows.mapInArrow(released(run), "id long, mark binary, fp long, runs array<long>")


def _near_in_groups(groups: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct values within ``bits`` places in sorted groups, of large ones only as many as join the same."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    size, out = np.repeat(sizes, sizes), [(np.zeros(0, np.uint64),) * 2]
    place = np.arange(len(groups)) - np.repeat(starts, sizes)
    for lag in range(1, FEW):
        at = np.flatnonzero((size <= FEW) & (place + lag < size))
        if not len(at):
            break
        at = at[np.bitwise_count(values[at] ^ values[at + lag]) <= bits]
        out.append((values[at + lag], values[at]))
    for lo, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        out.append(spanning_links(values[lo : lo + n], bits))
    found = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], axis=1), axis=0)  # texts share many runs
    return found[:, 0], found[:, 1]


def shared_links(rows: DataFrame, bits: int, subtree: int = SUBTREE, many: int = MANY) -> DataFrame:
    """``(src, dst)``: links that join all ``fp`` of ``rows (fp, runs)`` within ``bits`` places that have a run in common.

    Fingerprints of a run that more than ``many`` have are joined with those of all such runs, whether they share one or
    not: by :func:`links`, whose tasks are bounded.
    """

    def run(batches):
        rest_g, rest_v = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def flush(groups, values):
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            sizes = np.diff(np.r_[starts, len(groups)])
            size = np.repeat(sizes, sizes)
            some = (size > 1) & (size <= many)
            src, dst = _near_in_groups(groups[some], values[some], bits) if some.any() else (np.zeros(0, np.uint64),) * 2
            crowd = np.unique(values[size > many])
            arrays = [pa.array(np.concatenate([x, crowd]).view(np.int64)) for x in (src, dst)]
            return pa.record_batch([*arrays, pa.array(np.arange(len(src) + len(crowd)) >= len(src))], names=["src", "dst", "crowd"])

        for batch in batches:
            g = np.concatenate([rest_g, batch.column("run").to_numpy()])
            v = np.concatenate([rest_v, batch.column("fp").to_numpy().view(np.uint64)])
            new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])] if len(g) else np.zeros(0, bool)
            g, v = g[new], v[new]
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if last:
                yield flush(g[:last], v[:last])
            rest_g, rest_v = g[last:], v[last:]
        if len(rest_g):
            yield flush(rest_g, rest_v)

    dealt = rows.select("fp", F.explode("runs").alias("run")).repartition("run").sortWithinPartitions("run", F.col("fp"))
    found = store(dealt.mapInArrow(released(run), "src long, dst long, crowd boolean").distinct(), "near-shared-links")
    near, crowd = found.filter("not crowd").select("src", "dst"), found.filter("crowd").select(F.col("src").alias("fp"))
    return near if crowd.isEmpty() else near.unionByName(links(crowd, bits, subtree))


def _alike_texts(members: DataFrame, bits: int, words: int, share: float) -> DataFrame:
    """``(mark, group)`` of texts in ``members (root, n, mark, fp, text)``: one group for all whose likeness is confirmed.

    A group of candidates is cut into parts of about ``BLOCK`` texts by a hash. Each part is joined first; then every
    two parts are compared in a task of their own, which starts from what they joined and links only what is apart.
    So a task holds two parts' shingles, eight bytes a word, whatever the size of the group, and a cluster of near
    copies gives one link for two parts.
    """

    def cut(batches):
        for batch in batches:
            sets = pa.array([shingles(x.as_py(), words).tobytes() for x in batch.column("text")], pa.binary())
            yield pa.record_batch([*(batch.column(n) for n in names), sets], names=[*names, "sets"])

    def read(table):
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("sets")]
        return table.column("fp").to_numpy().view(np.uint64), sets

    def within(key, table):
        fps, sets = read(table)
        label = np.arange(len(fps))
        alike_links(fps, sets, np.zeros(len(fps)), label, bits, share)
        return table.append_column("head", table.column("mark").take(pa.array(label)))

    def compare(key, table):
        fps, sets = read(table)
        label = np.unique(table.column("head").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        found = alike_links(fps, sets, table.column("part").to_numpy(), label, bits, share)
        heads = table.column("head")
        one, other = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
        return pa.table([heads.take(one), heads.take(other)], names=["src", "dst"])

    names = ["root", "mark", "fp", "part", "parts"]
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("parts", parts).withColumn("part", F.pmod(F.hash("mark"), "parts"))
    schema = "root long, mark binary, fp long, part int, parts int, sets binary"
    rows = rows.select(*names, "text").mapInArrow(released(cut), schema)
    joined = store(rows.groupBy("root", "part").applyInArrow(within, schema + ", head binary"), "near-joined")
    met = joined.filter("parts > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("other <> part")
    low, high = F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")
    met = met.select("root", low, high, "mark", "fp", "part", "sets", "head")
    across = met.groupBy("root", "low", "high").applyInArrow(compare, "src binary, dst binary")
    roots = connected(across).select(F.col("node").alias("head"), "root")  # of parts' heads alone
    return joined.select("mark", "head").join(roots, "head", "left").select("mark", F.coalesce("root", "head").alias("group"))


def keep_first_alike(
    docs: DataFrame, bits: int, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, share: float = SHARE, subtree: int = SUBTREE
) -> DataFrame:
    """The input's rows and columns with one document, that of the smallest id, of each group of near copies.

    Two texts are linked if their fingerprints differ in at most ``bits`` places and the Jaccard similarity of their
    shingles of so many words is ``share`` or more. A missing text is empty; texts without words are near copies; a
    missing id counts as the largest; rows that repeat a text are near copies whatever their ids, and different texts
    under one id are told apart. An empty table gives none.

    Candidates are groups of texts that share a first shingle and are within ``bits`` places; their pairs are confirmed
    part by part. A text is known by its SHA-256.
    """
    mark = F.unhex(F.sha2(whole(text).cast("binary"), 256))
    keyed = narrow(docs, id=null_as(doc_id, HIGHEST), text=whole(text), mark=mark)
    rows = store(_first_shingles(keyed, words, share), "near-runs")
    texts = store(rows.groupBy("mark").agg(F.min("id").alias("id"), F.min("fp").alias("fp")), "near-texts")
    roots = connected(shared_links(rows, bits, subtree)).select(F.col("node").alias("fp"), "root")
    rooted = store(texts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near-rooted")
    shared = store(rooted.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1"), "near-shared")
    members = store(rooted.join(shared, "root").select("id", "mark", "fp", "root", "n"), "near-members")
    wanted = keyed.join(members, ["id", "mark"]).select("root", "n", "mark", "fp", "text").dropDuplicates(["mark"])
    alike_to = _alike_texts(wanted, bits, words, share)
    grouped = store(texts.select("id", "mark").join(alike_to, "mark", "left"), "near-grouped")
    key = F.struct("id", "mark").alias("key")
    first = grouped.filter("group is not null").groupBy("group").agg(F.min(F.struct("id", "mark")).alias("key")).select("key")
    stays = store(grouped.filter("group is null").select(key).unionByName(first), "near-stays")
    row_key = F.struct(null_as(doc_id, HIGHEST).alias("id"), mark.alias("mark"))
    return docs.select(F.struct("*").alias("row"), row_key.alias("key")).join(stays, "key").dropDuplicates(["key"]).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return near_classes(docs).select(
        as_null("id", HIGHEST).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        as_null("component", HIGHEST).alias("component_id"),
    )
