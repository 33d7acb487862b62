"""Repeated passages: every byte of a ``LENGTH``-byte string that also starts in an earlier document is found.

Positions are compared where equal strings must meet. Each window of ``LENGTH`` bytes has an anchor, the ``GRAM``
bytes in it of the smallest hash; equal windows have equal anchors, and neighbouring windows mostly share one, so
a document becomes stretches of windows with one anchor each. Documents are dealt into groups by a hash of the id.
First the groups' anchor hashes meet, and a group learns, one bit each, which of them others have too; the windows of
an anchor that occurs once are unlike all others. Of the remaining stretches a group sends each distinct one once,
with the smallest id it has there, so copies are combined before the shuffle however many there are. Stretches meet
by anchor. Where different ones share an anchor their windows go, batch by batch, into a family of suffix arrays: a
batch is sorted, scanned against the levels present, and what is new becomes a level; levels of like size merge, so
there are logarithmically many. What comes back to a group is which windows of which stretch stand in an earlier
document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIGHEST, as_null, narrow, null_as, whole

LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1
LONGEST = LENGTH + 64
#: Bytes of documents in a group, of documents per anchor partition, hashed at a time; windows in a batch.
GROUP_BYTES, ANCHOR_BYTES, PIECE_BYTES, BATCH = 8 << 20, 8 << 20, 1 << 20, 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64(63)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of all ``GRAM``-byte strings, joined from those of half the length."""
    value, factor, length = data.astype(np.uint64) + np.uint64(1), _FACTOR, 1
    while length < GRAM:
        value = value[:-length] * factor + value[length:]
        factor, length = np.uint64(int(factor) ** 2 & (1 << 64) - 1), 2 * length
    value *= _MIX
    value ^= value >> np.uint64(32)
    value *= _FACTOR
    value ^= value >> np.uint64(29)
    return value


def _anchors(data: np.ndarray) -> np.ndarray:
    """Per window: the smallest gram hash with its place (modulo 64) in the low bits."""
    value = _gram_hashes(data)
    value &= ~_PLACE
    value |= np.arange(len(value), dtype=np.uint64) & _PLACE
    length = 1
    while 2 * length <= GRAMS:
        value = np.minimum(value[:-length], value[length:])
        length *= 2
    rest = GRAMS - length
    return np.minimum(value[:-rest], value[rest:]) if rest else value


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, windows, anchor offset, anchor hash)`` of the stretches of documents laid end to end.

    ``bounds`` are the documents' ends, from 0; windows never cross them. Documents are hashed in pieces that overlap
    by a window, so memory stays bounded for any length.
    """
    found = []
    total = int(bounds[-1])
    inside = np.ones(max(total - LENGTH + 1, 0), bool)
    for end in bounds[1:-1]:  # windows over the end of a document
        inside[max(0, end - LENGTH + 1) : end] = False
    for at in range(0, max(total - LENGTH + 1, 0), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES + LENGTH - 1]
        anchors, valid = _anchors(piece), inside[at : at + PIECE_BYTES]
        change = np.ones(len(anchors), bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, len(anchors)))
        keep = valid[first]
        first, count = first[keep], count[keep]
        hashes = anchors[first]
        offset = (hashes & _PLACE).astype(np.int64) - first & 63
        found.append((first + at, count, offset, hashes & ~_PLACE))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Strings as rows of words, zero beyond their ends."""
    width = -(-LONGEST // 8) * 8
    index = starts[:, None] + np.arange(width)
    out = data[np.minimum(index, len(data) - 1)]
    out[np.arange(width) >= lengths[:, None]] = 0
    return out.view(np.uint64)


_WEIGHTS = np.random.default_rng(50).integers(0, 1 << 63, -(-LONGEST // 8), dtype=np.uint64) | np.uint64(1)


def _same_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, first)``: an order in which equal strings are neighbours, and which of it differ from the one before.

    Strings are ordered by a hash and compared in full; should others of equal hash stand between two equal strings,
    these count as different, which costs work but no match.
    """
    mark = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), 1 << 16):
        rows = _matrix(data, starts[at : at + (1 << 16)], lengths[at : at + (1 << 16)])
        mark[at : at + (1 << 16)] = (rows * _WEIGHTS).sum(axis=1, dtype=np.uint64) + lengths[at : at + (1 << 16)].astype(np.uint64)
    order = np.argsort(mark, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = mark[order][1:] != mark[order][:-1]
    again = np.flatnonzero(~first)
    for at in range(0, len(again), 1 << 16):
        some = again[at : at + (1 << 16)]
        a, b = order[some], order[some - 1]
        same = (lengths[a] == lengths[b]) & (_matrix(data, starts[a], lengths[a]) == _matrix(data, starts[b], lengths[b])).all(axis=1)
        first[some[~same]] = True
    return order, first


class Family:
    """Suffix arrays of distinct windows in levels of growing size, with the smallest document of each window."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.earliest = np.zeros(0, np.int64)

    def add(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Number of each window; ``earliest`` is by number."""
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        first = np.ones(len(order), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(first)
        distinct = ranked[starts]
        least = np.minimum.reduceat(docs[order], starts)
        number = np.full(len(distinct), -1, np.int64)
        for keys, numbers in self.levels:  # scan the sorted batch against each level
            open_ = np.flatnonzero(number < 0)
            place = np.searchsorted(keys, distinct[open_])
            hit = place < len(keys)
            hit[hit] = keys[place[hit]] == distinct[open_][hit]
            number[open_[hit]] = numbers[place[hit]]
        old = number >= 0
        self.earliest[number[old]] = np.minimum(self.earliest[number[old]], least[old])
        new = np.flatnonzero(~old)
        number[new] = len(self.earliest) + np.arange(len(new))
        self.earliest = np.concatenate([self.earliest, least[new]])
        level = (distinct[new], number[new])
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            keys, numbers = self.levels.pop()
            keys, numbers = np.concatenate([keys, level[0]]), np.concatenate([numbers, level[1]])
            merged = np.argsort(keys, kind="stable")  # two sorted runs
            level = (keys[merged], numbers[merged])
        if len(level[0]):
            self.levels.append(level)
        out = np.empty(len(windows), np.int64)
        out[order] = number[np.cumsum(first) - 1]
        return out


class Group:
    """The documents of a group in a fixed order, with their stretches."""

    def __init__(self, table: pa.Table, parts: int) -> None:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.parts = parts
        self.ids = table.column("id").to_numpy()
        texts = [x.encode("utf-8") for x in table.column("text").to_pylist()]
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in texts], dtype=np.int64)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.start, self.count, self.offset, hashes = stretches(self.data, self.bounds)
        # the anchor partition above forty bits of the hash
        code = ((hashes >> np.uint64(20)) % np.uint64(parts)) << np.uint64(40) | hashes >> np.uint64(24)
        self.codes, self.code, self.times = np.unique(code, return_inverse=True, return_counts=True)
        self.spans = np.searchsorted(self.codes, np.arange(parts + 1, dtype=np.uint64) << np.uint64(40))

    def keys(self) -> list[tuple[int, bytes]]:
        """``(anchor partition, packed anchor hashes)``: distinct ones in order, as differences by byte place."""
        out = []
        for part in np.flatnonzero(np.diff(self.spans)):
            codes = self.codes[self.spans[part] : self.spans[part + 1]] & np.uint64((1 << 40) - 1)
            steps = np.diff(codes, prepend=np.uint64(0)).astype("<u8")
            out.append((int(part), _packed([steps.view(np.uint8).reshape(-1, 8)[:, :5].T.copy()])))
        return out

    def choose(self, bits: list[tuple[int, bytes]]) -> None:
        """Keep the stretches whose anchor occurs again, and put the distinct ones in the order of sending."""
        again = self.times > 1
        for part, data in bits:
            lo, hi = self.spans[part], self.spans[part + 1]
            again[lo:hi] |= np.unpackbits(np.frombuffer(data, np.uint8), count=hi - lo).astype(bool)
        keep = again[self.code]
        self.start, self.count, self.offset = self.start[keep], self.count[keep], self.offset[keep]
        part = (self.codes[self.code[keep]] >> np.uint64(40)).astype(np.int64)
        order, first = _same_strings(self.data, self.start, self.count + LENGTH - 1)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(first) - 1
        head = order[first]  # one of each distinct stretch
        sent = np.argsort(part[head], kind="stable")
        rank = np.empty(len(head), np.int64)
        rank[sent] = np.arange(len(head))
        self.stretch = rank[place]
        self.document = np.searchsorted(self.bounds, self.start, "right") - 1
        self.earliest = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(self.earliest, self.stretch, self.ids[self.document])
        self.head = head[sent]
        self.edges = np.searchsorted(part[self.head], np.arange(self.parts + 1))


def shared_keys(blobs: list[bytes]) -> list[bytes]:
    """For each group's anchor hashes of one partition, bits: which of them another group has too."""
    keys = []
    for data in blobs:
        (planes,) = _unpacked(data, ("u1",))
        steps = np.zeros((len(planes) // 5, 8), np.uint8)
        steps[:, :5] = planes.reshape(5, -1).T
        keys.append(np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64))
    every = np.sort(np.concatenate(keys))
    twice = every[1:][every[1:] == every[:-1]]
    out = []
    for some in keys:
        place = np.searchsorted(twice, some)
        hit = place < len(twice)
        hit[hit] = twice[place[hit]] == some[hit]
        out.append(np.packbits(hit).tobytes())
    return out


def _packed(arrays: list[np.ndarray]) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(a.tobytes() for a in arrays))


def _unpacked(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u8", len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw[at : at + int(size)], kind))
        at += int(size)
    return out


def send(group: Group) -> dict[int, bytes]:
    """Per anchor partition the packed stretches: smallest id, windows, anchor offset and bytes of each."""
    out = {}
    for part in np.flatnonzero(np.diff(group.edges)):
        lo, hi = group.edges[part], group.edges[part + 1]
        head = group.head[lo:hi]
        start, count = group.start[head], group.count[head]
        size = count + LENGTH - 1
        ends = np.cumsum(size)
        text = group.data[np.arange(ends[-1]) + np.repeat(start - ends + size, size)]
        arrays = [group.earliest[lo:hi].astype("<i8"), count.astype(np.uint8), group.offset[head].astype(np.uint8), text]
        out[int(part)] = _packed(arrays)
    return out


def match(blobs: list[bytes]) -> list[bytes]:
    """For each group's stretches of one anchor partition: ``(stretch, first window, windows)`` found earlier elsewhere."""
    read = [_unpacked(b, ("<i8", "u1", "u1", "u1")) for b in blobs]
    sizes = np.array([len(x[0]) for x in read])
    blob = np.repeat(np.arange(len(read)), sizes)
    local = np.arange(len(blob)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    earliest, count, offset, data = (np.concatenate([x[i] for x in read]) for i in range(4))
    del read
    count, length = count.astype(np.int64), count.astype(np.int64) + LENGTH - 1
    start = np.cumsum(length) - length
    anchor = data[(start + offset)[:, None] + np.arange(GRAM)].view(np.uint64)
    order = np.lexsort((anchor[:, 1], anchor[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (anchor[order][1:] != anchor[order][:-1]).any(axis=1)
    owner = np.cumsum(fresh) - 1
    alone = np.bincount(owner)[owner] == 1
    use = order[~alone]  # stretches whose anchor others have too
    owner = owner[~alone]
    by, first = _same_strings(data, start[use], length[use])
    use, owner = use[by], owner[by]
    string = np.cumsum(first) - 1
    heads = use[first]
    least = np.minimum.reduceat(earliest[use], np.flatnonzero(first)) if len(use) else np.zeros(0, np.int64)
    several = np.bincount(owner[first], minlength=1)[owner[first]] > 1  # anchors of different strings
    family = Family()
    windows = np.zeros(len(heads) + 1, np.int64)
    np.cumsum(count[heads] * several, out=windows[1:])
    numbers = np.zeros(windows[-1], np.int64)
    todo = np.flatnonzero(several)
    while len(todo):
        take = max(1, int(np.searchsorted(windows[todo + 1], windows[todo[0]] + BATCH, "right")))
        some, todo = todo[:take], todo[take:]
        n = count[heads[some]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(start[heads[some]] - ends + n, n)
        keys = data[at[:, None] + np.arange(LENGTH)].view(f"S{LENGTH}").ravel()
        numbers[windows[some[0]] : windows[some[-1] + 1]] = family.add(keys, np.repeat(least[some], n))
    found = []
    wholly = (least[string] < earliest[use])
    hit = use[wholly]
    found.append((hit, np.zeros(len(hit), np.int64), count[hit]))
    part = np.flatnonzero(~wholly & several[string])
    if len(part):
        n = count[use[part]]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(windows[string[part]] - ends + n, n)
        row = np.repeat(np.arange(len(part)), n)
        seen = family.earliest[numbers[at]] < np.repeat(earliest[use[part]], n)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], seen.astype(np.int8), [0]])) | np.concatenate([[0], np.diff(row) != 0, [0]]))
        lo, hi = edge[:-1], edge[1:]
        keep = seen[lo] if len(lo) else np.zeros(0, bool)
        lo, hi = lo[keep], hi[keep]
        found.append((use[part[row[lo]]], lo - (ends - n)[row[lo]], hi - lo))
    which, at, n = (np.concatenate(x) for x in zip(*found))
    out = []
    by = np.argsort(blob[which], kind="stable")
    which, at, n = which[by], at[by], n[by]
    edges = np.searchsorted(blob[which], np.arange(len(sizes) + 1))
    for i in range(len(sizes)):
        s = slice(edges[i], edges[i + 1])
        out.append(_packed([local[which[s]].astype("<u4"), at[s].astype(np.uint8), n[s].astype(np.uint8)]))
    return out


def covered(group: Group, replies: list[tuple[int, bytes]]) -> np.ndarray:
    """Which bytes of the group's documents are repeated."""
    change = np.zeros(len(group.data) + 1, np.int32)
    later = group.ids[group.document] > group.earliest[group.stretch]
    lo, hi = group.start[later], (group.start + group.count + LENGTH - 1)[later]
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    held = np.argsort(group.stretch, kind="stable")
    edges = np.searchsorted(group.stretch[held], np.arange(len(group.head) + 1))
    for part, data in replies:
        stretch, at, n = _unpacked(data, ("<u4", "u1", "u1"))
        stretch = stretch.astype(np.int64) + group.edges[part]
        times = edges[stretch + 1] - edges[stretch]
        ends = np.cumsum(times)
        which = held[np.arange(ends[-1] if len(ends) else 0) + np.repeat(edges[stretch] - ends + times, times)]
        begin = group.start[which] + np.repeat(at.astype(np.int64), times)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + np.repeat(n.astype(np.int64), times) + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _pairs(table: pa.Table, column: str) -> list[tuple[int, bytes | None]]:
    return list(zip(table.column("part").to_pylist(), table.column(column).to_pylist()))


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` per row.

    A missing text is empty; texts shorter than ``LENGTH`` bytes lose nothing; a missing id is the largest; rows that
    repeat an id are of equal rank and take nothing from each other. An empty table gives none.
    """
    rows = narrow(docs, id=null_as(doc_id, HIGHEST), text=whole(text))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, parts = max(1, -(-total // GROUP_BYTES)), max(1, -(-total // ANCHOR_BYTES))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))

    def keying(key, table):
        blobs = Group(table, parts).keys()
        return pa.table(
            {
                "part": pa.array([p for p, _ in blobs], pa.int32()),
                "g": pa.array([key[0].as_py()] * len(blobs), pa.int32()),
                "blob": pa.array([b for _, b in blobs], pa.binary()),
            }
        )

    def sharing(key, table):
        bits = shared_keys(table.column("blob").to_pylist())
        return pa.table({"g": table.column("g"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    def sending(key, table, shared):
        group = Group(table, parts)
        bits = _pairs(shared, "bits")
        group.choose(bits)
        blobs = send(group)
        return pa.table(
            {
                "part": pa.array([p for p, _ in bits], pa.int32()),
                "g": pa.array([key[0].as_py()] * len(bits), pa.int32()),
                "bits": pa.array([b for _, b in bits], pa.binary()),
                "blob": pa.array([blobs.get(p) for p, _ in bits], pa.binary()),
            }
        )

    def matching(key, table):
        table = table.sort_by("g")
        blobs = table.column("blob").to_pylist()
        some = [i for i, b in enumerate(blobs) if b is not None]
        replies = [None] * len(blobs)
        for i, reply in zip(some, match([blobs[i] for i in some]) if some else []):
            replies[i] = reply
        return table.select(["g", "part", "bits"]).append_column("reply", pa.array(replies, pa.binary()))

    def finishing(key, table, replies):
        group = Group(table, parts)
        group.choose(_pairs(replies, "bits"))
        gone = covered(group, [(p, r) for p, r in _pairs(replies, "reply") if r is not None])
        out = []
        for row, number in enumerate(group.ids):
            lo, hi = group.bounds[row], group.bounds[row + 1]
            mask = gone[lo:hi]
            kept = group.data[lo:hi][~mask].tobytes()
            spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (mask[:1].any()))
            out.append((int(number), int(hi - lo), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        return pa.table({n: pa.array(x, k) for n, x, k in zip(names, zip(*out) if out else [()] * 5, kinds)})

    keys = rows.groupBy("g").applyInArrow(keying, "part int, g int, blob binary")
    shared = keys.groupBy("part").applyInArrow(sharing, "g int, part int, bits binary")
    sent = rows.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(sending, "part int, g int, bits binary, blob binary")
    replies = sent.groupBy("part").applyInArrow(matching, "g int, part int, bits binary, reply binary")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(finishing, schema)


def report(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs).select(as_null("id", HIGHEST).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
