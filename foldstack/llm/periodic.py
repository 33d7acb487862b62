"""Runs of repeated words, found online by catchers over completed power-of-two blocks.

A stretch of ``exponent`` periods ``p`` has ``(exponent - 1) * p`` places whose word comes again ``p`` later, so it holds
a whole aligned block of ``L = 2^m`` words that does, where ``2 L - 1 <= (exponent - 1) * p``. Level ``m`` serves
the periods from there to the next level's. Each completed block has a catcher that waits, for as many words as its
periods allow, until its words end again at an appended one; both are known by a hash that doubles level by level.
A caught square ``(p, place)`` is compared on word by word, backwards once and forwards as words are appended, and all
squares of one period that meet merge into one run. Squares inside a known run whose period divides theirs are its own.

``Catchers.append`` takes any number of words at once and works on all of them together in numpy: one call with
all words and one call per word report the same runs. A level keeps only as many hashes as its catchers look back.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, whole

#: Fewest periods and words of a run in the registered query.
EXPONENT, SHORTEST = 4, 6
#: Documents are caught together until they have so many words; a longer one is caught alone.
TOGETHER = 1 << 16
#: Words appended at once, which bounds the working arrays of a very long text.
SLICE = 1 << 18

_ODD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return (values ^ (values >> np.uint64(29))) * _TURN


class _Level:
    """Hashes of the last ``2^m`` words at the newest places, as far back as this level's catchers look."""

    def __init__(self, m: int, exponent: int):
        self.size = 1 << m
        self.least = max(1, -(-(2 * self.size - 1) // (exponent - 1)))
        self.most = -(-(4 * self.size - 1) // (exponent - 1)) - 1
        self.first, self.hashes = self.size - 1, np.zeros(0, np.uint64)

    def extend(self, below: _Level | None, hashes: np.ndarray | None) -> int:
        """Add the new places' hashes from the level below; returns the first new place."""
        start = self.first + len(self.hashes)
        if below is not None:
            half = below.size
            end = below.first + len(below.hashes)
            if end <= start:
                return end
            late = below.hashes[start - below.first :]
            early = below.hashes[start - half - below.first : end - half - below.first]
            hashes = _mixed(early * _TURN + late)
        self.hashes = np.concatenate([self.hashes, hashes])
        return start

    def caught(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """``(period, place)`` of block ends that come again at places from ``start`` on."""
        end = self.first + len(self.hashes)
        if end <= start or self.most < self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(start, end)
        back = self.least + (at + 1 - self.least) % self.size  # the nearest block end that is far enough back
        periods, places = [], []
        while True:
            fits = np.flatnonzero((back <= self.most) & (at - back >= self.size - 1))
            if not len(fits):
                break
            where = at[fits] - self.first
            same = fits[self.hashes[where] == self.hashes[where - back[fits]]]
            periods.append(back[same])
            places.append(at[same])
            back = back + self.size
        if not periods:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(periods), np.concatenate(places)

    def trim(self) -> None:
        """Forget what neither a catcher nor the level above looks back to."""
        keep = max(self.most, self.size) + 1
        if len(self.hashes) > 2 * keep:
            self.first += len(self.hashes) - keep
            self.hashes = self.hashes[-keep:].copy()


class Catchers:
    """Online detection of runs ``(start, length, period)`` of at least ``exponent`` periods and ``shortest`` words."""

    def __init__(self, exponent: int = EXPONENT, shortest: int = SHORTEST):
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.exponent, self.shortest = exponent, shortest
        self.words = np.zeros(1024, np.int64)
        self.n = 0
        self.levels: list[_Level] = []
        self.open: dict[int, tuple[int, int]] = {}  # period: places [first, last) equal to those a period back
        self.known: dict[int, list[tuple[int, int]]] = {}  # runs by their period, in order

    def append(self, words) -> None:
        """Append words, given as integers of any value, and compare on."""
        words = np.atleast_1d(np.asarray(words, np.int64))
        if not len(words):
            return
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.zeros(max(self.n, 2 * len(self.words)), np.int64)
            grown[:before] = self.words[:before]
            self.words = grown
        self.words[before : self.n] = words
        for period, (first, last) in list(self.open.items()):
            self._advance(period, first, last)
        below, hashes, m = None, _mixed(words.view(np.uint64) * _ODD + _TURN), 0
        while m == 0 or (1 << m) <= self.n:
            if m == len(self.levels):
                self.levels.append(_Level(m, self.exponent))
            level = self.levels[m]
            self._meet(*level.caught(level.extend(below, hashes)))
            below, m = level, m + 1
        for level in self.levels:
            level.trim()

    def _advance(self, period: int, first: int, last: int) -> None:
        """Compare on with the words a period back until they differ or words run out."""
        words, step = self.words, 32
        while last < self.n:
            to = min(last + step, self.n)
            differ = words[last:to] != words[last - period : to - period]
            at = int(differ.argmax())
            if differ[at]:
                self.open.pop(period, None)
                self._close(period, first, last + at)
                return
            last, step = to, min(2 * step, 1 << 16)
        self.open[period] = (first, last)

    def _close(self, period: int, first: int, last: int) -> None:
        if last - first >= (self.exponent - 1) * period:
            self.known.setdefault(period, []).append((first - period, last))

    def _meet(self, periods: np.ndarray, places: np.ndarray) -> None:
        """Take caught squares of one level: skip those of known runs, extend and merge the others."""
        while len(periods):
            fresh = np.ones(len(periods), bool)
            for q, runs in [*((q, r) for q, r in self.known.items()), *((q, [(a - q, b)]) for q, (a, b) in self.open.items())]:
                divided = np.flatnonzero(fresh & (periods % q == 0))
                if not len(divided):
                    continue
                starts, ends = (np.array(x) for x in zip(*runs))
                run = np.searchsorted(starts, places[divided] - periods[divided], side="right") - 1
                fresh[divided[(run >= 0) & (ends[run] > places[divided])]] = False
            periods, places = periods[fresh], places[fresh]
            if not len(periods):
                return
            # Of all that are left only the smallest periods are compared on before the rest is looked at again.
            some = periods < 2 * periods.min()
            order = np.lexsort((places[some], periods[some]))
            done: dict[int, int] = {}
            for period, place in zip(periods[some][order].tolist(), places[some][order].tolist()):
                if done.get(period, -1) <= place:
                    done[period] = self._compare(period, place)
            periods, places = periods[~some], places[~some]

    def _compare(self, period: int, place: int) -> int:
        """Extend one square both ways; returns the place where its comparison ends."""
        words, first, step = self.words, place, 32
        while first > period:
            low = max(period, first - step)
            differ = (words[low:first] != words[low - period : first - period])[::-1]
            at = int(differ.argmax())
            if differ[at]:
                first -= at
                break
            first, step = low, min(2 * step, 1 << 16)
        if words[place] != words[place - period]:  # equal hashes of different words
            return place + 1
        held = self.open.get(period)
        if held is not None and held[0] <= place:
            return held[1]
        runs = len(self.known.get(period, ()))
        self._advance(period, first, place)
        if period in self.open:
            return self.open[period][1]
        found = self.known.get(period, ())
        if len(found) > runs:
            last = found[-1][1]
            if len(found) > 1 and found[-1] < found[-2]:
                found.sort()
            return last
        return place + 1

    def runs(self) -> list[tuple[int, int, int]]:
        """All runs so far, those at the end as long as they are now, by start and then period."""
        best: dict[tuple[int, int], int] = {}
        held = {q: list(runs) for q, runs in self.known.items()}
        for q, (first, last) in self.open.items():
            if last - first >= (self.exponent - 1) * q:
                held.setdefault(q, []).append((first - q, last))
        for q, runs in held.items():
            for start, end in runs:
                if end - start >= self.shortest and best.get((start, end), q) >= q:
                    best[start, end] = q
        return sorted((start, end - start, q) for (start, end), q in best.items())


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of a tenth of the documents, chosen by their id, the words from a place on become periodic."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def runs_of(texts: list[list], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words; lists share one set of catchers, parted by words that never come again."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known: dict = {}
    ids = known.setdefault
    at, starts, wholes = 0, [], []
    for i, words in enumerate(texts):
        starts.append(at)
        wholes.append(np.array([ids(w, len(known)) for w in words] + [-1 - i], np.int64))
        at += len(words) + 1
    if not texts:
        return out
    catchers, stream = Catchers(exponent, shortest), np.concatenate(wholes)
    for first in range(0, len(stream), SLICE):
        catchers.append(stream[first : first + SLICE])
    found = catchers.runs()
    places = np.searchsorted(starts, [r[0] for r in found], side="right") - 1 if found else ()
    for place, (start, length, period) in zip(places, found):
        out[place].append((start - starts[place], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drops = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drops[start + period] += 1
        drops[start + length] -= 1
    gone = np.cumsum(drops)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    for run in runs:  # by start, then period: the first of equal quotients stays
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        len(runs),
        *(best if best else (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(collapsed(words, runs)).hexdigest(),
    )


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def periodic_runs(
    docs: DataFrame, edit=None, text: str = "text", doc_id: str = "doc_id", exponent: int = EXPONENT, shortest: int = SHORTEST
) -> DataFrame:
    """``NAMES`` per row: number of runs, the run of most periods, and digests of all runs and of the collapsed text.

    ``edit(words, doc_id)`` may change the words first. A missing or empty text has no words and no runs, a missing
    id is no id (null); repeated rows are rows of their own, ties go to the smallest start and then period; an empty
    table gives none and other columns do not matter. A text is worked on alone or with others in one batch: memory
    grows with the longest text, some forty bytes a word, and nothing is shuffled.
    """

    def flush(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [(i, *_digest(w, r)) for i, w, r in zip(ids, texts, runs_of(texts, exponent, shortest))]
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(NAMES))

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = value.as_py().encode("utf-8").split()  # bytes are split at the six ASCII blanks
                texts.append(edit(words, key) if edit else words)
                ids.append(key)
                size += len(words) + 1
                if size >= TOGETHER:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield flush(ids, texts)

    rows = narrow(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=whole(text))
    return rows.mapInArrow(run, SCHEMA)


def report(docs: DataFrame) -> DataFrame:
    return periodic_runs(docs, edited)


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h
  FROM documents
), placed AS (
  SELECT *, len(w)::BIGINT AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM cut
), unitised AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed
), words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM unitised)
), pairs AS (
  SELECT one.doc_id, two.i - one.i AS q, two.i FROM words AS one JOIN words AS two USING (doc_id, word)
  WHERE two.i > one.i AND 4 * (two.i - one.i) <= one.n
), islands AS (
  SELECT doc_id, min(i) - q AS start, count(*) + q AS length, q
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING count(*) >= 3 * q AND count(*) + q >= 6
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place,
         count(*) OVER (PARTITION BY doc_id) AS n_runs FROM runs
), digests AS (
  SELECT doc_id, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS joined FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(joined, '')) AS collapsed_sha256
FROM cut LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (doc_id) LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
