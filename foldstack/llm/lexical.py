"""Ranked lexical search over bit-sliced Bloom signatures, exact to the last rank.

Index: documents are gathered in blocks of similar numbers of distinct terms. A block is a matrix of bits, one row
per place of a Bloom signature and one column per document; a term sets ``HASHES`` rows in its document's column, and
again, under other rows, for each number of occurrences in ``LEVELS`` that it reaches. Beside the blocks the index
lists how many documents hold each term, counted per task, so exact statistics of any query terms are a sum.

Search: the rows of a query term, taken together bit by bit, tell which documents may hold it and how often at most;
false bits only add. Sums of these slices, weighted by the terms, give every document an upper bound of its score. The
documents of the highest bounds are scored exactly first, which gives each query a score and an id that its last rank
reaches at least. Every document whose bound does is then scored exactly from its whole text; no other can be ranked.
"""

from __future__ import annotations

from collections import Counter
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_uri
from .common import HIGHEST, as_null, narrow, null_as, released, store, whole

#: Bits of a signature for each distinct term of the block's largest document, and rows that a term sets.
BITS, HASHES = 16, 3
#: Occurrences from which a term sets further rows, and the most occurrences below the next level.
LEVELS = (1, 2, 3, 4, 6, 9, 14)
TOPS = (*(n - 1 for n in LEVELS[1:]), None)
#: A block is full at so many documents or distinct terms summed over them; a task's open blocks hold four times that.
BLOCK_DOCS, BLOCK_TERMS = 2048, 1 << 19
#: Queries looked up in one scan of the index; more are taken in further scans.
QUERIES = 256
#: Documents of the highest bounds per query that set the score to reach, per task and in all.
SEEDS = 40
RANKS = 20
#: Distinct terms whose hashes a task remembers.
REMEMBERED = 1 << 18
#: Distinct terms whose documents a task counts before it writes the counts.
VOCABULARY = 200_000

#: Scale, length normalisation in per cent and saturation of the score.
SCALE, BASE, SLOPE, SATURATION = 1_000_000_000, 75, 25, 12

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_TABLE = bytes(32 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SALTS = [np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for i in range(len(LEVELS))]
_ODDS = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9)]


def terms_of(text: str) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8").translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return BASE + 25 * n * n_docs // n_terms


def occurrence_factor(tf: int, m: int) -> int:
    return SCALE * tf // (1000 * tf + SATURATION * m)


class _Hashes(dict):
    def __missing__(self, term: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[term] = xxhash.xxh64_intdigest(term)
        return found


def _rows(hashes: np.ndarray, level: int, width: int) -> list[np.ndarray]:
    """The signature rows of terms at a level, one array per hash; ``width`` is a power of two."""
    shift = np.uint64(64 - (width.bit_length() - 1))
    return [((hashes ^ _SALTS[level]) * odd) >> shift for odd in _ODDS[:HASHES]]


class _Open:
    """A block being filled."""

    def __init__(self):
        self.ids, self.marks, self.sizes, self.hashes, self.counts = [], [], [], [], []
        self.entries = 0

    def add(self, key: int, mark: int, counts: Counter, known: _Hashes) -> None:
        self.ids.append(key)
        self.marks.append(mark)
        self.hashes.append(np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts)))
        tfs = np.fromiter(counts.values(), np.int64, len(counts))
        self.counts.append(tfs)
        self.sizes.append(int(tfs.sum()))
        self.entries += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.entries >= BLOCK_TERMS

    def batch(self) -> pa.RecordBatch:
        n = len(self.ids)
        most = max(1, *(len(h) for h in self.hashes)) if n else 1
        width = 1 << max(3, (BITS * most - 1).bit_length())
        bits = np.zeros((width, -(-n // 8) * 8), bool)
        hashes, tfs = np.concatenate(self.hashes), np.concatenate(self.counts)
        column = np.repeat(np.arange(n), [len(h) for h in self.hashes])
        for level, least in enumerate(LEVELS):
            some = tfs >= least
            for row in _rows(hashes[some], level, width):
                bits[row.astype(np.int64), column[some]] = True
        sizes = np.array(self.sizes, np.int64)
        packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
        parts = (np.array(x, np.int64).tobytes() for x in (self.ids, self.marks, sizes))
        return _batch(*parts, width, packed, n_docs=n, n_terms=int(sizes.sum()))


_KINDS = {
    "ids": pa.binary(),
    "marks": pa.binary(),
    "sizes": pa.binary(),
    "width": pa.int32(),
    "bits": pa.binary(),
    "terms": pa.list_(pa.binary()),
    "dfs": pa.list_(pa.int64()),
    "n_docs": pa.int64(),
    "n_terms": pa.int64(),
}
_SCHEMA = (
    "ids binary, marks binary, sizes binary, width int, bits binary, terms array<binary>, dfs array<long>, "
    "n_docs long, n_terms long"
)


def _batch(*block, **others) -> pa.RecordBatch:
    """One row of the index: a block, or document counts of terms."""
    row = {**dict(zip(_KINDS, block)), **others}
    return pa.record_batch([pa.array([row.get(n)], k) for n, k in _KINDS.items()], names=list(_KINDS))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return narrow(docs, id=null_as(doc_id, HIGHEST), text=whole(text)).withColumn("mark", F.xxhash64("text"))


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Blocks of signatures of all documents, written to the shared folder; nothing is shuffled.

    A document is known by its id and a hash of its text; texts without terms belong to no block.
    """

    def run(batches):
        known, blocks, vocabulary = _Hashes(), {}, Counter()
        for batch in batches:
            keys, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
            for key, mark, value in zip(keys, marks, batch.column("text")):
                counts = Counter(terms_of(value.as_py()))
                if not counts:
                    continue
                vocabulary.update(counts.keys())
                if len(vocabulary) >= VOCABULARY:
                    yield _batch(terms=list(vocabulary), dfs=list(vocabulary.values()))
                    vocabulary.clear()
                size = len(counts).bit_length()
                block = blocks.setdefault(size, _Open())
                block.add(key, mark, counts, known)
                if block.full():
                    yield blocks.pop(size).batch()
                elif sum(b.entries for b in blocks.values()) >= 4 * BLOCK_TERMS:
                    yield blocks.pop(max(blocks, key=lambda s: blocks[s].entries)).batch()
        for block in blocks.values():
            yield block.batch()
        if vocabulary:
            yield _batch(terms=list(vocabulary), dfs=list(vocabulary.values()))

    return store(_keyed(docs, text, doc_id).mapInArrow(released(run), _SCHEMA), "lexical-index")


class _Plan(NamedTuple):
    """What a block of queries asks: distinct terms, their hashes, each query's weights, and the corpus' size."""

    hashes: np.ndarray
    weights: np.ndarray  # query, term: weight times repeats
    queries: list[dict[bytes, int]]  # term: weight times repeats
    n_docs: int
    n_terms: int


def _plan(index: DataFrame, texts: list[str]) -> _Plan:
    asked = [Counter(terms_of(t)) for t in texts]
    terms = sorted(set().union(*asked)) if asked else []
    size = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = size[0] or 0, size[1] or 0
    wanted = index.sparkSession.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    found = index.filter("terms is not null").select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))))
    found = found.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df"))
    df = {bytes(r["term"]): r["df"] for r in found.collect()}  # at most the terms of one block of queries
    terms = [t for t in terms if t in df]
    at = {t: i for i, t in enumerate(terms)}
    weights = np.zeros((len(asked), len(terms)))
    queries = []
    for i, counts in enumerate(asked):
        queries.append({t: n * weight(n_docs, df[t]) for t, n in counts.items() if t in df})
        for t, w in queries[-1].items():
            weights[i, at[t]] = w
    if weights.sum(axis=1).max(initial=0) < 1 << 24:  # sums stay exact
        weights = weights.astype(np.float32)
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
    return _Plan(hashes, weights, queries, n_docs, n_terms)


def bounds(plan: _Plan, width: int, bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, one row per query and one column per document of a block."""
    n, m = len(sizes), BASE + SLOPE * sizes * plan.n_docs // plan.n_terms
    total = np.zeros((len(plan.queries), n), np.int64)
    held, below = None, np.zeros(n, np.int64)
    for level, top in enumerate(TOPS):
        slices = [bits[row.astype(np.int64)] for row in _rows(plan.hashes, level, width)]
        found = np.bitwise_and.reduce(slices)
        held = found if held is None else held & found
        some = held.any(axis=1)
        if not some.any():
            break
        columns = np.unpackbits(held[some], axis=1, count=n, bitorder="little").astype(plan.weights.dtype)
        sums = (plan.weights[:, some] @ columns).astype(np.int64)
        most = np.full(n, SCALE // 1000) if top is None else SCALE * top // (1000 * top + SATURATION * m)
        total += sums * (most - below)
        below = most
    return total


def _blocks(batches, plan: _Plan):
    """``(bounds, ids, marks)`` of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, marks, sizes = (np.frombuffer(row[x], np.int64) for x in ("ids", "marks", "sizes"))
            bits = np.frombuffer(row["bits"], np.uint8).reshape(row["width"], -1)
            yield bounds(plan, row["width"], bits, sizes), ids, marks


_PAIRS = "query int, id long, mark long, high long"


def _pairs(query: np.ndarray, ids: np.ndarray, marks: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(query.astype(np.int32)), pa.array(ids), pa.array(marks), pa.array(high)], names=["query", "id", "mark", "high"]
    )


def _signatures(index: DataFrame) -> DataFrame:
    return index.filter("width is not null").select("ids", "marks", "sizes", "width", "bits")


def _seeds(index: DataFrame, plan) -> DataFrame:
    """Per task and query the documents of the highest bounds."""

    def run(batches):
        asked = plan.value
        best = [np.zeros((len(asked.queries), SEEDS), np.int64) for _ in range(3)]
        for high, ids, marks in _blocks(batches, asked):
            high = np.concatenate([best[0], high], axis=1)
            top = np.argpartition(-high, SEEDS - 1, axis=1)[:, :SEEDS]
            known = [np.concatenate([b, np.broadcast_to(x, (len(b), len(x)))], axis=1) for b, x in zip(best[1:], (ids, marks))]
            best = [np.take_along_axis(x, top, axis=1) for x in (high, *known)]
        query, place = np.nonzero(best[0])
        yield _pairs(query, *(x[query, place] for x in (best[1], best[2], best[0])))

    return _signatures(index).mapInArrow(run, _PAIRS)


def _candidates(index: DataFrame, plan, reach) -> DataFrame:
    """Every pair whose bound reaches the score, and at that score the id, that the query's last rank has at least."""

    def run(batches):
        asked, (least, last) = plan.value, reach.value
        for high, ids, marks in _blocks(batches, asked):
            query, place = np.nonzero((high > least[:, None]) | (high == least[:, None]) & (ids <= last[:, None]))
            yield _pairs(query, ids[place], marks[place], high[query, place])

    return _signatures(index).mapInArrow(run, _PAIRS)


def _scored(docs: DataFrame, pairs: DataFrame, plan) -> DataFrame:
    """``(query, id, score)`` of the pairs' documents, each scored from its whole text; only positive scores."""

    def run(batches):
        asked = plan.value
        for batch in batches:
            out = []
            keys, wanted = batch.column("id").to_pylist(), batch.column("queries").to_pylist()
            for key, numbers, value in zip(keys, wanted, batch.column("text")):
                counts = Counter(terms_of(value.as_py()))
                m = length_factor(counts.total(), asked.n_docs, asked.n_terms)
                for number in numbers:
                    score = sum(w * occurrence_factor(counts[t], m) for t, w in asked.queries[number].items() if t in counts)
                    if score > 0:
                        out.append((number, key, score))
            query, ids, scores = zip(*out) if out else ((), (), ())
            yield pa.record_batch(
                [pa.array(query, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["query", "id", "score"]
            )

    wanted = store(pairs.groupBy("id", "mark").agg(F.collect_set("query").alias("queries")), "lexical-pairs")
    return docs.join(wanted, ["id", "mark"]).select("id", "text", "queries").mapInArrow(run, "query int, id long, score long")


def _ranked(scored: DataFrame, ranks: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)


def search(
    index: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    query_text: str = "text",
    query_id: str = "item_id",
    ranks: int = RANKS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``ranks`` best documents of each query by a positive score.

    ``index`` is :func:`build_index` of the same ``docs``. Equal scores rank by id, a missing one last; documents that
    repeat a row are ranked one by one; a missing or empty text has no terms and is never ranked, and a query without
    terms has no ranks. Queries that repeat an id and a text count once, and texts under one id are ranked apart.
    Empty tables give none, and other columns do not matter.
    """
    spark = index.sparkSession
    asked = store(narrow(queries, item=F.col(f"`{query_id}`").cast("long"), text=whole(query_text)).distinct(), "lexical-queries")
    rows = _keyed(docs, text, doc_id)
    n_blocks = -(-asked.count() // QUERIES)
    uri, schema = scratch_uri(spark, "lexical-ranked"), "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(uri)
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(n_blocks, 1)))
    for number in range(n_blocks):
        some = asked.filter(block == number).collect()  # about QUERIES rows
        if not some:
            continue
        made = _plan(index, [r["text"] for r in some])
        if not made.n_terms:
            continue
        plan = spark.sparkContext.broadcast(made)
        order = Window.partitionBy("query").orderBy(F.desc("high"), F.asc("id"))
        seeds = _seeds(index, plan).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SEEDS)
        least, last = np.ones(len(some), np.int64), np.full(len(some), HIGHEST)
        for r in _ranked(_scored(rows, seeds, plan), ranks).filter(F.col("rank") == ranks).collect():  # one row per query
            least[r["query"]], last[r["query"]] = r["score"], r["id"]
        pairs = _candidates(index, plan, spark.sparkContext.broadcast((least, last)))
        ranked = _ranked(_scored(rows, pairs, plan), ranks)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(some)], "query int, item_id long")
        named = ranked.join(F.broadcast(names), "query")  # one row per query of the block
        named.select("item_id", F.col("rank").cast("int"), as_null("id", HIGHEST).alias("doc_id"), "score").write.mode("append").parquet(uri)
    return spark.read.schema(schema).parquet(uri)


def report(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return search(build_index(docs), docs, queries)


ORACLE = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), wanted AS (
  SELECT item_id, term, count(*) AS repeats FROM asked GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, corpus WHERE term IN (SELECT term FROM wanted) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
