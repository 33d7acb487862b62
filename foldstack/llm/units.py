"""Repeated lines and sentences: units are normalised and hashed, digests grouped over all documents, the earliest kept.

A unit is a sentence of a line, or the line where it has one: it ends after a full stop, question or exclamation mark
before a blank, after their full-width forms, or at a line's end, and holds the blanks that follow, so the units of a
text are the text. A digest's earliest place is a map-side combined minimum, so a unit that stands in every document
is one row per task before the shuffle; only digests that occur more than once are joined back to their places.

Short phrases repeat by chance or as headings. Units that repeat an earlier one go where they form a stretch of
``STRETCH`` characters or more with the repeats next to them; the README states the share of repeats that stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIGHEST, arrow_map, as_null, narrow, null_as, store, whole

#: Characters, in normal form, that a stretch of repeated units has at least to be removed.
STRETCH = 120

_END = re.compile("[.!?]+[ \t\r\v\f\n]+|[。！？][ \t\r\v\f\n]*|\n[ \t\r\v\f\n]*")
_FORM = {c: c + 32 for c in range(65, 91)} | dict.fromkeys(map(ord, "\t\r\v\f\n"), " ")
DOC = ["id", "mark"]


def normal_form(unit: str) -> str:
    """A-Z lower-cased, white space runs as one blank, none at the ends."""
    return " ".join(x for x in unit.translate(_FORM).split(" ") if x)


def split_units(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of each unit in code points; together they are the whole text."""
    ends = [m.end() for m in _END.finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def _documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = narrow(docs, id=null_as(doc_id, HIGHEST), text=whole(text))
    return rows.withColumn("mark", F.xxhash64("text"))


def unit_places(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, mark, unit, start, end, size, digest)`` of units that are not blank.

    ``mark`` tells apart texts that share an id, ``size`` is the length of the normal form.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, value in enumerate(batch.column("text")):
            whole_text = value.as_py()
            for number, (start, end) in enumerate(split_units(whole_text)):
                form = normal_form(whole_text[start:end])
                if form:
                    rows.append((i, number, start, end, len(form), hashlib.blake2b(form.encode(), digest_size=16).digest()))
        at, *numbers, digest = zip(*rows) if rows else ((),) * 6
        at = pa.array(at, pa.int32())
        columns = [batch.column("id").take(at), batch.column("mark").take(at), *(pa.array(x, pa.int32()) for x in numbers)]
        return pa.record_batch([*columns, pa.array(digest, pa.binary())], names=["id", "mark", "unit", "start", "end", "size", "digest"])

    schema = "id long, mark long, unit int, start int, end int, size int, digest binary"
    return arrow_map(_documents(docs, text, doc_id), step, schema)


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, mark, repeats)``: per document with repeats of earlier units, ``(unit, start, end, size)`` in order.

    Units rank by (id, text hash, number); the first of equal digests stays. A missing id ranks last, a missing text
    has no units, and rows that repeat an id and a text count as one document.
    """
    places = store(unit_places(docs, text, doc_id), "unit-places")
    rank = F.struct("id", "mark", "unit")
    first = places.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    first = store(first.filter("n > 1").select("digest", "first"), "unit-first")
    later = places.join(first, "digest").filter(rank != F.col("first"))
    return later.groupBy(DOC).agg(F.sort_array(F.collect_set(F.struct("unit", "start", "end", "size"))).alias("repeats"))


def stretches(repeats: list[dict], least: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the repeats whose stretch of adjacent ones is long enough."""
    out, run, size = [], [], 0
    for repeat in [*repeats, None]:
        if run and (repeat is None or repeat["unit"] != run[-1]["unit"] + 1):
            if size >= least:
                out.extend((r["start"], r["end"]) for r in run)
            run, size = [], 0
        if repeat is not None:
            run.append(repeat)
            size += repeat["size"]
    return out


def _kept(text: str, gone: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for start, end in gone:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def dedup_units(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = STRETCH) -> DataFrame:
    """``(id, kept_text, n_units, removed)`` per row; a document whose units all go has an empty text."""
    rows = _documents(docs, text, doc_id)
    gone = removals(docs, text, doc_id)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, spans = [], [], []
        for value, repeats in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
            found = stretches(repeats or [], least)
            texts.append(_kept(value, found))
            sizes.append(len(split_units(value)))
            spans.append(",".join(f"{a}:{b}" for a, b in found))
        return pa.record_batch(
            [batch.column("id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(spans, pa.string())],
            names=["id", "kept_text", "n_units", "spans"],
        )

    joined = rows.join(gone, DOC, "left").select("id", "text", "repeats")
    return arrow_map(joined, step, "id long, kept_text string, n_units long, spans string")


def report(docs: DataFrame) -> DataFrame:
    return dedup_units(docs).select(
        as_null("id", HIGHEST).alias("doc_id"),
        "n_units",
        F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_removed"),
        F.col("spans").alias("removed_spans"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''),
           '([.!?]+[ \t\r\v\f\n]+|[。！？][ \t\r\v\f\n]*|\n[ \t\r\v\f\n]*)', '\1' || chr(57344), 'g'), chr(57344)) AS parts FROM documents
), units AS (
  SELECT doc_id, unit, piece FROM (
    SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS unit FROM cut) WHERE piece <> ''
), placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY unit
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         trim(regexp_replace(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[ \t\r\v\f\n]+', ' ', 'g'), ' ') AS form
  FROM units
), ranked AS (
  SELECT *, form <> '' AND row_number() OVER (PARTITION BY form ORDER BY doc_id, unit) > 1 AS later FROM placed
), islands AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id, later ORDER BY unit) AS island FROM ranked
), judged AS (
  SELECT *, later AND sum(length(form)) OVER (PARTITION BY doc_id, later, island) >= {STRETCH} AS gone FROM islands
), found AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
         string_agg(start || ':' || (start + length(piece)), ',' ORDER BY unit) FILTER (gone) AS spans,
         string_agg(piece, '' ORDER BY unit) FILTER (NOT gone) AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS removed_spans,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN found USING (doc_id)
"""
