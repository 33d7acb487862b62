"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks whose hashes are computed side by side and joined by length-shifted arithmetic
(``hash(xy) = hash(x) * base^len(y) + hash(y)``), under two primes. Rows of equal fingerprint and length are
candidates only: each candidate is compared with the row that stays, chunk by chunk. Rows that turn out to
differ form their own class in a further round, so a collision never merges two texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST, arrow_map, as_null, narrow, null_as, store, whole

CHUNK = 1024
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1540483477)
#: Bytes compared at a time.
COMPARED = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def normalised(text: str) -> bytes:
    """A-Z lower-cased, everything else as it is, in UTF-8."""
    return text.encode("utf-8").translate(_LOWER)


def _powers(prime: int, base: int) -> np.ndarray:
    out = [1]
    for _ in range(CHUNK - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], dtype=np.float64)


#: Products stay below 2^8 * 2^31 * 2^10 < 2^53, so the float sums are exact.
_POWERS = np.stack([_powers(p, b) for p, b in zip(PRIMES, BASES)], axis=1)


def combine(left: tuple[int, int], right: tuple[int, int], which: int = 0, primes=PRIMES) -> tuple[int, int]:
    """Hash and length of two texts put together, from those of each."""
    prime = primes[which]
    return (left[0] * pow(BASES[which], right[1], prime) + right[0]) % prime, left[1] + right[1]


def polynomial(data: bytes, primes=PRIMES) -> tuple[int, ...]:
    """Both hashes of a text: all chunk hashes at once, then joined pairwise, halving their number each time."""
    if not data:
        return (0,) * len(primes)
    lead = -len(data) % CHUNK  # zeros in front leave the value as it is
    values = np.zeros(lead + len(data), dtype=np.float64)
    values[lead:] = np.frombuffer(data, dtype=np.uint8)
    chunks = (values.reshape(-1, CHUNK) @ _POWERS).astype(np.uint64)
    out = []
    for which, prime in enumerate(primes):
        hashes = chunks[:, which] % np.uint64(PRIMES[which])
        shift = pow(BASES[which], CHUNK, PRIMES[which])
        while len(hashes) > 1:
            if len(hashes) % 2:
                hashes = np.concatenate([np.zeros(1, np.uint64), hashes])
            hashes = (hashes[0::2] * np.uint64(shift) + hashes[1::2]) % np.uint64(PRIMES[which])
            shift = shift * shift % PRIMES[which]
        out.append(int(hashes[0]) % prime)
    return tuple(out)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", primes=PRIMES) -> DataFrame:
    """``(id, fp, n_bytes, sha256)`` of each row's normalised text; a missing id counts as the lowest one."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sizes, digests = [], [], []
        for value in batch.column("text"):
            data = normalised(value.as_py())
            high, low = polynomial(data, primes)
            fps.append(high << 31 | low)
            sizes.append(len(data))
            digests.append(hashlib.sha256(data).hexdigest())
        return pa.record_batch(
            [batch.column("id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
            names=["id", "fp", "n_bytes", "sha256"],
        )

    rows = narrow(docs, id=null_as(doc_id, LOWEST), text=whole(text))
    return arrow_map(rows, step, "id long, fp long, n_bytes long, sha256 string")


def _with_fingerprint(docs: DataFrame, text: str, doc_id: str, primes) -> DataFrame:
    """``(id, fp, n_bytes, text)``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sizes = [], []
        for value in batch.column("text"):
            data = normalised(value.as_py())
            high, low = polynomial(data, primes)
            fps.append(high << 31 | low)
            sizes.append(len(data))
        return pa.record_batch(
            [batch.column("id"), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), batch.column("text")],
            names=["id", "fp", "n_bytes", "text"],
        )

    rows = narrow(docs, id=null_as(doc_id, LOWEST), text=whole(text))
    return arrow_map(rows, step, "id long, fp long, n_bytes long, text string")


def same_text(left: str, right: str) -> bool:
    """Compare two normalised texts piece by piece, stopping at the first difference."""
    if len(left) != len(right):
        return False
    return all(
        normalised(left[i : i + COMPARED]) == normalised(right[i : i + COMPARED]) for i in range(0, len(left), COMPARED)
    )


def _compared(pairs: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column("text"), batch.column("keep_text")
        same = [same_text(left[i].as_py(), right[i].as_py()) for i in range(batch.num_rows)]
        names = ["id", "fp", "n_bytes", "keep"]
        return pa.record_batch([*(batch.column(n) for n in names), pa.array(same, pa.bool_())], names=[*names, "same"])

    return arrow_map(pairs, step, "id long, fp long, n_bytes long, keep long, same boolean")


KEY = ["fp", "n_bytes"]


def exact_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", primes=PRIMES) -> DataFrame:
    """``(id, fp, n_bytes, sha256, keep, size)`` per row.

    ``keep`` is the largest id among the rows of equal normalised text, ``size`` their number. A missing text is
    empty; a missing id stands below all others (``LOWEST``); rows that repeat an id and text all carry the same
    class and count towards ``size``. An empty table gives none.
    """
    marks = store(fingerprints(docs, text, doc_id, primes), "exact-fingerprints")
    pending, done = marks, []
    while True:
        groups = store(pending.groupBy(KEY).agg(F.max("id").alias("keep"), F.count("*").alias("size")), "exact-groups")
        copied = groups.filter("size > 1")
        wanted = pending.join(copied, KEY).select("id", *KEY, "keep").distinct()
        texts = _with_fingerprint(docs, text, doc_id, primes)
        copies = store(texts.join(wanted, ["id", *KEY]).dropDuplicates(["id", *KEY]), "exact-copies")
        members = copies.filter("id <> keep")
        stays = copies.filter("id = keep").select("keep", *KEY, F.col("text").alias("keep_text"))
        checked = store(_compared(members.join(stays, ["keep", *KEY])), "exact-compared")
        differ = checked.filter("not same")
        classes = pending.join(groups, KEY)
        if differ.isEmpty():
            done.append(classes)
            break
        apart = differ.select("id", *KEY)
        fewer = pending.join(apart, ["id", *KEY], "left_semi").groupBy(KEY).agg(F.count("*").alias("apart"))
        done.append(
            pending.join(apart, ["id", *KEY], "left_anti")
            .join(groups.join(fewer, KEY, "left").withColumn("size", F.expr("size - coalesce(apart, 0)")), KEY)
            .select(*pending.columns, "keep", "size")
        )
        pending = store(pending.join(apart, ["id", *KEY], "left_semi"), "exact-pending")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("id", *KEY, "sha256", "keep", "size")


def keep_latest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The input's rows and columns without exact copies: of equal normalised texts the largest id stays, once."""
    marks = exact_classes(docs, text, doc_id).filter("id = keep").select("id", "sha256").distinct()
    key = F.struct(
        null_as(doc_id, LOWEST).alias("id"),
        F.sha2(F.translate(whole(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256).alias(
            "sha256"
        ),
    )
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    marks = marks.select(F.struct("id", "sha256").alias("key"))
    return rows.join(marks, "key").dropDuplicates(["key"]).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    classes = exact_classes(docs)
    return classes.select(
        as_null("id", LOWEST).alias("doc_id"),
        as_null("keep", LOWEST).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


ORACLE = """
WITH marks AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
           AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM marks WINDOW same AS (PARTITION BY text_sha256)
"""
