"""Document fingerprints by winnowing, in built-in functions only.

Words (runs without white space, cut every ``PIECE`` characters) are hashed; a rolling polynomial joins ``GRAM`` of
them; of each ``WINDOW`` neighbouring k-grams the smallest hash is chosen, the rightmost among equals. Any two texts
that share ``GRAM + WINDOW - 1`` words in a row therefore share a chosen hash. Positions are kept: a choice is one
long, the 31-bit hash above the inverted position, so one minimum settles both. Windows are reduced by doubling:
minima over 2, 4 and 6 neighbours come from each other by one shifted comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWEST, as_null, narrow, null_as, store, whole

GRAM, WINDOW, PIECE = 3, 6, 16
_PRIME, _BASE = 2147483647, 1000003
_LAST = (1 << 32) - 1


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _cut(values: Column, by: int) -> Column:
    return F.slice(values, 1, F.greatest(F.size(values) - by, F.lit(0)))


def _roll(left: Column, right: Column, factor: int) -> Column:
    return (left * F.lit(factor) + right) % F.lit(_PRIME)


def add_choices(frame: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: the chosen (hash, position) longs of column ``text``, in order of position.

    Fewer words than ``GRAM`` give one hash of all of them at position 0, no words an empty array; fewer k-grams
    than ``WINDOW`` form one window.
    """
    made = f"{out}_made"
    col = F.col(made)
    words = F.regexp_extract_all(F.col(text), F.lit(rf"[^\s]{{1,{PIECE}}}"), F.lit(0))
    frame = frame.withColumn(made, F.transform(words, lambda x: F.shiftrightunsigned(F.xxhash64(x), 33)))
    frame = frame.withColumn(f"{out}_all", F.size(made))
    frame = frame.withColumn(
        f"{out}_short", F.when(F.col(f"{out}_all").between(1, GRAM - 1), F.aggregate(made, F.lit(0).cast("long"), lambda a, x: _roll(a, x, _BASE)))
    )
    frame = frame.withColumn(f"{out}_pair", F.zip_with(_cut(col, 1), _shifted(col, 1), lambda a, b: _roll(a, b, _BASE)))
    frame = frame.withColumn(
        made, F.zip_with(_cut(F.col(f"{out}_pair"), 1), _shifted(col, 2), lambda a, b: _roll(a, b, _BASE))
    )
    frame = frame.withColumn(
        made, F.transform(made, lambda x, i: F.shiftleft(x, 32) + (F.lit(_LAST) - i.cast("long")))
    )
    frame = frame.withColumn(f"{out}_grams", col)
    for by in (1, 2, 2):
        frame = frame.withColumn(made, F.zip_with(_cut(col, by), _shifted(col, by), lambda a, b: F.least(a, b)))
    one = F.shiftleft(f"{out}_short", 32) + F.lit(_LAST)
    chosen = (
        F.when(F.size(made) > 0, F.array_distinct(made))
        .when(F.size(f"{out}_grams") > 0, F.array(F.array_min(f"{out}_grams")))
        .when(F.col(f"{out}_short").isNotNull(), F.array(one))
        .otherwise(F.array().cast("array<long>"))
    )
    frame = frame.withColumn(out, chosen)
    return frame.drop(made, *(f"{out}_{x}" for x in ("all", "short", "pair", "grams")))


def hashes(choices: Column) -> Column:
    return F.array_distinct(F.transform(choices, lambda x: F.shiftright(x, 32)))


def as_text(choices: Column) -> Column:
    """``hash:position`` pairs, hash in hexadecimal."""
    return F.array_join(
        F.transform(
            choices,
            lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit(":"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string")),
        ),
        " ",
    )


def likeness(left: str, right: str) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def next_ids(ids: DataFrame) -> DataFrame:
    """``(id, next_id)`` for distinct ids in descending order; after the last comes the first.

    Ids are range partitioned and ranked inside their range; ranges are stitched by their first ids.
    """
    ranged = store(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "winnow-ids")
    below = Window.partitionBy("part").orderBy("id")
    inside = ranged.withColumn("next_id", F.lag("id").over(below))
    ends = ranged.groupBy("part").agg(F.max("id").alias("top"))  # one row per partition
    order = Window.orderBy("part")
    ends = ends.withColumn("under", F.coalesce(F.lag("top").over(order), F.max("top").over(Window.partitionBy(F.lit(0)))))
    return inside.join(F.broadcast(ends), "part").select("id", F.coalesce("next_id", "under").alias("next_id"))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, choices)`` of every row; a missing text counts as empty."""
    rows = narrow(docs, id=doc_id, text=whole(text))
    return add_choices(rows, "text", "choices").select("id", "choices")


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(id, text, n_chars, next_text, edited)``; a missing id comes last in descending order.

    Rows that repeat an id all meet the same next id; of several texts under that id the largest is taken. An empty
    table gives none.
    """
    rows = narrow(docs, id=null_as(doc_id, LOWEST), text=whole(text))
    counted = store(rows.groupBy("id").agg(F.count("*").alias("n")), "winnow-counts")
    order = store(next_ids(counted.select("id")), "winnow-next")
    following = rows.select(F.col("id").alias("next_id"), F.col("text").alias("next_text"))
    if not counted.filter("n > 1").isEmpty():
        following = following.groupBy("next_id").agg(F.max("next_text").alias("next_text"))
    half = F.expr("n_chars div 2").cast("int")
    return (
        rows.join(order, "id")
        .join(following, "next_id")
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn(
            "edited",
            F.concat(
                F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)
            ),
        )
    )


def report(docs: DataFrame) -> DataFrame:
    rows = edited_pairs(docs)
    for text in ("text", "edited", "next_text"):
        rows = add_choices(rows, text, f"c_{text}")
        rows = rows.withColumn(f"h_{text}", hashes(F.col(f"c_{text}")))
    return rows.select(
        as_null("id", LOWEST).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("c_text")).alias("fingerprint"),
        as_text(F.col("c_edited")).alias("edited_fingerprint"),
        likeness("h_text", "h_edited").alias("near_edited"),
        likeness("h_text", "h_next_text").alias("near_next"),
    )
