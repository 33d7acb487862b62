"""Mixing sources to target weights over a domain-language-source tree.

A token budget flows down the tree. Siblings share their parent's budget by weight, but none takes more than the
tokens below it (times the allowed epochs); what one cannot take goes to its siblings, and only what a whole
subtree cannot take goes to the siblings of its ancestors. Each leaf then reads its documents in a seeded order,
epoch after epoch, until its budget is spent; the document at the end gives a prefix of its tokens.

The tree is aggregated to one row per leaf before anything is ranked. A leaf's order is cut into as many
hash ranges as the square root of its documents; only the range in which the budget ends is ranked, so no leaf
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

LEVELS = ("domain", "lang", "source")
_HASHES = 1 << 60


def words(text: Column) -> Column:
    """Tokens of a text: its maximal runs without white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0b\f\r]+")).cast("long")


def _share_out(nodes: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Share each parent's budget among its children by weight, none above its capacity.

    Children are met in order of capacity per weight: one is full if the level ``(budget - capacities before) /
    (weights from here on)`` is at least its own capacity per weight; the rest share what is left by weight.
    """
    order = [F.col("_ratio"), F.col("_name")]
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = siblings.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))) / F.sum(weight).over(onward)
    marked = (
        nodes.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(float("inf"))))
        .withColumn("_level", F.when(F.col(weight) > 0, level))
        .withColumn("_full", F.coalesce(F.col("_level") >= F.col("_ratio"), F.lit(False)))
    )
    # full ones lead the order, so the first that is not full holds the common level
    common = F.max(F.when(~F.col("_full"), F.col("_level"))).over(siblings)
    share = F.when(F.col(weight) <= 0, F.lit(0.0)).when(F.col("_full"), F.col(capacity).cast("double"))
    return marked.withColumn(
        out, F.least(F.col(capacity).cast("double"), share.otherwise(common * F.col(weight)))
    ).drop("_ratio", "_level", "_full")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, Column], epochs: int) -> DataFrame:
    """``leaves`` (one row per leaf with ``tokens``) with each leaf's whole-token budget ``take``.

    ``weights`` gives, per level, a node's weight among its siblings as an expression over the node's path. A node
    of weight zero takes nothing. The budget is at most ``epochs`` times all tokens.
    """
    rows = leaves.withColumn("_cap3", F.col("tokens") * epochs)
    rows = rows.withColumn("_cap2", F.sum("_cap3").over(Window.partitionBy("domain", "lang")))
    rows = rows.withColumn("_cap1", F.sum("_cap3").over(Window.partitionBy("domain")))
    rows = rows.withColumn("_all", F.sum("_cap3").over(Window.partitionBy(F.lit(0))))
    rows = rows.withColumn("_b0", F.least(budget.cast("double"), F.col("_all").cast("double")))
    rows = store(rows, "mix-leaves")
    for depth, name in enumerate(LEVELS, 1):
        parent = list(LEVELS[: depth - 1])
        path = list(LEVELS[:depth])
        nodes = rows.select(*path, f"_b{depth - 1}", f"_cap{depth}").distinct()
        nodes = nodes.withColumn("_name", F.col(name)).withColumn("_w", weights[name].cast("double"))
        nodes = _share_out(nodes, parent, f"_b{depth - 1}", f"_cap{depth}", "_w", f"_b{depth}").select(*path, f"_b{depth}")
        rows = store(rows.join(nodes, path), f"mix-level-{depth}")
    return rows.withColumn("take", F.floor(F.col("_b3") + 1e-6)).select(*leaves.columns, "take")


def mix(docs: DataFrame, budget: Column, weights: dict[str, Column], epochs: int, seed: int) -> DataFrame:
    """``(id, domain, lang, source, tokens, epoch, take, leaf_take)`` per selected document and epoch.

    ``docs`` carries ``id, domain, lang, source, tokens``. Nulls in a level are a node of their own (the text
    ``'?'``), a null token count is none; documents without tokens are never selected. Ties in the seeded order
    fall to the id, and rows that repeat an id are read one after the other as equals: they enter as one document of
    their summed tokens. ``leaf_take`` is the leaf's whole budget. An empty table gives none.
    """
    rows = docs.select(
        "id", *(F.coalesce(F.col(x), F.lit("?")).alias(x) for x in LEVELS), F.coalesce("tokens", F.lit(0)).alias("tokens")
    ).filter("tokens > 0")
    rows = store(rows, "mix-documents")
    leaves = store(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "mix-sizes")
    budgets = store(leaf_budgets(leaves, budget, weights, epochs), "mix-budgets")
    budgets = budgets.select(
        *LEVELS,
        F.col("take").alias("leaf_take"),
        F.floor(F.col("take") / F.col("tokens")).alias("full"),
        F.expr("take % tokens").alias("rest"),
        F.ceil(F.sqrt("n")).alias("ranges"),
    )
    name = F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("id").cast("string"))
    hashed = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    ordered = (
        rows.join(F.broadcast(budgets) if _small(budgets) else budgets, list(LEVELS))
        .withColumn("place", hashed)
        .withColumn("range", F.floor(F.col("place") / F.lit(_HASHES) * F.col("ranges")))
    )
    sums = store(
        ordered.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("in_range"), F.max("rest").alias("rest")), "mix-ranges"
    )
    before = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = store(
        sums.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
        .filter("before < rest and rest <= before + in_range")
        .select(*LEVELS, F.col("range").alias("last_range"), "before"),
        "mix-ends",
    )
    ordered = ordered.join(F.broadcast(ends) if _small(ends) else ends, list(LEVELS), "left")
    whole_epochs = ordered.filter("full > 0").select(
        "id", *LEVELS, "tokens", F.explode(F.expr("sequence(0L, full - 1)")).alias("epoch"), F.col("tokens").alias("take"), "leaf_take"
    )
    ahead = ordered.filter("range < last_range").select(
        "id", *LEVELS, "tokens", F.col("full").alias("epoch"), F.col("tokens").alias("take"), "leaf_take"
    )
    upto = Window.partitionBy(*LEVELS).orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        ordered.filter("range = last_range")
        .withColumn("seen", F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
        .filter("seen < rest")
        .select("id", *LEVELS, "tokens", F.col("full").alias("epoch"), F.expr("least(tokens, rest - seen)").alias("take"), "leaf_take")
    )
    return whole_epochs.unionByName(ahead).unionByName(last)


#: Leaves up to which their table is broadcast (some 100 bytes each); beyond, the join shuffles.
BROADCAST_LEAVES = 50_000


def _small(leaves: DataFrame) -> bool:
    return leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES


def take_prefix(text: Column, tokens: Column) -> Column:
    """The text up to the end of its first ``tokens`` tokens."""
    pieces = F.regexp_extract_all(text, F.lit(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), tokens.cast("int")), "")


def mixed_documents(docs: DataFrame, domain: Column, share: float, weights: dict[str, Column], seed: int) -> DataFrame:
    """The input's columns for a ``share`` of its tokens by the target weights, each document once at most.

    ``docs`` has the columns of ``documents`` and perhaps more. ``text`` and ``n_chars`` of the document in which a
    leaf's budget ends are cut to its first tokens. Documents without tokens have nothing to give and go. Rows that
    repeat an id and text are one document, kept or cut alike.
    """
    names = docs.columns
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), F.xxhash64("text", "lang", "source").cast("string"))
    told = docs.select(key.alias("id"), domain.alias("domain"), "lang", "source", words(F.coalesce("text", F.lit(""))).alias("tokens"))
    told = store(told.distinct(), "mix-told")
    budget = int((told.agg(F.sum("tokens")).first()[0] or 0) * share)
    taken = store(mix(told, F.lit(budget), weights, 1, seed).select("id", "tokens", "take"), "mix-taken")
    rows = docs.select(F.struct("*").alias("row"), key.alias("id")).join(taken, "id")
    cut = F.when(F.col("take") < F.col("tokens"), take_prefix(F.col("row.text"), F.col("take"))).otherwise(F.col("row.text"))
    rows = rows.select("row", "tokens", "take", cut.alias("cut"))
    size = F.when(F.col("take") < F.col("tokens"), F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("cut"), "n_chars": size}
    return rows.select(*(changed.get(n, F.col("row").getField(n)).alias(n) for n in names))


def _level(depth: int) -> str:
    """SQL for one level of the tree: the same sharing rule, written with framed windows."""
    path = ", ".join(LEVELS[:depth])
    parent = ", ".join(LEVELS[: depth - 1]) or "0"
    up = ", ".join(f"x.{n}" for n in LEVELS[: depth - 1])
    join = f"JOIN b{depth - 1} USING ({', '.join(LEVELS[: depth - 1])})" if up else "CROSS JOIN b0"
    weight = ("CAST(substr(domain, 7, 1) AS DOUBLE) + 1.0", "CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END", "1.0")[depth - 1]
    return f"""
n{depth} AS (SELECT {path}, sum(tokens) * 4 AS cap, CAST({weight} AS DOUBLE) AS w FROM leaves GROUP BY ALL),
l{depth} AS (
  SELECT x.*, budget, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {LEVELS[depth - 1]}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
         sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {LEVELS[depth - 1]}
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM n{depth} x {join}),
b{depth} AS (
  SELECT {path}, least(CAST(cap AS DOUBLE), CASE WHEN lvl >= cap / w THEN CAST(cap AS DOUBLE) ELSE w *
         max(CASE WHEN lvl < cap / w THEN lvl END) OVER (PARTITION BY {parent}) END) AS budget FROM l{depth})"""


ORACLE = f"""
WITH docs AS (
  SELECT * FROM (SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '')
           AS INTEGER), 0) % 4) AS domain, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+')) AS tokens FROM documents) WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM docs GROUP BY ALL),
b0 AS (SELECT CAST(sum(tokens) AS DOUBLE) AS budget FROM leaves),
{_level(1)}, {_level(2)}, {_level(3)},
takes AS (SELECT domain, lang, source, CAST(floor(budget + 1e-6) AS BIGINT) AS leaf_take,
                 CAST(floor(budget + 1e-6) AS BIGINT) // CAST(tokens AS BIGINT) AS fulls,
                 CAST(floor(budget + 1e-6) AS BIGINT) % CAST(tokens AS BIGINT) AS rest
          FROM b3 JOIN (SELECT * FROM leaves) USING (domain, lang, source)),
placed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('7:' || fulls || ':' || doc_id), 1, 15), doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM docs JOIN takes USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, epoch, CAST(tokens AS BIGINT) AS take, leaf_take
FROM placed, LATERAL (SELECT unnest(range(fulls)) AS epoch)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT), fulls, CAST(least(tokens, rest - seen) AS BIGINT), leaf_take
FROM placed WHERE seen < rest
"""
