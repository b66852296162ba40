"""Mixing sources to target weights by hierarchical budgets.

DataFrame functions only. Sources stand in a tree domain - language - source.
A token budget is handed down the tree in proportion to the weights of the
children; a child gets no more than its capacity (its tokens times the epochs
allowed), and what it can't take goes to its siblings. As a node's capacity is
the sum of its children's, a shortage is made up among siblings before any
other branch of the tree sees it.

A leaf's budget is spent on whole epochs, and the rest on a prefix of one more
epoch in a seeded order of documents. Where that prefix ends is found from sums
by ranges of the order (the first digits of a digest), then within the one range
where it ends, so no leaf is ever sorted in one task.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import small_enough, stored

#: Hexadecimal digits of a digest that make a range: 65536 ranges a leaf.
DIGITS = 4
#: The largest weight.
MOST = 1 << 20
LEAF = ["domain", "lang", "source"]


def weight_of(column: Column, weights: dict[str, int], other: int) -> Column:
    """A name's weight as a whole number; `other` for names without one."""
    out = F.lit(other)
    for name, weight in sorted(weights.items()):
        out = F.when(column == name, weight).otherwise(out)
    return out.cast("long")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Hand each parent's `budget` to its children: adds `given`.

    children: the parent's columns, `name`, budget (of the parent), weight and
    capacity, whole numbers. Children in the order of capacity by weight are
    full as long as an equal share by weight of what is left would fill them;
    the others share the rest by weight, rounded down. A child of weight 0 gets
    nothing. The order is exact: whole parts first, then remainders by weight, which
    as doubles differ where the fractions do, weights being at most MOST.
    """
    own = W.partitionBy(*parent)
    by = F.greatest("weight", F.lit(1))
    whole = F.expr("capacity div greatest(weight, 1)")
    before = own.orderBy(whole, (F.col("capacity") - whole * by) / by, name).rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  # products of two longs
    full = wide(F.col("budget") - F.col("c_before")) * F.col("weight") >= wide(F.col("capacity")) * (F.col("w_all") - F.col("w_before"))
    given = F.expr("cast(budget - c_full as decimal(19,0)) * weight div nullif(w_all - w_full, 0)")
    return (
        children.withColumn("c_before", earlier("capacity"))
        .withColumn("w_before", earlier("weight"))
        .withColumn("w_all", F.sum("weight").over(own))
        .withColumn("full", full)
        .withColumn("c_full", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(own))
        .withColumn("w_full", F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(own))
        .withColumn(
            "given",
            F.when(F.col("weight") == 0, F.lit(0)).when(F.col("full"), F.col("capacity")).otherwise(given),
        )
        .drop("c_before", "w_before", "w_all", "full", "c_full", "w_full")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], other: int, percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, given) from leaves (domain, lang, source, tokens).

    The whole budget is `percent` of all tokens. weights: by level, of its names.
    A leaf whose domain, language or source has weight 0 has no capacity, so what
    it would have had goes to its siblings, then to its ancestors'.
    """
    for known in [{"other": other}, *weights.values()]:
        for name, weight in known.items():
            if int(weight) != weight or not 0 <= weight <= MOST:
                raise ValueError(f"the weight of {name} must be a whole number from 0 to {MOST}, not {weight}")
    drawn = functools.reduce(operator.and_, (weight_of(F.col(n), weights.get(n, {}), other) > 0 for n in LEAF))
    cap = F.when(drawn, F.col("tokens")).otherwise(0) * max_epochs
    level = lambda df, keys: df.groupBy(*keys).agg(F.sum(cap).alias("capacity"))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    top = shared_out(
        level(leaves, LEAF[:1]).withColumn("budget", F.lit(total).cast("long")).withColumn("weight", weight_of(F.col("domain"), weights.get("domain", {}), other)), [], "domain"
    )
    for depth in (2, 3):
        parent, name = LEAF[: depth - 1], LEAF[depth - 1]
        above = top.select(*parent, F.col("given").alias("budget"))
        top = shared_out(
            level(leaves, LEAF[:depth]).join(above, parent).withColumn("weight", weight_of(F.col(name), weights.get(name, {}), other)), parent, name
        )
    return leaves.join(top.select(*LEAF, "given"), LEAF)


def order_key(seed: int, epoch: Column, id_: Column) -> Column:
    """A document's place in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def plan(
    rows: DataFrame, weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int, other: int = 100
) -> DataFrame:
    """(domain, lang, source, given, epochs, cut_key, cut_tokens, cut_of): how to draw from each leaf.

    rows: (id, domain, lang, source, tokens), stored. Each document is taken
    `epochs` times; once more if its key is below cut_key; documents at cut_key
    give cut_tokens of their cut_of tokens.
    """
    leaves = stored(rows.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")))
    given = stored(
        budgets(leaves, weights, other, percent, max_epochs)
        .withColumn("epochs", F.expr("coalesce(given div nullif(tokens, 0), 0)"))
        .withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens"))
        .select(*LEAF, "given", "epochs", "rest")
    )
    keyed = _with_leaf(rows, given).withColumn("key", order_key(seed, F.col("epochs"), F.col("id"))).withColumn("range", F.substring("key", 1, DIGITS))
    by_range = keyed.where("rest > 0").groupBy(*LEAF, "rest", "range").agg(F.sum("tokens").alias("tokens"))
    running = W.partitionBy(*LEAF).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = stored(
        by_range.withColumn("before", F.coalesce(F.sum("tokens").over(running), F.lit(0)))
        .where("before < rest and before + tokens >= rest")
        .select(*LEAF, "range", "before")
    )
    near = F.broadcast(ends) if small_enough(ends.count(), 200) else ends
    inside = keyed.join(near, [*LEAF, "range"]).groupBy(*LEAF, "rest", "before", "key").agg(F.sum("tokens").alias("tokens"))
    within = W.partitionBy(*LEAF).orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        inside.withColumn("before", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .where("before < rest and before + tokens >= rest")
        .select(*LEAF, F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_tokens"), F.col("tokens").alias("cut_of"))
    )
    return stored(given.drop("rest").join(cuts, LEAF, "left"))


def _with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(leaves) if small_enough(leaves.count(), 300) else leaves, LEAF)


def words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def leaf_rows(docs: DataFrame, domain: Column, tokens: Column, id_col: str, lang_col: str, source_col: str) -> DataFrame:
    none = F.lit("")
    tokens = F.when(tokens < 0, F.raise_error(F.concat(F.lit("negative number of tokens: "), tokens.cast("string"))).cast("long")).otherwise(tokens)
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(domain, none).alias("domain"),
        F.coalesce(F.col(lang_col), none).alias("lang"),
        F.coalesce(F.col(source_col), none).alias("source"),
        tokens.alias("tokens"),
    )


def mixed_sources(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    percent: int = 50,
    max_epochs: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tokens: Column | None = None,
) -> DataFrame:
    """One row per document that is drawn: id, domain, lang, source, tokens, epochs, part_tokens, taken_tokens.

    weights: whole numbers from 0 to MOST by level and name (a name without one has
    100); 0 switches a domain, language or source off: nothing of it is drawn. Other
    weights, and negative numbers of tokens, are errors.
    tokens: each row's number of tokens (null is 0), else white-space separated
    words of the whole text. Null domains, languages and sources are empty
    strings; a text without tokens is never drawn. Rows that repeat an id share a
    place in the order, as do null ids; if the prefix ends there, each gives its share,
    rounded down. Other columns are not read.
    """
    counted = words(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    rows = stored(leaf_rows(docs, domain, counted, id_col, lang_col, source_col))
    leaves = plan(rows, weights, percent, max_epochs, seed)
    key = order_key(seed, F.col("epochs"), F.col("id"))
    part = (
        F.when(key < F.col("cut_key"), F.col("tokens"))
        .when(key == F.col("cut_key"), F.expr("cut_tokens * tokens div nullif(cut_of, 0)"))
        .otherwise(F.lit(0))
    )
    return (
        _with_leaf(rows, leaves)
        .withColumn("part_tokens", F.coalesce(part, F.lit(0)).cast("long"))
        .withColumn("taken_tokens", F.col("epochs") * F.col("tokens") + F.col("part_tokens"))
        .where("taken_tokens > 0")
        .select("id", *LEAF, "tokens", "epochs", "part_tokens", "taken_tokens")
    )


def keep_drawn(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, int]],
    percent: int,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tokens: Column | None = None,
) -> DataFrame:
    """docs, all columns: the rows that are drawn within one epoch, that at the end of a prefix whole.

    Rows without tokens are kept, whatever their source's weight: they take nothing from a budget. Weights and tokens are as in `mixed_sources`. Rows that
    repeat an id share a place in the order, so all or none of them are drawn with the prefix.
    """
    counted = words(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    rows = stored(leaf_rows(docs, domain, counted, id_col, lang_col, source_col))
    new = "__"
    while any(c.startswith(new) for c in docs.columns):
        new += "_"
    leaves = plan(rows, weights, percent, 1, seed).select(
        *(F.col(c).alias(new + c) for c in LEAF), F.col("epochs").alias(new + "epochs"), F.col("cut_key").alias(new + "cut")
    )
    if small_enough(leaves.count(), 300):
        leaves = F.broadcast(leaves)
    none = F.lit("")
    same = (
        (F.coalesce(domain, none) == F.col(new + "domain"))
        & (F.coalesce(F.col(lang_col), none) == F.col(new + "lang"))
        & (F.coalesce(F.col(source_col), none) == F.col(new + "source"))
    )
    drawn = (F.col(new + "epochs") > 0) | (order_key(seed, F.col(new + "epochs"), F.col(id_col)) <= F.col(new + "cut"))
    return docs.join(leaves, same).where(F.coalesce(drawn, F.lit(False)) | (counted == 0)).select(*docs.columns)
