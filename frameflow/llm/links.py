"""Groups of linked texts from postings, without all pairs of a group.

Postings say which ids share a key; only ids that share one may be linked. First every
list is tested against one of its members, whatever is linked joins a component, and so
on for a few rounds: a large group of near copies collapses after linearly many tests.
Then all pairs of a list that are still in different components are tested,
so the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import connected_components
from ..runtime import checkpoint, forget

STAR_ROUNDS = 3
#: All pairs are tested where they are at most so many for each posting: at the start, and
#: after a first round has joined what is alike.
FEW_PAIRS, FEW_PAIRS_LEFT = 4, 50


def linked_components(postings: DataFrame, may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
                      verify: Callable[[DataFrame], DataFrame], *, star_rounds: int = STAR_ROUNDS, pairs: DataFrame | None = None) -> DataFrame | None:
    """(id, component) of the linked ids, a component being named by its smallest id;
    None if no two are linked.

    `postings`: key, id and columns for `may_link`, which says of two rows of a key
    whether a pair is worth a test (it gets both rows' columns by name). `verify` takes
    distinct pairs (a, b), a < b, and returns the linked ones. `pairs` of this form, distinct
    ones that share no list, are tested with the first round's.
    """
    columns = [c for c in postings.columns if c != "key"]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("key", *[F.col(c).alias(f"{prefix}_{c}") for c in [*columns, "component"]])
    edges = components = tested = None
    old: list[DataFrame] = []
    met: list[DataFrame] = []
    given = 0 if pairs is None else pairs.count()
    for step in range(star_rounds + 1):
        if components is None:
            rows = postings.withColumn("component", F.col("id"))
        else:
            rows = checkpoint(postings.join(components, "id", "left").withColumn("component", F.coalesce("component", "id")))
            forget(*old)
            old = [rows]
        # another hub in each round, the same one in all lists that hold it
        rank = F.struct(F.xxhash64("id", F.lit(step)).alias("r"), *columns, "component")
        hubs = rows.groupBy("key").agg(F.min(rank).alias("hub"), F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        hubs = checkpoint(hubs.where("low <> high"))
        size = hubs.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n")).first()
        if not size[1] and (step or not given):
            break
        last = step == star_rounds or (size[0] or 0) + given <= (FEW_PAIRS_LEFT if step else FEW_PAIRS) * ((size[1] or 0) + 2 * given)
        open_rows = rows.join(hubs.select("key"), "key")
        if last:
            right = side(open_rows, "y")
        else:
            right = hubs.select("key", *[F.col(f"hub.{c}").alias(f"y_{c}") for c in [*columns, "component"]])
        close = side(open_rows, "x").join(right, "key").where(
            (F.col("x_id") != F.col("y_id")) & (F.col("x_component") != F.col("y_component"))
            & may_link(lambda c: F.col(f"x_{c}"), lambda c: F.col(f"y_{c}")))
        if last:  # each pair once, from its smaller side
            close = close.where("x_id < y_id")
        close = close.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
        if tested is not None:
            close = close.distinct().join(tested, ["a", "b"], "left_anti")
        else:
            close = (close.unionByName(pairs) if given else close).distinct()
        close = checkpoint(close)
        found = checkpoint(verify(close).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        tested = close if tested is None else tested.unionByName(close)
        met += [close, found]
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
            after = checkpoint(connected_components(nodes, "id", edges))
            forget(components)
            components = after
        if step:  # components only grow, so that a list never opens again
            postings = open_rows.select("key", *columns)
        old.append(hubs)
        if last:
            break
    forget(*old, *met)
    return components
