"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize, scratch, written


def components(links: DataFrame, salts: int = 32) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the least node that
    links reach.

    Each round hooks a node's root, and the node, under the least root among its
    neighbours, then halves the paths. Rounds grow with the logarithm of the longest
    path. Minima are combined before they are shuffled. A root may stand over very
    many nodes, so nodes read their root's root through one copy of it for each
    ``salts``-th of them. Every round is written to the shared folder; of its tables only the
    roots outlast it.
    Nulls in a or b are no link; repeated links and loops change nothing; no links
    give no rows."""
    links = links.where("a is not null and b is not null and a <> b")
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    state = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "roots")
    spark = links.sparkSession
    while True:
        with scratch(spark) as tables:
            near = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
            seen = materialize(state.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("near")), "near")
            # what each root hears from the nodes under it, and from itself as a node
            heard = seen.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("heard"))
            hooked = seen.join(heard, "node", "left").select("node", "root", F.least("near", F.coalesce("heard", "near")).alias("next"))
            salt = F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")
            hooked = materialize(hooked.withColumn("salt", salt), "hooked")
            used = hooked.select("next", "salt").distinct()
            above = used.join(hooked.select(F.col("node").alias("next"), F.col("next").alias("above")), "next")
            after = hooked.join(above, ["next", "salt"], "left").select("node", F.col("root").alias("was"), F.coalesce("above", "next").alias("root"))
            after = materialize(after, "roots")
            roots = tables.pop()
        written(roots)
        state = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return state
