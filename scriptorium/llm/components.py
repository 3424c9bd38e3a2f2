"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut as checkpointed


def components(links: DataFrame, start: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """links (a, b) -> (id, comp): for each id on a link the smallest id that it reaches.

    start: labels (id, comp) known already, for any of the ids. A round takes the least label of an id's
    neighbours, then the label of its label; labels only fall, so the rounds end when none falls. Every
    table that a round reads is in the shared folder, so that a label held by very many ids is a skewed
    join of two exchanges, which adaptive execution splits. No links give no rows.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct())
    ids = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    if start is None:
        labels = ids.select("id", F.least("id", "near").alias("comp"))
    else:
        labels = ids.join(start, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
    labels = cut(labels)
    while True:
        best = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("best"))
        hooked = cut(labels.join(best, "id").select("id", F.least("comp", "best").alias("comp"), (F.col("best") < F.col("comp")).alias("fell")))
        if hooked.where("fell").isEmpty():
            return hooked.select("id", "comp")
        up = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        labels = cut(hooked.select("id", "comp").join(up, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))
