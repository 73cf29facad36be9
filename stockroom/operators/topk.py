"""Top-k rows that have their references, with the names of those references.

``top_k_named`` first keeps the rows whose keys exist in every referenced table
(left-semi joins on the keys alone), then takes the first ``k`` in ``order``
(``TakeOrderedAndProject``), and only then joins the k rows to the names.  It is
one lazy plan: nothing is counted, checkpointed or tried again, and rows without
a reference never stand in the way of later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def top_k_named(base: DataFrame, order: list, k: int, names: dict[str, DataFrame]) -> DataFrame:
    """The first ``k`` rows of ``base`` joined to every table of ``names`` (key column -> table), unordered.

    ``order`` must be a total order on ``base`` (end it with a unique id), and keys unique in their tables.
    """
    for key, table in names.items():
        base = base.join(table.select(key), key, "left_semi")
    top = base.orderBy(*order).limit(k)
    for key, table in names.items():
        top = top.join(table, key)
    return top
