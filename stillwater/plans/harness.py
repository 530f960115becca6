"""Checks of a feature statement: that it does not look ahead, and that it repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stillwater.sources import stored


def prefix_differences(panel: DataFrame, body: str, more: str = "", cuts: tuple[int, ...] = (1, 10, 50)) -> int:
    """How many rows change at or before a cut when the online part is cut off behind it."""
    whole, changed = stored.Panel(panel).run(body, more), 0
    for cut in cuts:
        online = panel.where("period = 2").groupBy("id").agg({"tt": "min"}).withColumnRenamed("min(tt)", "first_tt")
        short = panel.join(online, "id").where(f"period = 1 or tt < first_tt + {cut}").select(*panel.columns)
        changed += whole.where(f"t <= {cut}").exceptAll(stored.Panel(short).run(body, more)).count()
    return changed


def same_again(panel: DataFrame, body: str, more: str = "") -> bool:
    """Whether two runs from the panel on give the same rows, to the last bit."""
    one, two = (stored.Panel(panel).run(body, more) for _ in range(2))
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
