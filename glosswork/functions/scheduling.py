"""Due metrics, intervals and card states as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW, LEARNING, REVIEW = "new", "learning", "review"


def card_state(queue: Column, type_: Column) -> Column:
    return F.when((queue == 0) | (type_ == 0), NEW).when(queue.isin(1, 3) | type_.isin(1, 3), LEARNING).otherwise(REVIEW)


def is_review(queue: Column, type_: Column) -> Column:
    """What has a due day."""
    return queue.isin(2, 3) | (type_ == 2)


def days_until(due: Column, today: int) -> Column:
    return (due - F.lit(today)).cast("long")


def due_metrics(queue: Column, type_: Column, due: Column, today: int) -> tuple[Column, Column, Column]:
    """overdue, due_in_days, priority: overdue cards gain with every day up to 30, later ones lose with distance."""
    d, dated = days_until(due, today), is_review(queue, type_)
    late = F.greatest(-d, F.lit(0)).cast("double")
    overdue = F.when(dated & (d <= 0), late).otherwise(0.0)
    in_days = F.when(dated & (d > 0), d).otherwise(F.lit(0)).cast("long")
    priority = F.when(dated & (d > 0), F.greatest(F.lit(0.5), F.lit(6.0) / (d + 1))).when(dated, 10.0 + F.least(late, F.lit(30.0)) / 3.0).otherwise(10.0)
    return overdue, in_days, priority


def inside_window(queue: Column, type_: Column, due: Column, today: int, days: int) -> Column:
    """Whether a dated card is due within ``days``; a due of 0 is today's."""
    return ~is_review(queue, type_) | (F.coalesce(F.nullif(due, F.lit(0)), F.lit(today)) <= today + days)


def next_interval(interval: Column, factor: Column) -> Column:
    base = F.greatest(F.lit(1), F.coalesce(interval, F.lit(0)))
    ease = F.greatest(F.lit(1300), F.when(F.coalesce(factor, F.lit(0)) == 0, F.lit(2500)).otherwise(factor))
    grown = F.rint(base * F.greatest(F.lit(1.3), ease / 1000.0)).cast("long")
    return F.greatest(base + 1, grown).cast("long")


def days_label(days: Column) -> Column:
    return F.when(days <= 0, "today").when(days == 1, "1 day").otherwise(F.format_string("%d days", days))
