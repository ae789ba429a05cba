"""Writing answers: the host's own path, the contextual one behind it, and a learner's session around both.

Nothing is written before every card of a batch is known to be writable; the caller publishes what these return.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators import schedule as P


class PartlyAnswered(Exception):
    """The host's path stopped after some cards; these are answered, so nothing else may answer the batch again."""

    def __init__(self, message: str, answered: list[int]):
        super().__init__(message)
        self.answered = answered


@dataclass
class Written:
    """What an answer did: by which path, the rows to publish, the log's rows, and what undo restores."""

    path: str
    cards: DataFrame
    log: DataFrame | None
    snapshot: DataFrame | None
    reason: str = ""


def answer(plan: DataFrame, cards: DataFrame, today: int, now: int, usn: int, native: Callable[[DataFrame], DataFrame] | None = None, taken: DataFrame | None = None) -> Written:
    """Answers ``plan`` (card_id, ease, is_unknown) for ``cards``.

    ``native`` takes (card_id, ease) and gives the cards as its scheduler left them. If it fails before any card is
    answered, the contextual scheduler takes the batch; if it fails later, its error goes on. The contextual path refuses
    a batch with a missing card or one in a filtered deck as a whole.
    """
    why = ""
    if native is not None:
        missing = plan.join(cards.select("card_id"), "card_id", "left_anti").select("card_id").take(1)
        try:
            if missing:
                raise LookupError(f"card {missing[0].card_id} is missing")
            return Written("native", native(plan.select("card_id", "ease")), None, None)
        except PartlyAnswered as e:
            if e.answered:
                raise
            why = str(e)
        except Exception as e:  # noqa: BLE001  whatever the host raises, nothing was answered
            why = str(e)
    bad = P.check_answers(plan, cards).take(1)
    if bad:
        raise ValueError(f"card {bad[0].card_id}: {bad[0].problem}" + (f" ({why})" if why else ""))
    stepped = P.step(rows_of(plan, cards), today, now, usn)
    return Written("contextual", stepped, P.log_rows(stepped, now, taken), P.undo(stepped), why)


def rows_of(plan: DataFrame, cards: DataFrame) -> DataFrame:
    return cards.join(plan.select("card_id", "is_unknown"), "card_id")


@dataclass
class Session:
    """A review session: which cards and sentences come next, from two functions over tables.

    ``collect()`` gives due targets (card_id, ...); ``choose(due, shown, recent)`` the best sentence's one row (id,
    card_ids, ...) or none. A batch of due targets is kept until its cards are used up, and collected once more before
    the session says that nothing is left. Only ids of shown sentences and answered cards are held here.
    """

    collect: Callable[[], DataFrame]
    choose: Callable[[DataFrame, list[int], list[int]], DataFrame]
    recent: list[int] = field(default_factory=list)
    keep: int = 200
    due: DataFrame | None = None
    goal: set[int] | None = None
    known: set[int] = field(default_factory=set)
    shown: list[int] = field(default_factory=list)
    waiting: list = field(default_factory=list)
    history: list = field(default_factory=list)
    active: object = None

    def next(self):
        """The next task, or None when no due card or no sentence is left, also after due cards are collected anew."""
        if self.waiting:
            self.active = self.waiting.pop(0)
            return self.active
        fresh = self.due is None
        for _ in range(2):
            if fresh:
                self.due = self.collect()
                if self.goal is None:
                    self.goal = {r.card_id for r in self.due.select("card_id").distinct().collect()}
            # a card that was answered since the batch was collected is in it as it was before
            hidden = self.known | (set() if fresh else {c for _, cards in self.history for c in cards})
            left = self.due.filter(~F.col("card_id").isin(*hidden)) if hidden else self.due
            if not left.isEmpty():
                rows = self.choose(left, list(self.shown), list(self.recent)).take(1)
                if rows:
                    self.active = rows[0]
                    self.shown.append(self.active.id)
                    self.recent = [i for i in self.recent if i != self.active.id][-(self.keep - 1) :] + [self.active.id]
                    return self.active
            if fresh:
                break
            fresh = True
        self.active = None
        return None

    def answered(self, known: list[int], unknown: list[int]):
        """Notes the active task's answers and goes on; known cards stay hidden for the session."""
        self.history.append((self.active, [*known, *unknown]))
        self.known |= set(known)
        return self.next()

    def undo(self):
        """Takes the last answers back: that task is active again, and the one that it interrupts comes next."""
        if not self.history:
            return self.active
        task, cards = self.history.pop()
        self.known -= set(cards)
        if self.active is not None and self.active is not task:
            self.waiting.insert(0, self.active)
        self.active = task
        return task

    def progress(self) -> tuple[int, int]:
        done = {c for _, cards in self.history for c in cards}
        return len(done & (self.goal or set())), len(self.goal or ())
