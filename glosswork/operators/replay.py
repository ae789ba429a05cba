"""Logs folded to states: a review session's to what it holds and needs next, a card's answers to its schedule.

Log rows are (session, ts, seq, kind, task, cards, unknown). Kinds: ``collect`` (due cards were collected), ``select`` (a
search found a sentence for cards, or none: task is null), ``answer`` (the active sentence's cards, some unknown) and
``undo``. A search that comes back while a sentence is active is dropped, as is an answer without one. Known cards stay
hidden; others that were answered are hidden until due cards are collected anew, which is done once before the session
ends. Undo makes the last sentence active again, and what it interrupts comes next.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Recently shown sentences that are kept.
RECENT = 200
LOG = ("session", "ts", "seq", "kind", "task", "cards", "unknown")
STATE = "session long, active long, answered long, waiting long, known long, shown long, done long, total long, needs string"


def begin() -> dict:
    return {"active": None, "due": None, "fresh": False, "ended": False, "goal": None, "known": [], "shown": 0, "recent": [], "waiting": [], "history": []}


def advance(s: dict, kind: str, task: int | None, cards: list[int], unknown: list[int]) -> None:
    """Applies one row of the log to a session's state. A sentence is [task, cards]."""
    if kind == "collect":
        s.update(due=cards, fresh=True, ended=False, goal=cards if s["goal"] is None else s["goal"])
    elif kind == "select" and s["active"] is None:
        if task is not None:
            s.update(active=[task, cards], shown=s["shown"] + 1, fresh=False, recent=([i for i in s["recent"] if i != task] + [task])[-RECENT:])
        elif s["fresh"]:
            s["ended"] = True
        else:
            s["due"] = None  # once more with what is due now
    elif kind == "answer" and s["active"] is not None:
        s["history"].append(s["active"])
        s["known"] = sorted({*s["known"], *(c for c in s["active"][1] if c not in unknown)})
        s["active"] = s["waiting"].pop(0) if s["waiting"] else None
    elif kind == "undo" and s["history"]:
        last = s["history"].pop()
        s["known"] = [c for c in s["known"] if c not in last[1]]
        if s["active"] is not None and s["active"][0] != last[0]:
            s["waiting"].insert(0, s["active"])
        s["active"] = last


def shown_state(session: int, s: dict) -> tuple:
    """What a session holds, and whether it needs its active sentence answered, a collection, a search, or nothing more."""
    seen = {c for _, cards in s["history"] for c in cards}
    hidden = {*s["known"], *(() if s["fresh"] else seen)}
    needs = "answer" if s["active"] is not None else "end" if s["ended"] else "collect" if s["due"] is None else "search"
    if needs == "search" and not set(s["due"]) - hidden:
        needs = "end" if s["fresh"] else "collect"
    goal = set(s["goal"] or ())
    return session, s["active"][0] if s["active"] else None, len(s["history"]), len(s["waiting"]), len(s["known"]), s["shown"], len(goal & seen), len(goal), needs


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATE.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in STATE.split(", ")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * len(names), types)], names)
    now, state = None, None
    for batch in batches:
        rows = []
        for session, kind, task, cards, unknown in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or session != now:
                if state is not None:
                    rows.append(shown_state(now, state))
                now, state = session, begin()
            advance(state, kind, task, cards or [], unknown or [])
        yield out(rows)
    if state is not None:
        yield out([shown_state(now, state)])


def sessions(log: DataFrame) -> DataFrame:
    """Each session's state after its log. Rows stream by in order; a task holds one session's state, not its log."""
    ordered = log.repartition("session").sortWithinPartitions("session", "ts", "seq")
    return ordered.select("session", "kind", "task", "cards", "unknown").mapInArrow(_fold, STATE)


# ---- cards

#: Days beyond which an interval doesn't grow.
FAR = 1 << 60
CARD = "card_id long, n_answers long, ivl long, factor long, lapses long, reps long, review boolean"


def card_step(ivl: int, factor: int, lapses: int, reps: int, review: bool, unknown: bool) -> tuple[int, int, int, int, bool]:
    """A card's state after an answer, as ``schedule.step`` has it."""
    ease = factor or 2500
    if unknown:
        return 0, max(1300, ease - 200), lapses + int(review), reps + 1, False
    base = max(1, ivl)
    return min(FAR, max(base + 1, round(base * max(1.3, max(1300, ease) / 1000.0)))), ease, lapses, reps + 1, True


def _fold_cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CARD.split(", ")]
    types = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in CARD.split(", ")]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * len(names), types)], names)
    now, n, state = None, 0, None
    for batch in batches:
        rows = []
        for card, unknown, *start in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or card != now:
                if state is not None:
                    rows.append((now, n, *state))
                now, n, state = card, 0, tuple(start)
            n, state = n + 1, card_step(*state, bool(unknown))
        yield out(rows)
    if state is not None:
        yield out([(now, n, *state)])


def cards_after(cards: DataFrame, answers: DataFrame) -> DataFrame:
    """``cards`` (card_id, ivl, factor, lapses, reps, review) after their ``answers`` (card_id, ts, seq, is_unknown), which
    stream by in order; a task holds one card's state, not its history."""
    state = ("ivl", "factor", "lapses", "reps")
    met = answers.join(cards.select("card_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in state], F.coalesce("review", F.lit(False)).alias("review")), "card_id")
    ordered = met.repartition("card_id").sortWithinPartitions("card_id", "ts", "seq")
    return ordered.select("card_id", "is_unknown", *state, "review").mapInArrow(_fold_cards, CARD)


# what workers run of this module travels with its data, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
