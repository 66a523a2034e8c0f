"""Predicates on a job's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .memo import memo
from .text import as_col

# The scheduler's state words.
FAILED_STATES = ["FAILED", "TIMEOUT", "OUT_OF_MEMORY", "NODE_FAIL", "BOOT_FAIL", "DEADLINE"]
TERMINAL_STATES = [
    "COMPLETED", "FAILED", "TIMEOUT", "OUT_OF_MEMORY", "CANCELLED", "NODE_FAIL", "BOOT_FAIL",
    "DEADLINE", "PREEMPTED", "REVOKED", "SPECIAL_EXIT",
]
IN_PROGRESS_STATES = [
    "RUNNING", "PENDING", "SUSPENDED", "CONFIGURING", "COMPLETING", "RESIZING", "REQUEUED",
    "REQUEUE_HOLD", "REQUEUE_FED", "SIGNALING", "STAGE_OUT", "STOPPED", "SPECIAL_EXIT",
]
# States in which the CPU total says nothing about what the job did.
CPU_EXPLAINED_STATES = ["OUT_OF_MEMORY", "NODE_FAIL", "PREEMPTED", "BOOT_FAIL", "DEADLINE"]

NOOP_MIN_ELAPSED = 300.0
NOOP_CPU_SECONDS = 10.0


@memo
def base_state(state) -> Column:
    """First word of the state: ``CANCELLED by 0`` is ``CANCELLED``."""
    return F.nullif(_word(state), F.lit(""))


def _word(state) -> Column:
    return F.regexp_extract(as_col(state), r"^\s*(\S+)", 1)


def _in(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.isin(words), F.lit(False))


@memo
def failed(state) -> Column:
    return _in(_word(state), FAILED_STATES)


@memo
def completed(state) -> Column:
    return _in(_word(state), ["COMPLETED"])


@memo
def cancelled(state) -> Column:
    return _in(_word(state), ["CANCELLED"])


@memo
def is_state(state, word: str) -> Column:
    return _in(_word(state), [word])


@memo
def step_in_progress(state) -> Column:
    return _in(_word(state), IN_PROGRESS_STATES)


@memo
def in_progress(state, live) -> Column:
    """Still going, unless the live snapshot was asked and does not know the job."""
    gone = F.coalesce(~as_col(live), F.lit(False))
    return ~gone & _in(_word(state), IN_PROGRESS_STATES)


@memo
def open_ended(state, end) -> Column:
    """A record with a state but no end that is not terminal: elapsed runs to now."""
    b = base_state(state)
    return b.isNotNull() & as_col(end).isNull() & ~_in(b, TERMINAL_STATES)


@memo
def noop(open_ended_, elapsed, total_cpu) -> Column:
    """Held an allocation for minutes and used seconds of CPU (both known)."""
    return F.coalesce(
        ~as_col(open_ended_)
        & (as_col(elapsed) > NOOP_MIN_ELAPSED)
        & (as_col(total_cpu) < NOOP_CPU_SECONDS),
        F.lit(False),
    )


@memo
def usable(open_ended_="open_ended", elapsed="elapsed") -> Column:
    return ~as_col(open_ended_) & as_col(elapsed).isNotNull()
