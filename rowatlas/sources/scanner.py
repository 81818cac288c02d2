"""Record boundaries of delimited and line files, on bytes.

A scanner is a state machine that can start in any state at any byte. So blocks of one
file are scanned side by side: first every block's outcome for every state it may start
in, then, the states being known, the records themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: States between two bytes. RECORD: nothing of the next record was seen; CR: as RECORD, but a LF still belongs to the last end.
RECORD, FIELD, BARE, QUOTED, CLOSED, CR = range(6)
STATES = (RECORD, FIELD, BARE, QUOTED, CLOSED, CR)


@dataclass(frozen=True)
class Dialect:
    """Delimiter and quote, one byte each, unlike each other and no line end. Without a quote: plain lines."""

    delimiter: int | None = 44
    quote: int | None = 34

    def __post_init__(self):
        if self.quote is None and self.delimiter is None:
            return
        if self.delimiter == self.quote or {self.delimiter, self.quote} & {10, 13, None}:
            raise ValueError("delimiter and quote are two bytes and no line ends")


CSV, TSV, LINES = Dialect(), Dialect(delimiter=9), Dialect(None, None)


class Scanner:
    """``scan`` walks one block: calls ``start(at)`` and ``end(at)``, stops if they return False."""

    def __init__(self, dialect: Dialect = CSV):
        self.dialect = dialect
        lines = dialect.quote is None
        self.stop = re.compile(b"[\r\n]") if lines else re.compile(b"[\r\n" + re.escape(bytes([dialect.delimiter])) + b"]")
        self.lines = lines

    def scan(self, data: bytes, state: int, start: Callable[[int], object], end: Callable[[int], object], at: int = 0) -> tuple[int, int]:
        """State after the block, and the place where it stopped."""
        n, quote, delimiter = len(data), self.dialect.quote, self.dialect.delimiter
        while at < n:
            if state == CR:
                at += data[at] == 10
                state = RECORD
                continue
            if state == RECORD:
                if start(at) is False:
                    return state, at
                state = FIELD
            if state == QUOTED:
                at = data.find(quote, at)
                if at < 0:
                    return QUOTED, n
                state, at = CLOSED, at + 1
                continue
            if not self.lines and state == FIELD and data[at] == quote:
                state, at = QUOTED, at + 1
                continue
            if state == CLOSED and data[at] == quote:
                state, at = QUOTED, at + 1
                continue
            m = self.stop.search(data, at)
            if m is None:
                return BARE, n
            at, byte = m.start(), data[m.start()]
            if byte == delimiter:
                state, at = FIELD, at + 1
                continue
            if end(at) is False:
                return state, at
            state, at = (CR if byte == 13 else RECORD), at + 1
        return state, n


def plain_block(data: bytes, state: int, dialect: Dialect) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Starts, ends and the state after a block without quotes, in whole arrays; None if there is a quote."""
    if not data or state == QUOTED or (dialect.quote is not None and dialect.quote in data):
        return None
    raw = np.frombuffer(data, np.uint8)
    ends = np.nonzero((raw == 10) | (raw == 13))[0]
    # A LF after a CR belongs to the end that the CR made, in this block or the one before.
    before = np.where(ends > 0, raw[ends - 1], 13 if state == CR else 0)
    second = (raw[ends] == 10) & (before == 13)
    after = ends[~second] + 1
    after = after + ((raw[ends[~second]] == 13) & (raw[np.minimum(after, len(raw) - 1)] == 10) & (after < len(raw)))
    ends = ends[~second]
    first = np.array([1 if state == CR and raw[0] == 10 else 0] if state in (RECORD, CR) else [], np.int64)
    starts = np.concatenate([first, after])
    last = raw[-1]
    now = CR if last == 13 else RECORD if last == 10 else FIELD if last == dialect.delimiter else BARE
    return starts[starts < len(raw)], ends, now


@dataclass
class Outcome:
    """For each state at the start of a block: the state after it, and the records that start in it."""

    states: tuple[int, ...]
    starts: tuple[int, ...]


def outcome(data: bytes, dialect: Dialect) -> Outcome:
    """Outcomes for all states. A walk ends where it meets the first walk at the start of a record."""
    if data and (dialect.quote is None or dialect.quote not in data):
        found = [(QUOTED, 0) if entry == QUOTED else (lambda b: (b[2], len(b[0])))(plain_block(data, entry, dialect)) for entry in STATES]
        return Outcome(tuple(s for s, _ in found), tuple(n for _, n in found))
    scanner = Scanner(dialect)
    known: dict[int, int] = {}  # place of a record's start: its number in the first walk
    states, counts = [], []
    for entry in STATES:
        seen: list[int] = []

        def start(at: int, seen=seen) -> bool:
            if states and at in known:
                return False
            seen.append(at)
            return True

        after, at = scanner.scan(data, entry, start, lambda _: True)
        if not states:
            known = {a: k for k, a in enumerate(seen)}
            states.append(after)
            counts.append(len(seen))
        elif at < len(data) and at in known:
            states.append(states[0])
            counts.append(len(seen) + counts[0] - known[at])
        else:
            states.append(after)
            counts.append(len(seen))
    return Outcome(tuple(states), tuple(counts))


@dataclass
class Scan:
    spans: list[tuple[int, int]]
    diagnostic: tuple[str, int, int] | None


def spans(data: bytes, dialect: Dialect = CSV) -> Scan:
    """All records of a whole document as (start, end), terminators outside; and what is wrong at its end."""
    starts: list[int] = []
    ends: list[int] = []
    state, _ = Scanner(dialect).scan(data, RECORD, starts.append, ends.append)
    diagnostic = ("unterminated_quoted_field", len(data), starts[-1]) if state == QUOTED else None
    if len(starts) > len(ends):
        ends.append(len(data))
    return Scan(list(zip(starts, ends, strict=True)), diagnostic)
