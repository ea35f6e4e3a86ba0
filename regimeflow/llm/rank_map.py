"""(left token, right token) -> rank, as three arrays: small enough for a literal, fast enough for array operations."""

from __future__ import annotations

from itertools import chain

import numpy as np

NO_RANK = 1 << 30
SLACK = 3  # places per entry
Rows = dict[int, list[tuple[int, int]]]


class RankMap:
    """A row-displaced table: the row of a left token starts at ``shift[left]``, the entry of a right token stands
    ``right`` further on, with its owner and its rank."""

    def __init__(self, rows: Rows, n_tokens: int):
        entries_in_all = sum(map(len, rows.values()))
        room = SLACK * entries_in_all
        owner = np.full(room + n_tokens, -1, np.int32)
        rank_at = np.zeros_like(owner)
        shift = np.zeros(n_tokens, np.int32)
        places = np.random.default_rng(0).integers(0, room + 1, (n_tokens, 64))
        for left, entries in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):  # large rows while there is room
            columns = np.array([e[0] for e in entries])
            at = _first_fit(owner, columns, places[left])
            owner[columns + at], rank_at[columns + at], shift[left] = left, [e[1] for e in entries], at
        places_needed = int(shift.max(initial=0)) + n_tokens  # a place for every right token behind every row's start
        more = max(places_needed - len(owner), 0)
        self.owner = np.pad(owner, (0, more), constant_values=-1)[:places_needed]
        self.rank_at, self.shift = np.pad(rank_at, (0, more))[:places_needed], shift

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.shift[left] + right
        return np.where(self.owner[at] == left, self.rank_at[at], NO_RANK)


def _first_fit(owner: np.ndarray, columns: np.ndarray, places: np.ndarray) -> int:
    """The first of the places (then of all later ones) at which all of a row's columns are free."""
    end = len(owner) - int(columns.max())
    stretches = (np.arange(at, min(at + 4096, end)) for at in (*range(int(places[0]), end, 4096), *range(0, end, 4096)))
    for offsets in chain((places,), stretches):
        free = offsets[owner[offsets + columns[0]] == -1]
        for c in columns[1:]:
            if not len(free):
                break
            free = free[owner[free + c] == -1]
        if len(free):
            return int(free[0])
    raise ValueError("the rank map is too full")
