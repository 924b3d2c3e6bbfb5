"""How many records share a token with another, by inclusion and exclusion over sets of tokens: numpy inside tasks.

Rows are (t, part, parts, salt, mine, id, holders, prefix): a record's token t and its tokens before it, in one order of all
tokens; one of the other side (not ``mine``) stands for so many *holders*.
A task's rows are sorted by unit (t, part, salt), in a unit those of the other side first. The sets that a unit counts are t
with at least one token of the prefix; of several *parts* it counts those whose last token before t is *part* modulo *parts*.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: New rows that a task takes before it counts, and sets that one step of the count makes.
ROWS, STEP = 1 << 18, 1 << 21


class Side(NamedTuple):
    """Rows: their unit, where their tokens start and how many they are; all tokens, and which may be the last before t."""

    unit: np.ndarray
    start: np.ndarray
    size: np.ndarray
    tokens: np.ndarray
    last: np.ndarray


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def _distinct(side: Side, m: int) -> tuple[Side, np.ndarray]:
    """*side* with one row for those that agree, and for each row which one that is."""
    code, base = side.unit.astype(np.int64), int(side.unit.max(initial=0)) + 1
    for k in range(int(side.size.max(initial=0))):
        at = np.flatnonzero(side.size > k)
        of, seen = _numbered(code[at] * m + side.tokens[side.start[at] + k])
        code[at] = base + of
        base += len(seen)
    of, seen = _numbered(code)
    one = np.empty(len(seen), np.int64)
    one[of] = np.arange(len(of))
    return side._replace(unit=side.unit[one], start=side.start[one], size=side.size[one]), of


def _longer(side: Side, row: np.ndarray, size: np.ndarray, node: np.ndarray, m: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's set (node) with each one of the *size* tokens before it: row, how many tokens are before that one, key."""
    at = np.repeat(np.arange(len(row)), size)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    token = side.start[row[at]] + place
    if first:
        may = np.flatnonzero(side.last[token])
        at, place, token = at[may], place[may], token[may]
    return row[at], place, node[at].astype(np.int64) * m + side.tokens[token]


def shared(theirs: Side, holders: np.ndarray, mine: Side, m: int, step: int = STEP) -> np.ndarray:
    """Per row of *mine*: what sets of t and more tokens add to the number of *theirs* that share a token. Tokens are below *m*.

    Sets grow by a token at a time, and only those that both sides hold grow. Steps of more than *step* sets are divided
    by the sets that they grow from, so that memory is bounded.
    """
    theirs, of = _distinct(theirs, m)
    mine, back = _distinct(mine, m)
    weight, n = np.bincount(of, holders, len(theirs.unit)), np.zeros(len(mine.unit), np.int64)
    units = 1 + max(int(x.unit.max(initial=0)) for x in (theirs, mine))
    todo = [(*((np.arange(len(x.unit)), x.size, x.unit) for x in (theirs, mine)), units, 0)]
    while todo:
        a, b, nodes, depth = todo.pop()
        total = int(a[1].sum() + b[1].sum())
        if total > step and nodes > 1:
            upto = np.cumsum(np.bincount(a[2], a[1], nodes) + np.bincount(b[2], b[1], nodes))
            half = min(int(np.searchsorted(upto, total / 2)), nodes - 2) + 1
            for low, high in ((0, half), (half, nodes)):
                todo.append((*((r[i], s[i], x[i] - low) for r, s, x in (a, b) for i in [(x >= low) & (x < high)]), high - low, depth))
            continue
        (row_a, rest_a, key_a), (row_b, rest_b, key_b) = _longer(theirs, *a, m, depth == 0), _longer(mine, *b, m, depth == 0)
        of, known = _numbered(key_a)
        at = pc.index_in(pa.array(key_b), value_set=known).fill_null(-1).to_numpy()
        hit = at >= 0
        held = np.bincount(of, weight[row_a], len(known))
        n += (1 if depth % 2 else -1) * np.bincount(row_b[hit], held[at[hit]], len(n)).astype(np.int64)
        met = np.zeros(len(known), bool)
        met[at[hit]] = True
        number = np.cumsum(met) - 1
        keep_a, keep_b = met[of] & (rest_a > 0), hit & (rest_b > 0)
        if keep_a.any() and keep_b.any():
            todo.append(((row_a[keep_a], rest_a[keep_a], number[of[keep_a]]), (row_b[keep_b], rest_b[keep_b], number[at[keep_b]]), int(met.sum()), depth + 1))
    return n[back]


def _met(rows: pa.Table, step: int) -> tuple[pa.RecordBatch, pa.Table]:
    """(id, n) of the rows that are ``mine``, and the others of the last unit, whose own rows may go on."""
    number = lambda name: rows[name].to_numpy().astype(np.int64)
    mine = rows["mine"].to_numpy().astype(bool)
    t, part, parts, salt = (number(x) for x in ("t", "part", "parts", "salt"))
    unit = np.concatenate([[0], np.cumsum((np.diff(t) != 0) | (np.diff(part) != 0) | (np.diff(salt) != 0))])
    lists = rows["prefix"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    tokens = lists.flatten().to_numpy().astype(np.int64)
    last = tokens % np.repeat(parts, size) == np.repeat(part, size)
    codes, seen = _numbered(tokens)
    start = np.cumsum(size) - size
    other, own = (Side(unit[x], start[x], size[x], codes, last) for x in (~mine, mine))
    n = shared(other, number("holders")[~mine], own, len(seen) + 1, step)
    found = rows["id"].filter(pa.array(mine)).filter(pa.array(n != 0)).combine_chunks()
    return pa.RecordBatch.from_arrays([found, pa.array(n[n != 0])], ["id", "n"]), rows.filter(pa.array(~mine & (unit == unit[-1])))


def meet(batches: Iterator[pa.RecordBatch], rows: int = ROWS, step: int = STEP) -> Iterator[pa.RecordBatch]:
    """(id, n) for sorted rows; n are parts of sums, the same id comes with each of its tokens."""
    kept, held, new = None, [], 0
    for batch in batches:
        held.append(batch)
        new += len(batch)
        if new >= rows:
            out, kept = _met(_table(kept, held), step)
            yield out
            held, new = [], 0
    if new:
        yield _met(_table(kept, held), step)[0]


def _table(kept: pa.Table | None, batches: list[pa.RecordBatch]) -> pa.Table:
    new = pa.Table.from_batches(batches)
    return pa.concat_tables([kept, new]) if kept is not None else new
