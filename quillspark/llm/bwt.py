"""Burrows-Wheeler transforms of string collections, and their merge by iterative interleave refinement."""

from __future__ import annotations

import numpy as np


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffix starts in order, the two symbols before each, number of end marks) of a shard, by prefix doubling.

    Strings stand one after the other, each with two end marks; marks sort before all bytes, later ones before
    earlier ones, and otherwise in the strings' order. A symbol is a byte plus one. A pair is 0 for the first two
    suffixes of a string, which have no two symbols before them.
    """
    text = np.frombuffer(b"\0\0".join(strings) + b"\0\0", np.uint8).astype(np.int64) + 1
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(lengths + 2) - 1
    m, n = len(strings), len(text)
    text[ends] = text[ends - 1] = 0
    rank = text + 2 * m
    rank[ends], rank[ends - 1] = np.arange(m), np.arange(m, 2 * m)
    step = 1
    order = np.argsort(rank)  # equal ranks stay equal, so no order among them matters
    while True:
        r = rank[order]
        fresh = np.concatenate(([0], np.cumsum(r[1:] != r[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        follow = np.zeros(n, np.int64)
        follow[:-step] = rank[step:] + 1
        rank = rank * (n + 2) + follow
        order = np.argsort(rank)
        step *= 2
    pairs = np.zeros(n, np.int64)
    pairs[2:] = text[:-2] * 257 + text[1:-1]
    begin = ends - lengths - 1
    pairs[begin] = pairs[np.minimum(begin + 1, n - 1)] = 0
    return order, pairs[order], 2 * m


def merge(parts: list[tuple[np.ndarray, np.ndarray, int]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each suffix in merged order by ``depth`` symbols, its place within the shard, the number of its interval).

    No suffix is sorted again, and no text is looked at. A round takes the interleave by h symbols to that by h + 2:
    the pairs of symbols before the suffixes, stably sorted, say where each suffix that is two longer goes. Suffixes
    part in the round in which their pairs differ or what follows them has parted, so an interval after ``depth``
    symbols (an even number) is a set of suffixes with a common prefix of that length. A round that changes nothing
    is the last.
    """
    sizes = [len(p[0]) for p in parts]
    used, symbols = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    symbols = symbols.astype(np.uint16 if len(used) <= 65536 else np.uint32)
    kind = np.uint8 if len(parts) <= 256 else np.uint16
    z = np.repeat(np.arange(len(parts), dtype=kind), sizes)
    half = [p[2] // 2 for p in parts]
    marks = np.tile(np.repeat(np.arange(len(parts), dtype=kind), half), 2)  # last marks, then those before them
    c = np.empty(len(z), symbols.dtype)
    interval, edge = np.zeros(len(z), np.int32), np.ones(len(z), bool)
    for _ in range(depth // 2):
        c[np.argsort(z, kind="stable")] = symbols
        order = np.argsort(c, kind="stable")
        new, pair, follows = z[order], c[order], interval[order]
        new[: len(marks)] = marks  # end marks keep the strings' order, and share nothing
        edge[1:] = (pair[1:] != pair[:-1]) | (follows[1:] != follows[:-1])
        edge[: len(marks)] = True
        parted = np.cumsum(edge, dtype=np.int32)
        done = parted[-1] == interval[-1] and (new == z).all()
        z, interval = new, parted
        if done:
            break
    place = np.empty(len(z), np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate([np.arange(k) for k in sizes])
    return z, place, interval


def least_by_window(strings: list[bytes], docs: np.ndarray, shard_of: list[int], width: int) -> list[np.ndarray]:
    """For each string and each of its windows of ``width`` bytes (an even number), the least of ``docs`` over the strings that hold the window."""
    windows = np.fromiter((max(0, len(s) - width + 1) for s in strings), np.int64, len(strings))
    return np.split(least_of_windows(strings, docs, shard_of, width), np.cumsum(windows)[:-1]) if strings else []


def least_of_windows(strings: list[bytes], docs: np.ndarray, shard_of: list[int], width: int) -> np.ndarray:
    """What ``least_by_window`` gives, all strings' windows one after the other."""
    docs = np.asarray(docs, np.int64)
    windows = np.fromiter((max(0, len(s) - width + 1) for s in strings), np.int64, len(strings))
    out = np.repeat(docs, windows)
    shards: dict[int, list[int]] = {}
    for i, k in enumerate(shard_of):
        shards.setdefault(k, []).append(i)
    members = [shards[k] for k in sorted(shards)]
    if not members:
        return out
    parts = [transform([strings[i] for i in of]) for of in members]
    z, place, interval = merge(parts, width)
    every = np.array([i for of in members for i in of])
    sizes = np.fromiter((len(strings[i]) + 2 for i in every), np.int64, len(every))
    starts = np.cumsum(sizes) - sizes
    shift = np.concatenate(([0], np.cumsum([len(p[0]) for p in parts])))
    places = np.concatenate([p[0] + s for p, s in zip(parts, shift, strict=False)])
    at = places[shift[z] + place]  # where in the text each suffix begins, in merged order
    j = np.repeat(np.arange(len(every)), sizes)[at]
    full = at + width + 1 < (starts + sizes)[j]  # the others are shorter than a window
    at, j, interval = at[full], j[full], interval[full]
    if not len(at):
        return out
    # intervals: suffixes that have not parted after ``width`` symbols
    fresh = np.concatenate(([True], interval[1:] != interval[:-1]))
    least = np.minimum.reduceat(docs[every[j]], np.flatnonzero(fresh))
    out[(np.cumsum(windows) - windows)[every[j]] + at - starts[j]] = least[np.cumsum(fresh) - 1]
    return out
