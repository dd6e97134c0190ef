"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Every window of WIDTH bytes belongs to its anchor, the ANCHOR bytes of least hash in it, so equal windows
have equal anchors. Consecutive windows with one anchor form a segment. Anchors are shared out over buckets:

1. A bucket learns hashes of its anchors' segments. An anchor with one segment needs nothing more: the
   segment's least document goes back to the chunks that hold it.
2. Where segments of an anchor differ, their bytes follow. Buckets build the Burrows-Wheeler transform of each
   shard of strings and merge them by interleave refinement; intervals of suffixes that share WIDTH bytes are the
   repeated windows, and their least documents go back. Of each string, the part between its first and last
   window whose hash occurs again goes in: outside of it no window can be repeated. An anchor with very many segments sends windows
   instead, shared out by their own hash, so that no bucket holds a hot anchor's contexts.

Chunks (documents by hash) combine copies before anything is sent and compute their anchors anew in each
round; the documents' bytes are shuffled once. Within a chunk copies of a segment are told by 64-bit hashes and
confirmed byte by byte; an anchor for which the bytes contradict counts as hot. Between chunks, segments of one
anchor are told by 48 bits, so a wrong answer takes two different ones among the at most HOT_ALL of an anchor
that agree in them: with 1e13 such pairs, 0.04 are expected. Merged strings are told apart by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bwt import least_of_windows

WIDTH, ANCHOR = 50, 24
_SPAN = WIDTH - ANCHOR + 1
#: Bytes of text in a chunk and of positions treated at once (so few that they stay in the cache; no result depends on it); chunks and buckets at least.
CHUNK_BYTES, BLOCK, CHUNKS, BUCKETS = 8 << 20, 1 << 16, 1024, 512
#: Segments of an anchor in one chunk, and in all, from which it counts as hot.
HOT_HERE, HOT_ALL = 32, 512
SHARDS = 8
#: Bytes of strings whose transforms are merged at once, about.
PART_BYTES = 128 << 10
ONE, AMBIGUOUS, HOT = 0, 1, 2
#: Bytes of a segment's hash that are sent; all ones mark a hot anchor.
SENT = 6
_MARK = np.uint64((1 << 8 * SENT) - 1)
#: Bits of a segment's hash that tell copies within a chunk, before their bytes are compared.
TOLD_BY = np.uint64(2**64 - 1)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 2 * WIDTH)
        for name, b in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


class Runs:
    """The segments of a chunk's documents: parallel arrays start, length (windows), doc (place), anchor and whole (hashes)."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        n = len(self.bytes)
        data = np.frombuffer(self.bytes, np.uint8)
        usable = np.ones(n, bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            usable[max(s, e - WIDTH + 1) : e] = False
        parts, at = [], 0
        while at < n:
            end = min(n, at + BLOCK)
            if (p := self._block(data, usable, at, end)) is None:
                at = end
                continue
            last = int(p[0][-1])
            if at < last and last + p[1][-1] == end < n:  # may go on behind the block, which the next one sees
                p, end = tuple(x[:-1] for x in p), last
            parts.append(p)
            at = end
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.start, self.length, self.anchor, self.whole = (np.concatenate(x) for x in zip(*(parts or [none]), strict=True))
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def _block(self, data, usable, a: int, b: int):
        """Segments of windows that start in [a, b)."""
        pos = np.flatnonzero(usable[a:b])
        if not len(pos):
            return None
        part = data[a : min(len(data), b + WIDTH - 1)]
        self._sums, (_, down) = self._prefix(part), _powers(len(part) + 1)
        sums = self._sums
        grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(sums) - ANCHOR])
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        reach = 1
        while 2 * reach <= _SPAN:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if rest := _SPAN - reach:
            low = np.minimum(low[:-rest], low[rest:])
        at = (low[pos] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (pos[1:] != pos[:-1] + 1))))
        length = np.diff(np.concatenate((first, [len(pos)])))
        start = pos[first]
        whole = _mixed((sums[start + length + WIDTH - 1] - sums[start]) * down[start] + length.astype(np.uint64))
        return start + a, length, grams[at[first]], whole

    @staticmethod
    def _prefix(part: np.ndarray) -> np.ndarray:
        up, _ = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * up[:-1], out=sums[1:])
        return sums

    def string(self, i: int) -> bytes:
        s = int(self.start[i])
        return self.bytes[s : s + int(self.length[i]) + WIDTH - 1]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether segments ``a`` and ``b`` (places, one by one) hold the same bytes."""
        data, top = np.frombuffer(self.bytes, np.uint8), np.arange(WIDTH + _SPAN - 1)
        out = self.length[a] == self.length[b]
        for i in range(0, len(a), 1 << 15):
            x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            at = np.minimum(top, (self.length[x] + WIDTH - 2)[:, None])  # beyond its end, the last byte again
            last = len(data) - 1
            out[i : i + (1 << 15)] &= (data[self.start[x][:, None] + at] == data[np.minimum(self.start[y][:, None] + at, last)]).all(1)
        return out

    def windows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of segments ``of``, which ascend, and hashes of their bytes."""
        start = _ranges(self.start[of], self.length[of])
        return start, self.hashes(np.frombuffer(self.bytes, np.uint8), start)

    @staticmethod
    def hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``data`` that begin at ``start``, ascending."""
        out = np.empty(len(start), np.uint64)
        edges = np.searchsorted(start, np.arange(0, len(data) + BLOCK, BLOCK)).tolist()
        for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if i < j:
                a = k * BLOCK
                part = data[a : min(len(data), a + BLOCK + WIDTH - 1)]
                sums, (_, down) = Runs._prefix(part), _powers(len(part) + 1)
                s = start[i:j] - a
                out[i:j] = _mixed((sums[s + WIDTH] - sums[s]) * down[s])
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _ordered(first: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The stable order by ``first``, then by ``then``: most of ``first`` stand alone, so the rest is looked at for the others only."""
    order = np.argsort(first)
    x = first[order]
    same = x[1:] == x[:-1]
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same))) if len(x) else order
    o = order[tied]
    order[tied] = o[np.lexsort((o, *(k[o] for k in reversed(then)), first[o]))]
    return order


def _keys(runs: Runs, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What is sent of each segment's anchor (``width`` bytes) and whole hash (SENT bytes)."""
    return runs.anchor >> np.uint64(64 - 8 * width), np.minimum(runs.whole >> np.uint64(64 - 8 * SENT), _MARK - np.uint64(1))


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, plane by plane: planes that hardly vary compress to nothing."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _zip(b: bytes) -> bytes:
    return zstandard.compress(b, 3)


def _unzip(b: bytes) -> bytes:
    return zstandard.decompress(b)


def _put(columns: list[tuple[np.ndarray, int]]) -> bytes:
    return b"".join(_pack(x, w) for x, w in columns)


def _packed(columns: list[tuple[np.ndarray, int]], ns: np.ndarray) -> pa.Array:
    """What ``_put`` makes of the first ``ns[0]`` rows, of the next ``ns[1]`` and so on."""
    ends = np.cumsum(ns * sum(w for _, w in columns))
    at = _ranges(np.concatenate(([0], ends[:-1])), ns) if len(ns) else np.zeros(0, np.int64)
    step = np.repeat(ns, ns)
    out = np.empty(ends[-1] if len(ns) else 0, np.uint8)
    for x, w in columns:
        planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
        for k in range(w):
            out[at] = planes[:, k]
            at += step
    offsets = np.concatenate(([0], ends))
    return pa.Array.from_buffers(pa.large_binary(), len(ns), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


class Blobs:
    """A table's column ``b``, whose blobs are read together."""

    def __init__(self, table: pa.Table):
        col = table.column("b").cast(pa.large_binary()).combine_chunks()
        _, offsets, data = col.buffers() if len(col) else (None, None, None)
        self.at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        self.ns = table.column("n").to_numpy()

    def rows(self, of: np.ndarray, widths: list[int]) -> list[np.ndarray]:
        """The columns packed in the blobs ``of``, one blob's rows after the other's."""
        ns = self.ns[of]
        at, step = _ranges(self.at[of], ns), np.repeat(ns, ns)
        out = []
        for w in widths:
            x = np.zeros((len(at), 8), np.uint8)
            for k in range(w):
                x[:, k] = self.data[at]
                at += step
            out.append(x.view(np.uint64).ravel())
        return out

    def tail(self, i: int, skip: int) -> bytes:
        """What follows the first ``skip`` bytes of blob ``i``."""
        return self.data[self.at[i] + skip : self.at[i + 1]].tobytes()


_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("b", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("n", pa.int64()), ("b", pa.binary())])
_DDL = {id(_SENT): "bucket long, chunk long, n long, b binary", id(_TOLD): "chunk long, kind long, n long, b binary"}
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


class Chunk:
    """A chunk's documents in a fixed order with their segments; documents without id or text take no part in the search."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
        rows = sorted(((i is None, i or 0, t or b"") for i, t in zip(ids, texts, strict=True)))
        self.idle = [(None, t) for none, _, t in rows if none]
        self.ids = np.array([i for none, i, _ in rows if not none], np.int64)
        self.texts = [t for none, _, t in rows if not none]
        self.number = table.column("chunk")[0].as_py() if table.num_rows else 0
        self.runs = Runs(self.texts)
        self.docs = self.ids[self.runs.doc] if len(self.ids) else np.zeros(0, np.int64)

    def records(self, width: int, confirmed: bool = True):
        """Order of the segments by (anchor, whole), heads of the same ones, the heads' anchor, whole and least document, and anchors whose hashes lied (looked for unless ``confirmed`` is false)."""
        h, s = _keys(self.runs, width)
        whole = self.runs.whole & TOLD_BY
        order = _ordered(self.runs.anchor, whole)  # documents ascend from the start
        a, w = self.runs.anchor[order], whole[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (w[1:] != w[:-1]))) if len(h) else np.zeros(0, bool)
        copy = np.flatnonzero(~new) if confirmed else np.zeros(0, np.int64)
        first = np.flatnonzero(new)[np.cumsum(new)[copy] - 1]
        wrong = copy[~self.runs.same(order[copy], order[first])]
        for x in (wrong, wrong + 1):  # each of these stands alone
            new[x[x < len(new)]] = True
        head = np.flatnonzero(new)
        h, s = h[order], s[order]
        return order, head, h[head], s[head], self.docs[order][head], np.unique(h[wrong])


def _sent(rows: list[np.ndarray], widths: list[int], buckets: int, by: np.ndarray, chunk: int) -> pa.Table:
    """Rows by bucket; of the first column, the anchor, what the bucket's number tells isn't sent."""
    to = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")
    to = to[order]
    head = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
    ns = np.diff(np.concatenate((head, [len(to)]))) if len(to) else head
    columns = [(x[order], w) for x, w in zip([by // np.uint64(buckets), *rows], widths, strict=True)]
    return pa.table([pa.array(to[head]), pa.array(np.full(len(head), chunk)), pa.array(ns), _packed(columns, ns)], schema=_SENT)


def _introduce(width: int, buckets: int, hot_here: int):
    """Round 1, at a chunk: (anchor, whole, least document) to buckets; a hot anchor sends one mark."""

    def run(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        _, _, h, s, d, wrong = c.records(width)
        if len(h):
            first = np.concatenate(([True], h[1:] != h[:-1]))
            group = np.cumsum(first) - 1
            hot = (np.bincount(group)[group] > hot_here) | np.isin(h, wrong)
            keep = ~hot | first
            s = np.where(hot, _MARK, s)[keep]
            h, d = h[keep], d[keep]
        return _sent([s, d.view(np.uint64)], [_less(width, buckets), SENT, 8], buckets, h, c.number)

    return run


def _less(width: int, buckets: int) -> int:
    """Bytes of an anchor's quotient by the number of buckets."""
    return (8 * width - buckets.bit_length() + 1 + 7) // 8


def _sort_out(width: int, buckets: int, hot_all: int):
    """Round 1, at a bucket: the least document of an anchor's only segment, or that the anchor is ambiguous or hot."""

    def run(table: pa.Table) -> pa.Table:
        blobs = Blobs(table)
        h, s, d = blobs.rows(np.arange(len(blobs.ns)), [_less(width, buckets), SENT, 8])
        h = h * np.uint64(buckets) + np.uint64(table.column("bucket")[0].as_py())
        d, chunk = d.view(np.int64), np.repeat(table.column("chunk").to_numpy(), blobs.ns)
        order = _ordered(h, s, d)
        h, s, d, chunk = h[order], s[order], d[order], chunk[order]
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_s = new_h | np.concatenate(([True], s[1:] != s[:-1]))
        by_h = np.cumsum(new_h) - 1
        kinds = np.bincount(by_h, new_s)
        marked = np.bincount(by_h, s == _MARK) > 0
        state = np.where(marked | (kinds > hot_all), HOT, np.where(kinds > 1, AMBIGUOUS, ONE))[by_h]
        least = d[np.flatnonzero(new_s)][np.cumsum(new_s) - 1]
        tables = []
        for kind, at in ((ONE, np.flatnonzero((state == ONE) & (least < d))), (AMBIGUOUS, np.flatnonzero(state == AMBIGUOUS)), (HOT, np.flatnonzero(state == HOT))):
            x = at[np.argsort(chunk[at], kind="stable")]
            new = np.concatenate(([True], np.diff(chunk[x]) != 0)) if len(x) else np.zeros(0, bool)
            columns = [(h, width), (s, SENT), (least.view(np.uint64), 8)]
            if kind != ONE:  # an anchor once
                keep = new | np.concatenate(([True], np.diff(h[x]) != 0)) if len(x) else new
                x, new, columns = x[keep], new[keep], columns[:1]
            head = np.flatnonzero(new)
            ns = np.diff(np.concatenate((head, [len(x)]))) if len(x) else head
            tables.append(pa.table([pa.array(chunk[x][head]), pa.array(np.full(len(head), kind)), pa.array(ns), _packed([(c[x], w) for c, w in columns], ns)], schema=_TOLD))
        return pa.concat_tables(tables)

    return run


def _told(table: pa.Table, width: int):
    """What buckets told a chunk in round 1: only segments' (anchor, whole, least), ambiguous anchors, hot anchors."""
    blobs, kind = Blobs(table), table.column("kind").to_numpy()
    one = blobs.rows(np.flatnonzero(kind == ONE), [width, SENT, 8])
    return one, *(blobs.rows(np.flatnonzero(kind == k), [width])[0] for k in (AMBIGUOUS, HOT))


def _answers(told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What buckets told a chunk in round 2: strings' hashes, numbers of windows, and all windows' least documents."""
    blobs = Blobs(told)
    of = np.flatnonzero(told.column("kind").to_numpy() == STRINGS)
    keys, counts = blobs.rows(of, [8, 2])
    return keys, counts.astype(np.int64), np.frombuffer(b"".join(blobs.tail(i, 10 * int(blobs.ns[i])) for i in of.tolist()), np.int64)


def _told_apart(c: Chunk, start: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``x`` with windows of equal hashes but other bytes told apart by their low 16 bits, which choose no bucket; ``x`` is sorted."""
    if not len(x):
        return x
    new = np.concatenate(([True], x[1:] != x[:-1]))
    again = np.flatnonzero(~new)
    mine, first = start[again], start[np.flatnonzero(new)][np.cumsum(new) - 1][again]
    eight = np.ndarray(len(c.runs.bytes) - 7, "<u8", c.runs.bytes, strides=(1,))
    lies = np.zeros(len(x), bool)
    for at in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        lies[again] |= eight[mine + at] != eight[first + at]
    if not lies.any():
        return x
    x, taken = x.copy(), set(x.tolist())
    for h in np.unique(x[lies]).tolist():
        same = np.flatnonzero(x == h)
        of: dict[bytes, list[int]] = {}
        for i in same.tolist():
            of.setdefault(c.runs.bytes[start[i] : start[i] + WIDTH], []).append(i)
        for s in sorted(of)[1:]:
            free = next(k for k in (h ^ j for j in range(1, 1 << 16)) if k not in taken)
            taken.add(free)
            x[of[s]] = np.uint64(free)
    return x


def _hot_windows(c: Chunk, h: np.ndarray, hot: np.ndarray):
    """Window starts of hot segments, sorted by (hash, document), with heads of equal ones; their bytes confirm what is equal."""
    of = np.flatnonzero(np.isin(h, hot)) if len(hot) else np.zeros(0, np.int64)
    start, x = c.runs.windows(of)
    doc = np.repeat(c.docs[of], c.runs.length[of])
    order = np.argsort(x, kind="stable")
    start, x, doc = start[order], x[order], doc[order]
    x = _told_apart(c, start, x)
    order = np.lexsort((doc, x))
    start, x, doc = start[order], x[order], doc[order]
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return start, x, doc, head


def _send_strings(width: int, buckets: int):
    """Round 2, at a chunk: the bytes of ambiguous segments by their anchors, of hot segments' windows by their own hash.

    What round 3 still needs of round 1 goes along, to come back with round 2's answers.
    """

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _table([], _SENT)
        c = Chunk(docs)
        one, ambiguous, hot = _told(told, width)
        sent = []  # by what the bucket is chosen, key, document, start, bytes
        if len(ambiguous):
            order, head, h, _, d, _ = c.records(width, confirmed=False)  # lying anchors are hot by now
            i = np.flatnonzero(np.isin(h, ambiguous))
            r = order[head[i]]
            sent.append((h[i], c.runs.whole[r], d[i], c.runs.start[r], c.runs.length[r] + WIDTH - 1))
        if len(hot):
            start, x, doc, head = _hot_windows(c, _keys(c.runs, width)[0], hot)
            sent.append((x[head] >> np.uint64(16), x[head], doc[head], start[head], np.full(len(head), WIDTH)))
        rows = []
        if sent:
            by, key, doc, start, size = (np.concatenate(x) for x in zip(*sent, strict=True))
            to = (by % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, key, doc, start, size = to[order], key[order], doc[order], start[order], size[order]
            part = by[order] // np.uint64(buckets) % np.uint64(256)
            text = np.frombuffer(c.runs.bytes, np.uint8)[_ranges(start, size)].tobytes()
            ends = np.concatenate(([0], np.cumsum(size)))
            edges = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))).tolist() if len(to) else []
            for a, b in zip(edges, edges[1:], strict=False):
                columns = [(key[a:b], 8), (doc[a:b].view(np.uint64), 8), (size[a:b].view(np.uint64), 2), (part[a:b], 1)]
                rows.append((int(to[a]), c.number, b - a, _put(columns) + _zip(text[ends[a] : ends[b]])))
        for kind, x, widths in ((ONE, one, [width, SENT, 8]), (HOT, [hot], [width])):
            if len(x[0]):
                rows.append((c.number % buckets, c.number, -len(x[0]), bytes([kind]) + _put(list(zip(x, widths, strict=True)))))
        return _table(rows, _SENT)

    return run


STRINGS = 3


def _compare(table: pa.Table) -> pa.Table:
    """Round 2, at a bucket: merged transforms of the shards' strings give each window's least document."""
    blobs, chunk = Blobs(table), table.column("chunk").to_numpy()
    rows = [(int(chunk[i]), int(blobs.data[blobs.at[i]]), -int(blobs.ns[i]), blobs.tail(i, 1)) for i in np.flatnonzero(blobs.ns < 0).tolist()]  # from round 1
    of = np.flatnonzero(blobs.ns > 0)
    if not len(of):
        return _table(rows, _TOLD)
    key, doc, size, part = blobs.rows(of, [8, 8, 2, 1])
    doc, size, chunk = doc.view(np.int64), size.astype(np.int64), np.repeat(chunk[of], blobs.ns[of])
    text = b"".join(_unzip(blobs.tail(i, 19 * int(blobs.ns[i]))) for i in of.tolist())
    ends = np.cumsum(size)
    place: dict[bytes, int] = {}
    i = np.fromiter((place.setdefault(text[a:e], len(place)) for a, e in zip((ends - size).tolist(), ends.tolist(), strict=True)), np.int64, len(size))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(i), prepend=-1))
    least = doc[first]
    np.minimum.at(least, i, doc)
    shard, part, windows = chunk[first] % SHARDS, part[first], size[first] - WIDTH + 1
    begin = np.concatenate(([0], np.cumsum(windows)))
    found = np.repeat(least, windows)
    strings = list(place)
    j, low, high = _repeated_part(strings, size[first])
    # equal windows have equal anchors, so parts by anchor can be merged apart; small ones stay in the cache
    groups = min(256, max(1, int((high - low).sum()) // PART_BYTES))
    for g in range(groups):
        x = np.flatnonzero(part[j] % np.uint64(groups) == g)
        if len(x):
            t = [strings[k][a:b] for k, a, b in zip(j[x].tolist(), low[x].tolist(), high[x].tolist(), strict=True)]
            found[_ranges(begin[j[x]] + low[x], high[x] - low[x] - WIDTH + 1)] = least_of_windows(t, least[j[x]], shard[j[x]].tolist(), WIDTH)
    back = np.flatnonzero(np.minimum.reduceat(found, begin[:-1])[i] < doc)
    back = back[np.argsort(chunk[back], kind="stable")]
    values = found[_ranges(begin[i[back]], windows[i[back]])]
    to, n = chunk[back], windows[i[back]]
    at = np.concatenate(([0], np.cumsum(n)))
    edges = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))).tolist() if len(to) else []
    for a, b in zip(edges, edges[1:], strict=False):
        rows.append((int(to[a]), STRINGS, b - a, _put([(key[back[a:b]], 8), (n[a:b].view(np.uint64), 2)]) + values[at[a] : at[b]].tobytes()))
    return _table(rows, _TOLD)


def _repeated_part(strings: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings with a window whose hash occurs again among all windows, and from where to where such windows reach in each; equal windows have equal hashes, so none is missed."""
    n = size - WIDTH + 1
    x = Runs.hashes(np.frombuffer(b"".join(strings), np.uint8), _ranges(np.cumsum(size) - size, n))
    order = np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    again = np.zeros(len(x), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    j = np.repeat(np.arange(len(strings)), n)[at]
    offset = at - (np.cumsum(n) - n)[j]
    new = np.concatenate(([True], j[1:] != j[:-1], [True])) if len(at) else np.zeros(1, bool)
    return j[new[:-1]], offset[new[:-1]], offset[new[1:]] + WIDTH


def _remove(width: int):
    """Round 3, at a chunk: the covered bytes of each document."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], _RESULT)
        c = Chunk(docs)
        n = len(c.runs.bytes)
        begins, ends = [], []

        def cover(start, windows):
            begins.append(start)
            ends.append(start + windows + WIDTH - 1)

        order, head, h, s, d, _ = c.records(width)
        size = np.diff(np.concatenate((head, [len(order)]))) if len(head) else head
        (oh, os, od), _, hot = _told(told, width)
        least = d.copy()
        if len(oh):
            # one number for each (anchor, whole); both sides use the same mixture
            mine, theirs = (_mixed(a * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(b)) for a, b in ((h, s), (oh, os)))
            by = np.argsort(theirs)
            at = np.minimum(np.searchsorted(theirs[by], mine), len(by) - 1)
            same = (oh[by][at] == h) & (os[by][at] == s)
            least[same] = np.minimum(least[same], od[by][at][same].view(np.int64))
        known = np.empty(len(order), np.int64)
        known[order] = np.repeat(least, size)
        hit = known < c.docs
        cover(c.runs.start[hit], c.runs.length[hit])
        keys, counts, values = _answers(told)
        begin = np.concatenate(([0], np.cumsum(counts)))
        if len(keys):
            by = np.argsort(keys)
            find = lambda x: by[np.minimum(np.searchsorted(keys[by], x), len(by) - 1)]
            k = find(c.runs.whole)
            r = np.flatnonzero((keys[k] == c.runs.whole) & (counts[k] == c.runs.length))
            k, m = k[r], c.runs.length[r]
            less = values[_ranges(begin[k], m)] < np.repeat(c.docs[r], m)
            cover(_ranges(c.runs.start[r], m)[less], 1)
        if len(hot):
            start, x, doc, first = _hot_windows(c, _keys(c.runs, width)[0], hot)
            low = doc[first]
            if len(keys) and len(first):
                k = find(x[first])
                same = (keys[k] == x[first]) & (counts[k] == 1)
                low[same] = np.minimum(low[same], values[begin[k[same]]])
            lows = np.repeat(low, np.diff(np.concatenate((first, [len(x)]))))
            cover(start[lows < doc], 1)
        change = np.bincount(np.concatenate(begins), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1)
        gone = np.cumsum(change[:n]) > 0
        data = np.frombuffer(c.runs.bytes, np.uint8)
        rows = [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for _, t in c.idle]
        for i, a, e in zip(c.ids.tolist(), c.runs.starts.tolist(), c.runs.ends.tolist(), strict=True):
            g = gone[a:e]
            k = int(g.sum())
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0
            kept = data[a:e][~g].tobytes() if k else c.runs.bytes[a:e]
            rows.append((i, e - a, k, spans, hashlib.sha256(kept).hexdigest()))
        return _table(rows, _RESULT)

    return run


def remove_repeats(docs: DataFrame, chunks: int | None = None, buckets: int | None = None, hot_here: int = HOT_HERE, hot_all: int = HOT_ALL) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (removed runs), kept_sha256.

    Texts count as UTF-8 bytes; a null text is empty. Rows without an id neither remove nor lose anything;
    repeated ids don't remove from each other. Other columns are ignored; an empty table gives an empty result. A text is
    never cut: its chunk's task holds it whole, with about 60 bytes for each of its bytes while it is hashed in blocks.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = chunks or max(CHUNKS, total // CHUNK_BYTES)
    buckets = buckets or max(BUCKETS, total // CHUNK_BYTES)
    width = min(8, max(5, (int(total).bit_length() + 11) // 8))  # so that few different anchors look the same
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    by_chunk = d.groupBy("chunk")
    sent = by_chunk.applyInArrow(_introduce(width, buckets, hot_here), _DDL[id(_SENT)])
    told = sent.groupBy("bucket").applyInArrow(_sort_out(width, buckets, hot_all), _DDL[id(_TOLD)])
    # fewer buckets for strings: they compress better together
    strings = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_send_strings(width, max(1, buckets // 4)), _DDL[id(_SENT)])
    compared = strings.groupBy("bucket").applyInArrow(_compare, _DDL[id(_TOLD)])
    return by_chunk.cogroup(compared.groupBy("chunk")).applyInArrow(_remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Repeated substrings of all ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
