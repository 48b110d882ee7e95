"""Exact edit distances of many texts at once: bit vectors of 64 letters of the reference, in a band that a known bound makes sufficient."""

from __future__ import annotations

import heapq

import numpy as np

_ONES, _ONE, _NONE, _TOP = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), np.uint64(0), np.uint64(1 << 63)
#: Columns that a block takes in a step; blocks that are worked on at once, and blocks in one go (about).
STEP, LANES, BLOCKS = 16, 5000, 80_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tiles(vp, vn, eq, hp, hn):
    """STEP columns of each block: VP and VN in place; the horizontal differences that come in and go out are a word's lowest bits, one for each column."""
    n = len(vp)
    out_p, out_n = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    a, b, xv, hi = (np.empty(n, np.uint64) for _ in range(4))
    for e in eq:
        np.bitwise_or(e, vn, out=xv)
        np.bitwise_and(hn, _ONE, out=hi)
        np.bitwise_or(e, hi, out=e)
        np.bitwise_and(e, vp, out=a)
        np.add(a, vp, out=a)
        np.bitwise_xor(a, vp, out=a)
        np.bitwise_or(a, e, out=a)  # Xh
        np.bitwise_or(a, vp, out=b)
        np.invert(b, out=b)
        np.bitwise_or(b, vn, out=b)  # HP
        np.bitwise_and(a, vp, out=a)  # HN
        np.right_shift(out_p, _ONE, out=out_p)
        np.bitwise_and(b, _TOP, out=e)
        np.bitwise_or(out_p, e, out=out_p)
        np.right_shift(out_n, _ONE, out=out_n)
        np.bitwise_and(a, _TOP, out=e)
        np.bitwise_or(out_n, e, out=out_n)
        np.left_shift(a, _ONE, out=a)
        np.bitwise_or(a, hi, out=a)
        np.bitwise_and(hp, _ONE, out=hi)
        np.left_shift(b, _ONE, out=b)
        np.bitwise_or(b, hi, out=b)
        np.right_shift(hp, _ONE, out=hp)
        np.right_shift(hn, _ONE, out=hn)
        np.bitwise_or(xv, b, out=vp)
        np.invert(vp, out=vp)
        np.bitwise_or(vp, a, out=vp)
        np.bitwise_and(b, xv, out=vn)
    return out_p >> np.uint64(64 - STEP), out_n >> np.uint64(64 - STEP)


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Costs of alignments of pairs, neither side empty, that stay in the band of all alignments of cost `most` or less (at least the difference in length)."""
    starts, stops, first, symbol_at, tables, table_at, owner, masks, zero = [], [], [], [], [], [], [], [], []
    letters, at, cells, running, busy, now = [], 0, 0, [], 0, 0
    for p, ((ref, hyp), k) in enumerate(zip(pairs, most.tolist(), strict=True)):
        m, n = len(ref), len(hyp)
        blocks, pad = -(-m // 64), -n % STEP
        # letters of the reference by number, others 0, which no row has
        number = np.zeros(max(int(ref.max()), int(hyp.max())) + 1, np.int32)
        number[ref] = 1
        known = np.flatnonzero(number)
        number[known] = np.arange(1, len(known) + 1)
        ids = number[ref]
        letters.append(np.concatenate([np.zeros(pad, np.int32), number[hyp]]))
        width = len(known) + 1
        rows = np.zeros((blocks, width, 64), bool)
        i = np.arange(m)
        rows[i >> 6, ids, i & 63] = True
        tables.append(np.packbits(rows, axis=-1, bitorder="little").view(np.uint64).ravel())
        d = n - m
        extra = (k - abs(d)) // 2
        b = np.arange(blocks)
        chunks = (n + pad) // STEP
        begin = np.clip((64 * b + min(0, d) - extra + pad) // STEP, 0, chunks - 1)
        end = np.clip((64 * b + 64 + max(0, d) + extra + pad) // STEP, 0, chunks - 1)
        # a pair begins when others have left room for its blocks
        lanes = min(blocks, k // 64 + 2)
        while running and busy + lanes > LANES:
            now, freed = heapq.heappop(running)
            busy -= freed
        busy += lanes
        heapq.heappush(running, (now + chunks + blocks, lanes))
        starts.append(now + begin + b)
        stops.append(now + end + b)
        symbol_at.append(at // STEP - now - b)
        table_at.append(cells + b * width)
        first.append(np.where(b == 0, pad, -1))
        zero.append(np.full(blocks, now))
        owner.append(np.full(blocks, p))
        masks.append(np.where(b == blocks - 1, _ONES >> np.uint64(-m % 64), _ONES))
        at += n + pad
        cells += blocks * width
    start, stop, symbol_at, table_at, first, owner, masks, zero = (np.concatenate(x) for x in (starts, stops, symbol_at, table_at, first, owner, masks, zero))
    letters, table = np.concatenate(letters).reshape(-1, STEP), np.concatenate(tables)
    vp, vn = np.full(len(start), _ONES), np.zeros(len(start), np.uint64)
    out_p, out_n = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    order, wait, idx = np.argsort(start, kind="stable"), 0, np.zeros(0, np.int64)
    queue = start[order]
    for c in range(int(stop.max()) + 1):
        # a block is one step behind the block above it
        more = int(np.searchsorted(queue, c, "right"))
        idx = np.concatenate([idx[stop[idx] >= c], order[wait:more]])
        wait = more
        above = idx - 1
        fed = (first[idx] < 0) & (stop[above] >= c - 1)
        hp, hn = np.where(fed, out_p[above], _ONES), np.where(fed, out_n[above], _NONE)
        # columns before the text change nothing
        new = np.flatnonzero((first[idx] > 0) & (zero[idx] == c))
        hp[new] = _ONES << first[idx[new]].astype(np.uint64)
        eq = table.take((letters.take(symbol_at[idx] + c, axis=0) + table_at[idx][:, None]).T)
        v, w = vp[idx], vn[idx]
        out_p[idx], out_n[idx] = _tiles(v, w, eq, hp, hn)
        vp[idx], vn[idx] = v, w
    # along the upper edge of the band each column costs 1; from edge to edge it goes down a block where that ends
    down = np.bitwise_count(vp & masks).astype(np.int64) - np.bitwise_count(vn & masks)
    return np.array([len(h) for _, h in pairs]) + np.bincount(owner, weights=down, minlength=len(pairs)).astype(np.int64)


def distances(pairs: list[tuple[str, str]], limits: list[int] | None = None) -> np.ndarray:
    """Edit distances of pairs; with limits, -1 where the distance is over the pair's.

    The cost of any alignment bounds the distance, and every alignment up to that cost lies in a band as wide. So a pair is compared
    in a band of a fifth of its length, and if what it costs there is more, once again in a band of that cost.
    """
    out = np.zeros(len(pairs), np.int64)
    texts, most = [], []
    for k, (a, b) in enumerate(pairs):
        size, gap = max(len(a), len(b)), abs(len(a) - len(b))
        limit = size if limits is None else min(limits[k], size)
        if gap > limit:
            out[k] = -1
        elif a == b or not a or not b:
            out[k] = 0 if a == b else size
        else:
            texts.append(k)
            most.append(max(gap, min(limit, size // 5 if limits is None else limit)))
    queue = sorted(zip(most, texts, strict=True), key=lambda x: (len(pairs[x[1]][1]), x))
    while queue:
        again = []
        while queue:
            group, blocks = [], 0
            while queue and (not group or blocks < BLOCKS):
                bound, k = queue.pop()
                group.append((bound, k))
                blocks += len(pairs[k][0]) // 64 + 1
            cost = _banded([(codes(pairs[k][0]), codes(pairs[k][1])) for _, k in group], np.array([x for x, _ in group]))
            for (bound, k), c in zip(group, cost.tolist(), strict=True):
                if c <= bound:
                    out[k] = c
                elif limits is not None and bound >= min(limits[k], max(map(len, pairs[k]))):
                    out[k] = -1
                else:
                    again.append((c, k))
        queue = sorted(again, key=lambda x: (len(pairs[x[1]][1]), x))
    return out
