"""Canonical, length-limited Huffman codes of ids, packed and unpacked with numpy.

``lengths`` finds the best code lengths under a limit by package-merge.
``Code`` gives ids their canonical codes (shorter first, then smaller ids),
packs ids into bits, and unpacks them with one table lookup an id.  The bits
are cut into blocks of a fixed number of ids; the bit offset of each block is
a checkpoint, so any block can be read on its own, and many are read in step.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids packed at a time.
PIECE = 1 << 20


def lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits for each symbol (0 where the count is 0), none over ``limit``, least in total.

    Package-merge: at each level the symbols meet the pairs of the level
    below; a symbol's length is the number of levels at which it is among the
    wanted ones.  Ties are settled by the symbol's number, symbols before pairs.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, single = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        single.append(rank < len(weights))
    wanted = 2 * len(weights) - 2
    for kind in reversed(single):
        symbols = int(kind[:wanted].sum())
        out[order[:symbols]] += 1
        wanted = 2 * (min(wanted, len(kind)) - symbols)
    return out


class Code:
    """The canonical code of given lengths."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.asarray(bits, np.uint8)
        self.limit = max(1, int(self.bits.max(initial=0)))
        if self.limit > 24:
            raise ValueError("codes of at most 24 bits")
        used = np.flatnonzero(self.bits)
        order = used[np.lexsort((used, self.bits[used]))]
        width = self.bits[order].astype(np.int64)
        #: Codes in order fill the code space from its start; a code's share is 2 to the missing bits.
        share = np.left_shift(1, self.limit - width)
        starts = np.cumsum(share) - share
        if int(share.sum()) > 1 << self.limit:
            raise ValueError("no prefix code has these lengths")
        self.codes = np.zeros(len(self.bits), np.int64)
        self.codes[order] = starts >> (self.limit - width)
        self.symbols = np.zeros(1 << self.limit, np.uint32)
        self.widths = np.zeros(1 << self.limit, np.uint8)
        filled = int(share.sum())
        self.symbols[:filled] = np.repeat(order, share)
        self.widths[:filled] = np.repeat(width, share)

    def checksum(self) -> int:
        return zlib.crc32(np.trim_zeros(self.bits, "b").tobytes())

    def pack(self, ids: np.ndarray, totals: np.ndarray, block: int) -> list[tuple[bytes, np.ndarray]]:
        """The bits of each text of ``totals`` ids, and the bit offset of each block of ``block`` ids in them."""
        step = max(1, PIECE // block) * block
        totals = np.asarray(totals, np.int64)
        pieces = np.maximum(1, -(-totals // step))
        text = np.repeat(np.arange(len(totals)), pieces)
        place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sizes = np.minimum(step, totals[text] - place * step)
        until = np.cumsum(sizes)
        out: list[tuple[bytes, np.ndarray]] = []
        first = 0
        while first < len(text):
            begin = int(until[first] - sizes[first])
            last = max(first + 1, int(np.searchsorted(until, begin + PIECE, "right")))
            packed = self._packed(ids[begin : int(until[last - 1])], sizes[first:last], block)
            for number, (bits, offsets) in zip(place[first:last].tolist(), packed):
                if number:
                    head, before = out[-1]
                    out[-1] = head + bits, np.concatenate([before, offsets + 8 * len(head)])
                else:
                    out.append((bits, offsets))
            first = last
        return out

    def _packed(self, ids: np.ndarray, sizes: np.ndarray, block: int) -> list[tuple[bytes, np.ndarray]]:
        """Pieces side by side, each from a byte of its own."""
        width = self.bits[ids].astype(np.int64)
        if not width.all():
            raise ValueError("an id without a code")
        ends = np.concatenate([[0], np.cumsum(width)])
        begins = np.cumsum(sizes) - sizes
        used = ends[begins + sizes] - ends[begins] + 7 >> 3
        bases = np.cumsum(used) - used
        starts = ends[:-1] + np.repeat(8 * bases - ends[begins], sizes)
        shifted = self.codes[ids].astype(np.uint64) << (64 - width - (starts & 31)).astype(np.uint64)
        at, words = starts >> 5, int(used.sum()) + 7 >> 2
        # Bits of different codes never meet, and sums below 2**53 are exact.
        high = np.bincount(at, (shifted >> np.uint64(32)).astype(np.float64), words)
        low = np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        data = (high + low).astype(np.uint64).astype(">u4").tobytes()
        blocks = -(-sizes // block)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        offsets = starts[begins[owner] + inside * block] - 8 * bases[owner]
        cut = np.split(offsets, np.cumsum(blocks)[:-1])
        return [(data[b : b + n], o) for b, n, o in zip(bases.tolist(), used.tolist(), cut)]

    def unpack(self, data, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of blocks at these bit offsets (rising), ``counts`` of each: all advance together, one lookup an id."""
        raw = np.frombuffer(data, np.uint8)
        lanes = max(1, 4 * PIECE // max(1, int(counts.max(initial=1))))
        out = [np.zeros(0, np.uint32)]
        for first in range(0, len(offsets), lanes):
            own, size = offsets[first : first + lanes], counts[first : first + lanes]
            low = int(own[0]) >> 3
            high = int(offsets[first + lanes]) + 7 >> 3 if first + lanes < len(offsets) else len(raw)
            part = np.concatenate([raw[low:high], np.zeros(8, np.uint8)]).astype(np.uint32)
            window = part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:]
            order = np.argsort(-size, kind="stable")
            position = own[order].astype(np.int64) - 8 * low
            most = int(size.max())
            active = len(own) - np.searchsorted(size[order][::-1], np.arange(most), "right")
            found = np.zeros((most, len(own)), np.uint32)
            for i, n in enumerate(active.tolist()):
                position = position[:n]
                shift = (32 - self.limit - (position & 7)).astype(np.uint32)
                index = window[position >> 3] >> shift & np.uint32((1 << self.limit) - 1)
                found[i, :n] = self.symbols[index]
                position = position + self.widths[index]
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            rows = found.T[back]
            out.append(rows[np.arange(most) < size[:, None]])
        return np.concatenate(out)
