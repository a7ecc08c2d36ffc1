"""Static range asymmetric numeral system over token ids, many lanes at once with numpy.

One frequency table serves all blocks. A block's ids are dealt to its lanes in turn (id k to
lane k mod lanes); every lane has a 64-bit state, and all lanes of a block share one stream
of 32-bit words. Checkpoints hold the lane states and the place in the stream at a step, so
decoding can begin there; each block has a checksum.
"""

from __future__ import annotations

import zlib

import numpy as np

#: log2 of the sum of the frequencies; it must exceed log2 of the number of symbols.
SCALE = 18
LOW = 1 << 31
#: Ids of a block (it ends with the document that passes this), lanes at most, steps between checkpoints.
BLOCK, LANES, STEPS = 1 << 19, 1024, 256


def normalise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2 ** scale, at least 1 for every symbol with a count."""
    total, size = int(counts.sum()), 1 << scale
    freq = np.zeros(len(counts), dtype=np.int64)
    seen = np.flatnonzero(counts)
    if len(seen) > size:
        raise ValueError(f"{len(seen)} symbols need a scale above {scale}")
    if not total:
        return freq
    freq[seen] = np.maximum(1, counts[seen] * (size / total)).astype(np.int64)
    order = seen[np.argsort(-counts[seen], kind="stable")]
    off = size - int(freq.sum())
    if off > 0:
        freq[order[0]] += off
    while off < 0:  # the most frequent give, each at most half of what it has
        for s in order:
            give = min(-off, int(freq[s]) // 2)
            freq[s] -= give
            off += give
            if not off:
                break
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = scale
        self.freq = freq.astype(np.uint64)
        self.cum = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.pad = int(np.argmax(freq)) if len(freq) else 0

    def encode(self, ids: np.ndarray, lanes_most: int = LANES, every: int = STEPS) -> dict:
        """A block: n, lanes, words, states and checkpoints (step, place in words, states)."""
        n = len(ids)
        lanes = 1
        while lanes < lanes_most and lanes * 128 <= n:
            lanes *= 2
        steps = -(-n // lanes)
        grid = np.full(steps * lanes, self.pad, dtype=np.int64)
        grid[:n] = ids
        if n and not self.freq[grid].all():
            raise ValueError("an id has no frequency")
        grid = grid.reshape(steps, lanes)
        x = np.full(lanes, LOW, dtype=np.uint64)
        k, s32 = np.uint64(self.scale), np.uint64(32)
        out, size, marks = [], 0, []
        for step in range(steps - 1, -1, -1):  # the decoder's order turned round
            f, c = self.freq[grid[step]], self.cum[grid[step]]
            full = x >= (f << np.uint64(31 - self.scale + 32))
            if full.any():
                out.append(x[full].astype(np.uint32))  # low 32 bits
                size += len(out[-1])
                x[full] >>= s32
            q = x // f
            x = (q << k) + (x - q * f) + c
            if step and step % every == 0:
                marks.append((step, size, x.copy()))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype=np.uint32)
        return {"n": n, "lanes": lanes, "words": words.tobytes(), "states": x.tobytes(),
                "marks": [{"step": s, "at": size - w, "states": st.tobytes()} for s, w, st in reversed(marks)]}

    def decode(self, block: dict, start: int = 0) -> np.ndarray:
        """The ids from checkpoint number ``start`` on (0: the beginning)."""
        lanes, n = block["lanes"], block["n"]
        steps = -(-n // lanes)
        mark = {"step": 0, "at": 0, "states": block["states"]} if start == 0 else block["marks"][start - 1]
        words = np.frombuffer(block["words"], dtype=np.uint32)
        x = np.frombuffer(mark["states"], dtype=np.uint64).copy()
        first, at = mark["step"], mark["at"]
        grid = np.zeros((steps - first, lanes), dtype=np.uint32)
        mask, k, s32 = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(32)
        for step in range(steps - first):
            slot = x & mask
            s = self.symbol[slot]
            grid[step] = s
            x = self.freq[s] * (x >> k) + slot - self.cum[s]
            few = np.flatnonzero(x < LOW)
            if len(few):
                x[few] = (x[few] << s32) | words[at:at + len(few)]
                at += len(few)
        return grid.reshape(-1)[: n - first * lanes]


def checksum(block: dict) -> int:
    crc = zlib.crc32(block["words"])
    crc = zlib.crc32(block["states"], crc)
    for m in block["marks"]:
        crc = zlib.crc32(m["states"], crc)
    return crc
