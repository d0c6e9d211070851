"""Static range asymmetric numeral system over blocks of token ids, vectorised across lanes and blocks.

A block of ids is dealt to ``LANES`` interleaved coders: lane j has the ids j, j + LANES, ...  Every step all lanes code
one id each, so a step is a few numpy operations over lanes x blocks.  States have 64 bits and emit 32-bit words.
Coding runs backwards; a decoder reads the words of a block from the last to the first.  After every ``CHECKPOINT`` steps
the block holds the lane states and the position in its words, so a decoder can start there.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES, SCALE_BITS, CHECKPOINT = 128, 20, 256
BLOCK_IDS = 1 << 16
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass
class Table:
    """Quantised frequencies: each symbol that occurs has a slot at least; they sum to 2**SCALE_BITS."""

    symbols: np.ndarray  # uint32, ascending
    freq: np.ndarray  # uint64
    start: np.ndarray  # uint64
    place: np.ndarray  # symbol -> index
    slot: np.ndarray  # slot -> index

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray) -> Table:
        order = np.argsort(symbols)
        symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
        total = 1 << SCALE_BITS
        if len(symbols) > total:
            raise ValueError(f"{len(symbols)} symbols do not fit {total} slots")
        freq = np.ones(len(symbols), np.int64)
        if len(symbols):
            share = counts / counts.sum() * (total - len(symbols))
            freq += np.floor(share).astype(np.int64)
            rest = np.argsort(-(share - np.floor(share)), kind="stable")[: total - int(freq.sum())]
            freq[rest] += 1
        start = np.concatenate([[0], np.cumsum(freq)[:-1]]) if len(symbols) else np.zeros(0, np.int64)
        place = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        return cls(symbols, freq.astype(np.uint64), start.astype(np.uint64), place, np.repeat(np.arange(len(symbols), dtype=np.uint32), freq))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(blocks: list[np.ndarray], table: Table) -> list[dict]:
    """Coded form of each block: n, words, states, checkpoints, crc32 of the ids and of the words."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    steps = -(-sizes // LANES)
    longest = int(steps.max())
    ids = np.zeros((len(blocks), longest * LANES), np.int64)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = table.place[b]
    state = np.full((len(blocks), LANES), _LOW)
    words: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    written = np.zeros(len(blocks), np.int64)
    points: list[list[tuple[int, bytes]]] = [[] for _ in blocks]
    lane = np.arange(LANES)
    limit = np.uint64(63 - SCALE_BITS)
    shortest = int(sizes.min())
    every = np.repeat(np.arange(len(blocks)), LANES)
    for t in range(longest - 1, -1, -1):
        if full := (t + 1) * LANES <= shortest:  # all lanes of all blocks
            b, symbol, x = every, ids[:, t * LANES : (t + 1) * LANES].ravel(), state.ravel()
        else:
            b, j = np.nonzero((t * LANES + lane)[None, :] < sizes[:, None])
            symbol, x = ids[b, t * LANES + j], state[b, j]
        freq = table.freq[symbol]
        over = x >= (freq << limit)
        # the decoder reads backwards, so lanes go out from the last to the first
        at = np.flatnonzero(over)[::-1]
        if len(at):
            words.append((x[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            owner.append(b[at])
            written += np.bincount(b[at], minlength=len(blocks))
            x = np.where(over, x >> _WORD, x)
        q = x // freq
        x = (q << np.uint64(SCALE_BITS)) + (x - q * freq) + table.start[symbol]
        if full:
            state = x.reshape(state.shape)
        else:
            state[b, j] = x
        if t % CHECKPOINT == 0 and t:
            for i in np.flatnonzero(steps > t):
                points[i].append((t, int(written[i]), state[i].tobytes()))
    flat = np.concatenate(words) if words else np.zeros(0, np.uint32)
    of = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    flat, bounds = flat[order], np.concatenate([[0], np.cumsum(written)])
    out = []
    for i, ids_of in enumerate(blocks):
        payload = flat[bounds[i] : bounds[i + 1]].astype("<u4").tobytes()
        out.append({
            "n": len(ids_of), "words": payload, "states": state[i].astype("<u8").tobytes(),
            "point_steps": [p[0] for p in reversed(points[i])], "point_words": [p[1] for p in reversed(points[i])],
            "point_states": b"".join(p[2] for p in reversed(points[i])), "ids_crc": crc(ids_of), "words_crc": zlib.crc32(payload),
        })
    return out


def decode(coded: list[dict], table: Table, first_step: int = 0) -> list[np.ndarray]:
    """Ids of each block, from the checkpoint at ``first_step`` on (0: all).  Damage raises ValueError."""
    if not coded:
        return []
    sizes = np.array([c["n"] for c in coded])
    for c in coded:
        if zlib.crc32(c["words"]) != c["words_crc"]:
            raise ValueError("words of a token block do not match their checksum")
    words = [np.frombuffer(c["words"], "<u4") for c in coded]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    flat = np.concatenate(words) if len(words) else np.zeros(0, np.uint32)
    state = np.empty((len(coded), LANES), np.uint64)
    left = np.empty(len(coded), np.int64)
    for i, c in enumerate(coded):
        if first_step and first_step in list(c["point_steps"]):
            k = list(c["point_steps"]).index(first_step)
            state[i] = np.frombuffer(c["point_states"], "<u8")[k * LANES : (k + 1) * LANES]
            left[i] = c["point_words"][k]
        else:
            state[i], left[i] = np.frombuffer(c["states"], "<u8"), len(words[i])
    longest = int((-(-sizes // LANES)).max())
    out = np.zeros((len(coded), longest * LANES), np.uint32)
    lane = np.arange(LANES)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    shortest = int(sizes.min())
    every = np.repeat(np.arange(len(coded)), LANES)
    for t in range(first_step, longest):
        if full := (t + 1) * LANES <= shortest:
            b, x = every, state.ravel()
        else:
            b, j = np.nonzero((t * LANES + lane)[None, :] < sizes[:, None])
            x = state[b, j]
        low = x & mask
        symbol = table.slot[low]
        x = table.freq[symbol] * (x >> np.uint64(SCALE_BITS)) + low - table.start[symbol]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            of = b[need]
            count = np.bincount(of, minlength=len(coded))
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            x[need] = (x[need] << _WORD) | flat[bounds[of] + left[of] - 1 - place].astype(np.uint64)
            left -= count
        if full:
            out[:, t * LANES : (t + 1) * LANES] = table.symbols[symbol].reshape(state.shape)
            state = x.reshape(state.shape)
        else:
            out[b, t * LANES + j] = table.symbols[symbol]
            state[b, j] = x
    found = [out[i, first_step * LANES : n] for i, n in enumerate(sizes)]
    if not first_step and any(crc(ids) != c["ids_crc"] for ids, c in zip(found, coded, strict=True)):
        raise ValueError("ids of a token block do not match their checksum")
    return found
