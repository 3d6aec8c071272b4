"""CRC-32 of any run of bytes from two running CRCs.

A CRC without start value and final inversion is linear over GF(2): the running CRC behind a run is the one
before it, shifted by the run's length, xor the run's own. So one scan stores running CRCs, and the CRC of a
run is ``after ^ shift(before, length)``; start value and inversion depend on the length alone.
Shifting by whole bytes is a linear map of 32 bits, held as four tables of 256 words for each length below
``SHORT`` and for each power of two from there on.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320
#: Bytes of a lane: lanes advance together, one byte a step, each from a running CRC of zero.
LANE = 256
#: Lengths below this have a table of their own.
SHORT = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


BYTE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for b in range(1, 4):
        out = out ^ tables[b][(crc >> np.uint32(8 * b)) & 255]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(short, powers): the shift tables of lengths 0 to ``SHORT - 1``, and of ``SHORT * 2**j``."""
    short = np.zeros((SHORT, 4, 256), np.uint32)
    for b in range(4):
        short[0, b] = np.arange(256, dtype=np.uint32) << np.uint32(8 * b)
    for n in range(1, SHORT):
        before = short[n - 1]
        short[n] = BYTE[before & 255] ^ (before >> np.uint32(8))
    powers = np.zeros((40, 4, 256), np.uint32)
    step = BYTE[short[-1] & 255] ^ (short[-1] >> np.uint32(8))
    for j in range(len(powers)):
        powers[j] = step
        step = _apply(powers[j], powers[j])
    return short, powers


SHIFTS, POWERS = _tables()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Running CRCs moved over ``length`` bytes of zero, one length each."""
    low = length % SHORT
    out = SHIFTS[low, 0, crc & 255]
    for b in range(1, 4):
        out = out ^ SHIFTS[low, b, (crc >> np.uint32(8 * b)) & 255]
    high, j = length // SHORT, 0
    while len(high) and high.max() >> j:
        at = np.nonzero((high >> j) & 1)[0]
        out[at] = _apply(POWERS[j], out[at])
        j += 1
    return out


def running(data: np.ndarray) -> np.ndarray:
    """The running CRC before every byte, and behind the last one."""
    n = len(data)
    lanes = -(-n // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[:n] = data
    steps = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    out, crc = np.empty((LANE, lanes), np.uint32), np.zeros(lanes, np.uint32)
    for i in range(LANE):
        out[i] = crc
        crc = BYTE[(crc ^ steps[i]) & 255] ^ (crc >> np.uint32(8))
    carry = _carries(crc)
    for i in range(LANE):  # what came before the lane, moved over the bytes of the lane so far
        out[i] ^= carry
        carry = BYTE[carry & 255] ^ (carry >> np.uint32(8))
    every = np.append(out.T.reshape(-1)[:n], np.uint32(0))
    if n:
        last = every[n - 1]
        every[n] = BYTE[(last ^ data[-1]) & 255] ^ (last >> np.uint32(8))
    return every


def _carries(own: np.ndarray) -> np.ndarray:
    """The running CRC before each lane, from the lanes' own ones, by doubling distances."""
    total, span, j = own.copy(), 1, int(np.log2(LANE // SHORT))
    while span < len(total):
        total[span:] ^= _apply(POWERS[j], total[:-span])
        span, j = span * 2, j + 1
    return np.concatenate([np.zeros(1, np.uint32), total[:-1]]) if len(own) else own


def crc_of_runs(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:stop]`` for each pair."""
    length = stop - start
    full = np.full(len(length), 0xFFFFFFFF, np.uint32)
    return prefix[stop] ^ shift(prefix[start] ^ full, length) ^ full
