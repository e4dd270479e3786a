"""CRC-32 of any span of a byte array from the running CRCs of its prefixes.

Behind the bytes X, the bytes Y give crc(XY) = shift(crc(X), |Y|) ^ crc(Y), where the shift by n bytes
multiplies by x^(8n) over GF(2). So crc(Y) = crc(XY) ^ shift(crc(X), |Y|): two prefixes tell the CRC of
what lies between them, and no span is read again.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

#: Fixed value of CRC-32: its polynomial, lowest bit first.
POLYNOMIAL = 0xEDB88320
_ALL = np.uint32(0xFFFFFFFF)
#: Bytes of a lane; the lanes of an array are scanned side by side.
_LANE = 1024
#: Shifts of fewer bytes have a table each, longer ones are put together from powers of two.
_SHORT = 64


def _byte_steps() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


_STEP = _byte_steps()


def _through(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as the images of each value of each of the four bytes."""
    out = table[0][values & 255]
    for j in (1, 2, 3):
        out = out ^ table[j][(values >> np.uint32(8 * j)) & 255]
    return out


def _one_byte_more(table: np.ndarray) -> np.ndarray:
    return (table >> np.uint32(8)) ^ _STEP[table & 255]


@cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """(maps of 0 to `_SHORT` - 1 zero bytes, maps of `_SHORT` bytes and its doubles)."""
    table = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    short = []
    for _ in range(_SHORT):
        short.append(table)
        table = _one_byte_more(table)
    doubles = [table]
    while len(doubles) < 40:
        doubles.append(_through(doubles[-1], doubles[-1]))
    return np.stack(short), doubles


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC times x^(8n)."""
    short, doubles = _tables()
    low = n % _SHORT
    out = short[low, 0, crc & 255]
    for j in (1, 2, 3):
        out = out ^ short[low, j, (crc >> np.uint32(8 * j)) & 255]
    rest, power = n // _SHORT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _through(doubles[power], out[odd])
        rest, power = rest >> 1, power + 1
    return out


class Prefixes:
    """CRCs of the prefixes of a byte array, from one scan."""

    def __init__(self, data: np.ndarray):
        lanes = -(-len(data) // _LANE)
        raw, before, at = data.tobytes(), np.zeros(lanes, np.uint32), 0
        for lane in range(lanes):
            before[lane] = at
            at = zlib.crc32(raw[lane * _LANE : (lane + 1) * _LANE], at)
        padded = np.zeros(lanes * _LANE, np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, _LANE).T)
        # Row i holds the states of all lanes before their byte i; the last row is that of the end.
        self.states = np.empty((_LANE + 1, lanes), np.uint32)
        self.states[0] = before ^ _ALL
        for i, column in enumerate(columns):
            state = self.states[i]
            np.bitwise_xor(state >> np.uint32(8), np.take(_STEP, (state ^ column).astype(np.uint8)), out=self.states[i + 1])

    def at(self, places: np.ndarray) -> np.ndarray:
        """CRC of the bytes before each place."""
        if not self.states.size:
            return np.zeros(len(places), np.uint32)
        lane = np.minimum(places // _LANE, self.states.shape[1] - 1)
        return self.states[places - lane * _LANE, lane] ^ _ALL

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC of the bytes from each start up to each end."""
        return self.at(ends) ^ shift(self.at(starts), ends - starts)
