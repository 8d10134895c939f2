"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from trainlake.llm.common import ship_by_value, text_bytes

ship_by_value(__name__)

WIDTH = 5
BASE = 0x9E3779B97F4A7C15 | 1
PLACES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
COUNT = 0x8EBC6AF09C88C6E3
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
INKED = np.ones(256, bool)
INKED[list(SPACES)] = False
#: A polynomial modulo 2**64 cannot tell some texts of two letters and 1024 bytes apart, whatever
#: its base. Words from this length on have a digest instead.
LONG_WORD = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_hashes(texts: pa.Array, powers: Powers, inked: np.ndarray = INKED) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of lower-cased texts without nulls, and the word offsets of the
    texts. Words are runs of the bytes in ``inked``, by default of all but white space."""
    data, offsets = text_bytes(texts)
    data = lowered(data)
    inner = np.concatenate([[False], inked[data], [False]])
    edge = inner[1:] != inner[:-1]
    start_at = edge & inner[1:]
    end_at = edge & inner[:-1]
    cuts = offsets[1:-1]
    glued = cuts[inner[cuts] & inner[cuts + 1]]
    start_at[glued] = True
    end_at[glued] = True
    starts, ends = np.nonzero(start_at)[0], np.nonzero(end_at)[0]
    up, down = powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    for k in np.nonzero(ends - starts >= LONG_WORD)[0].tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        hashes[k] = int.from_bytes(digest, "little")
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, powers: Powers) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: of five words, or of all words of a shorter
    text; none without words. Nulls count as empty."""
    words, offsets = word_hashes(texts.fill_null(""), powers)
    n = len(words) - WIDTH + 1
    whole = np.full(max(n, 0), np.uint64(WIDTH * COUNT & (1 << 64) - 1))
    for k, place in enumerate(PLACES):
        if n > 0:
            whole += words[k : k + n] * np.uint64(place)
    whole = mixed(whole)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            own = np.sort(whole[a : b - WIDTH + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.array([(b - a) * COUNT & (1 << 64) - 1], np.uint64)
            for k in range(b - a):
                short += words[a + k : a + k + 1] * np.uint64(PLACES[k])
            sets.append(mixed(short))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
