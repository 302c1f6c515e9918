"""Words of a text as numbers, found and hashed all at once with numpy.

The fast 64-bit hash of a word only sorts words: whoever takes two words of one hash for
the same compares their bytes (`same`, `distinct`). Numbers that leave a task are
`strong`, the first 64 bits of a BLAKE2b digest, which nobody can make collide at will.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Longer texts are worked on in parts that end at white space.
PART = 1 << 20
#: Longer words are hashed and compared one by one.
LONG = 256
#: Words whose strong hashes a worker remembers.
MEMO = 100_000
#: By a count of bytes, up to 8: a mask of as many low bytes.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U64)
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finish)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _eights(text: bytes) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end."""
    return np.ndarray(len(text) + 1, "<u8", text + b"\0" * 8, strides=(1,))


def _columns(n: np.ndarray):
    """(j, which): the pieces of more than 8 j bytes, up to LONG, for j from 0 on."""
    at = np.flatnonzero(n <= LONG)
    j = 0
    while len(at):
        yield j, at
        j += 8
        at = at[n[at] > j]


def _hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    view, n = _eights(text), end - start
    h = n.astype(_U64) * _U64(0xD6E8FEB86659FD93)
    for j, at in _columns(n):
        h[at] = mix((h[at] ^ (view[start[at] + j] & _MASK[np.minimum(n[at] - j, 8)])) * _U64(0x9E3779B97F4A7C55))
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def same(a: bytes, a_start: np.ndarray, b: bytes, b_start: np.ndarray, n: np.ndarray) -> bool:
    """Are the n bytes of each piece of a those of the piece of b beside it?"""
    x = _eights(a)
    y = x if a is b else _eights(b)
    for j, at in _columns(n):
        if (((x[a_start[at] + j] ^ y[b_start[at] + j]) & _MASK[np.minimum(n[at] - j, 8)]) != 0).any():
            return False
    return all(a[a_start[i] : a_start[i] + n[i]] == b[b_start[i] : b_start[i] + n[i]] for i in np.flatnonzero(n > LONG).tolist())


def distinct(text: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """(first, which, plain): one piece for each different one, and for every piece the
    number of its own; plain: no two different pieces have the same hash, and the
    different ones are in the order of their hashes."""
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    n, rep = end - start, first[which]
    if (n == n[rep]).all() and same(text, start, text, start[rep], n):
        return first, which, True
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(text[a:b], len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
    return np.unique(which, return_index=True)[1], which, False


def strong(words: list[bytes]) -> np.ndarray:
    """A 64-bit BLAKE2b hash of each word."""
    if len(_known) + len(words) > MEMO:
        _known.clear()
    out = np.empty(len(words), _U64)
    for i, w in enumerate(words):
        x = _known.get(w)
        if x is None:
            x = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            if len(w) <= LONG:
                _known[w] = x
        out[i] = x
    return out


def _words(raw: np.ndarray):
    edge = np.diff((~_SPACE[raw]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _part(text: bytes):
    raw = np.frombuffer(text, np.uint8)
    start, end = _words(raw)
    if not len(start):
        return start, end, np.zeros(0, _U64)
    return start, end, _hashes(text, start, end)


def _class_table() -> np.ndarray:
    """Of UTF-8 bytes: 0 space, 1 part of a letter below U+0240, 2 digit, 3 other ASCII,
    4 bytes that leave the word to slower means."""
    out = np.full(256, 4, np.uint8)
    out[:128] = 3
    out[_SPACE] = 0
    for a, b in ((65, 91), (97, 123), (0x80, 0xC0), (0xC3, 0xC9)):
        out[a:b] = 1
    out[48:58] = 2
    out[[39, *range(9), *range(14, 32), 127]] = 4  # the quote of contractions, controls
    return out


_CLASS = _class_table()


def _piece_part(text: bytes):
    raw = np.frombuffer(text, np.uint8)
    w_start, w_end = _words(raw)
    if not len(w_start):
        return w_start, w_end, np.zeros(0, _U64), np.zeros(0, bool)
    kind = _CLASS[raw]
    hard = kind == 4
    signs = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # no letters
    hard[:-1] |= signs
    hard[:-1] |= (raw[:-1] == 0xC4) & (raw[1:] == 0xB0)  # its lower case has two characters
    hard[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # <| of special tokens
    upto = np.r_[0, np.cumsum(hard)]
    whole = upto[w_end] > upto[w_start]
    first = np.r_[True, kind[1:] != kind[:-1]]
    first |= kind == 2
    first &= kind > 0
    if whole.any():
        step = np.zeros(len(raw) + 1, np.int8)
        step[w_start[whole]] = 1
        step[w_end[whole]] -= 1
        first &= np.cumsum(step[:-1]) == 0
    first[w_start] = True
    start = np.flatnonzero(first)
    of = np.searchsorted(w_start, start, "right") - 1
    end = np.minimum(np.r_[start[1:], len(raw)], w_end[of])
    return start, end, _hashes(text, start, end), whole[of]


def _in_parts(text: bytes, work):
    if len(text) <= PART:
        return work(text)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PART)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        s, e, *rest = work(text[at:end])
        parts.append((s + at, e + at, *rest))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def hashed_words(text: bytes):
    """(starts, ends, fast hashes) of the runs of bytes other than ASCII white space."""
    return _in_parts(text, _part)


def hashed_pieces(text: bytes):
    """(starts, ends, fast hashes, whole): words cut into runs of letters, single digits and
    runs of other ASCII characters; a word with bytes that need more than that is one
    piece, marked as whole."""
    return _in_parts(text, _piece_part)
