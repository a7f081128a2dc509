"""Words and word hashes of whole Arrow string columns, found with array operations over their bytes.

Both word patterns used here only separate at ASCII bytes, so UTF-8 bytes can be classified one by one: every byte of a
longer character belongs to a word. A-Z count as a-z. Work goes by pieces of fixed length, through long words too, so
beside the text itself memory follows the number of words, not their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_PIECE = 1 << 15
_MASK = (1 << 64) - 1
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_SHORT = 64  # bytes up to which a word's hash is a polynomial
_TABLE = 1 << 12  # places in a longer word whose weights are kept; further ones are computed when met


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _codes(salt: int) -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=_U) * _U(salt))
    out[65:91] = out[97:123]
    return out


def _weights(places: np.ndarray, salt: int) -> np.ndarray:
    return mix((places.astype(_U) + _U(1)) * _U(salt))


#: Two independent hashes of words (numbers for bytes, base of the polynomial, numbers for places in long words). Modulo
#: 2**64 polynomials of many terms have collisions that can be written down, so long words are hashed by random weights.
_SALTS = ((0xD1342543DE82EF95, 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D), (0xA0761D6478BD642F, 0xE7037ED1A0B428DD, 0x8EBC6AF09C88C6E3))
_CODES = tuple(_codes(c) for c, _, _ in _SALTS)
_PLACES = tuple(_weights(np.arange(_TABLE), w) for _, _, w in _SALTS)
_UP = tuple(_powers(b, _PIECE + 1) for _, b, _ in _SALTS)
_DOWN = tuple(_powers(pow(b, -1, 1 << 64), _PIECE + 1) for _, b, _ in _SALTS)

BLANKS = np.ones(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = False  # words are [^\x20\x09-\x0D]+
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    got = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return got, ends - ends[0]


def slices(column: pa.Array, limit: int = 1 << 19):
    """Row ranges of at most so many bytes each, or one row."""
    _, ends = text_bytes(column)
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _long(part: np.ndarray, place: int, which: int) -> np.ndarray:
    """Hash, still to be mixed, of a part of a long word that begins at this place in it; parts add up."""
    stop = place + len(part)
    weight = _PLACES[which][place:stop] if stop <= _TABLE else _weights(np.arange(place, stop), _SALTS[which][2])
    return (_CODES[which][part] * weight).sum(dtype=_U, keepdims=True)


def scan(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word, and the index of each row's first word (one more entry than rows).

    Pieces have a fixed length; a word that their border cuts is carried over. Given words share a hash about once in 2**60,
    and independently so for the other value of which.
    """
    n, begins, ends, hashes = len(data), [], [], []
    codes, up, down = _CODES[which], _UP[which], _DOWN[which]
    opened, carried = -1, np.zeros(1, _U)
    for a in range(0, n, _PIECE):
        b = min(n, a + _PIECE)
        piece = data[a:b]
        word = is_word[piece]
        row = np.zeros(b - a + 1, dtype=bool)
        row[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        near = np.empty(b - a, dtype=bool)
        near[1:], near[0] = word[:-1], opened >= 0
        s = np.flatnonzero(word & (~near | row[:-1]))
        near[:-1], near[-1] = word[1:], b < n and is_word[data[b]]
        e = np.flatnonzero(word & (~near | row[1:])) + 1
        own = codes[piece]
        close = opened >= 0 and len(e) > 0
        inner = e[1:] if close else e
        cut = len(s) > len(inner)
        length = inner - s[: len(inner)]
        if opened >= 0 and not close:  # the piece lies inside a word
            carried = carried + _long(piece, a - opened, which)
            continue
        if close:
            stop = a + int(e[0])
            begins.append(np.array([opened]))
            ends.append(np.array([stop]))
            if stop - opened > _SHORT:
                hashes.append(carried + _long(piece[: e[0]], a - opened, which))
            else:
                hashes.append((codes[data[opened:stop]] * up[: stop - opened]).sum(dtype=_U, keepdims=True))
            opened = -1
        if cut:
            opened, carried, s = a + int(s[-1]), _long(piece[s[-1] :], 0, which), s[:-1]
        sums = np.zeros(b - a + 1, dtype=_U)
        np.cumsum(own * up[: b - a], out=sums[1:])
        h = (sums[inner] - sums[s]) * down[s]
        if length.max(initial=0) > _SHORT:
            for i in np.flatnonzero(length > _SHORT):
                h[i] = _long(piece[s[i] : inner[i]], 0, which)[0]
        begins.append(s + a)
        ends.append(inner + a)
        hashes.append(h)
    if not begins:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, _U), np.zeros(len(offsets), np.int64)
    start = np.concatenate(begins)
    return start, np.concatenate(ends), mix(np.concatenate(hashes)), np.searchsorted(start, offsets)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, whatever row they lie in."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, (k * 0x9E3779B97F4A7C15) & _MASK, dtype=_U)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _U(0x2545F4914F6CDD1D)
        out ^= out >> _U(29)
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int):
    """The sorted distinct k-word shingle hashes of each row; a row of fewer words gives its whole sequence as one."""
    whole = runs(hashes, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            own = np.sort(whole[a : b - k + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield runs(hashes[a:b], b - a)
        else:
            yield np.empty(0, _U)


def exact_shingles(text: str, k: int) -> set:
    """The set of k-word shingles itself, by the words' bytes, for texts whose words BLANKS separates."""
    own = text.encode().translate(_FOLD).split()  # bytes.split separates at exactly the bytes of BLANKS
    return set(zip(*(own[j:] for j in range(k)))) if len(own) >= k else {tuple(own)} - {()}
