"""Array kernels on nucleotide sequences: canonical form, k-mers, seeded comparison, banded alignment."""

from __future__ import annotations

import numpy as np

#: Codes of the bases; anything that is not a plain base is UNKNOWN.
UNKNOWN = 4
CODES = np.full(256, UNKNOWN, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    CODES[_b] = _i
_KEEP = bytes.maketrans(b"U" + bytes(c for c in range(65, 91) if chr(c) not in "ACGTU"), b"T" + b"N" * 21)
_DROP = bytes(c for c in range(256) if not (65 <= c <= 90))
_COMPLEMENT = bytes.maketrans(b"ACGTN", b"TGCAN")
#: Cells that one matrix may have; longer batches are cut into several.
CELLS = 1 << 22
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def canonical(text: str | None) -> bytes:
    """Letters A, C, G, T and N of a sequence however written: upper case, U as T, other letters as N; gaps, spaces and end padding go."""
    if not text:
        return b""
    return text.upper().encode("ascii", "ignore").translate(_KEEP, _DROP).strip(b"N")


def reverse_complement(seq: bytes) -> bytes:
    return seq.translate(_COMPLEMENT)[::-1]


def plain_bases(seq: bytes) -> int:
    return len(seq) - seq.count(b"N")


def sequence_id(seq: bytes) -> int:
    """64-bit id of a sequence, the same for both strands."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(min(seq, reverse_complement(seq)))).astype(np.int64))


def matrix(seqs: list[bytes], width: int = 0) -> np.ndarray:
    """One row of codes a sequence, filled up with UNKNOWN."""
    width = max([width, *map(len, seqs)]) if seqs else width
    joined = b"".join(s.ljust(width, b"N") for s in seqs)
    return CODES[np.frombuffer(joined, np.uint8)].reshape(len(seqs), width)


def blocks(seqs: list[bytes], rows: int = 512, others: list[bytes] | None = None) -> list[np.ndarray]:
    """Index arrays of sequences of similar length, each block of at most `rows` rows and CELLS cells (one row at least).

    With `others`, of pairs: the longer of the two counts.
    """
    length = np.array([len(s) for s in seqs], np.int64)
    if others is not None:
        length = np.maximum(length, [len(s) for s in others])
    order, out, at = np.argsort(length, kind="stable"), [], 0
    while at < len(order):
        end = min(len(order), at + rows)
        while end - at > 1 and (end - at) * int(length[order[end - 1]]) > CELLS:
            end = at + (end - at) // 2
        out.append(order[at:end])
        at = end
    return out


def _doubled(codes: np.ndarray, both: bool) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """2-bit codes of all windows of 1, 2, 4 ... 32 bases, forward and, if asked for, of the other strand."""
    v = codes & 3
    r = (3 - v) if both else None
    out, size = [(1, v, r)], 1
    for kind in (np.uint8, np.uint8, np.uint16, np.uint32, np.uint64):
        w = v.shape[1] - size
        if w <= 0:
            break
        shift = kind(2 * size)
        a = v.astype(kind, copy=False)
        if both:
            b = r.astype(kind, copy=False)
            r = (b[:, size : size + w] << shift) | b[:, :w]
        v = (a[:, :w] << shift) | a[:, size : size + w]
        size *= 2
        out.append((size, v, r))
    return out


def _clean(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether each window of k bases is of plain bases only."""
    bad = np.zeros((codes.shape[0], codes.shape[1] + 1), np.int32)
    np.cumsum(codes == UNKNOWN, axis=1, out=bad[:, 1:])
    return bad[:, k:] == bad[:, :-k]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters neighbours."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def sketches(codes: np.ndarray, k: int, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): for each multiplier the least k-mer of each row under its order, and where it lies.

    k is 16 or 32. K-mers count in the smaller of their two strands. A place is its position, or minus position minus one where the
    other strand is the smaller. Rows without a clean k-mer have keys of FULL.
    """
    n, b = len(codes), len(odd)
    keys, places = np.full((n, b), FULL, np.uint64), np.zeros((n, b), np.int32)
    found = {s: (v, r) for s, v, r in _doubled(codes, True)}
    if n == 0 or k not in found:
        return keys, places
    f, r = found[k]
    ok = _clean(codes, k)
    h = mixed(np.minimum(f, r).astype(np.uint64))
    # a fixed eighth of all k-mers takes part; rows with few of them use all
    part = ok & (h < np.uint64(1 << 61))
    few = part.sum(axis=1) < 24
    part[few] = ok[few]
    row, col = np.nonzero(part)
    if len(row) == 0:
        return keys, places
    hv = h[row, col]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows, counts = row[starts], np.diff(np.r_[starts, len(row)])
    group = np.repeat(np.arange(len(rows)), counts)
    back = (r[row, col] < f[row, col])
    signed = np.where(back, -col - 1, col).astype(np.int32)
    for j in range(b):
        g = hv * odd[j]
        least = np.minimum.reduceat(g, starts)
        at = np.flatnonzero(g == least[group])
        first = at[np.r_[True, group[at][1:] != group[at][:-1]]]
        keys[rows, j] = hv[first]
        places[rows, j] = signed[first]
    return keys, places


def syncmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, key) of the closed syncmers of 16 bases of each row: those whose least 8-mer is their first or their last.

    Both strands give the same k-mers, and a k-mer is taken or not whatever lies round it. Of any 8 neighbours one is taken, so
    that two rows which agree in 23 plain bases on end have one in common. Places are signed as in `sketches`.
    """
    found = {s: (v, r) for s, v, r in _doubled(codes, True)}
    if len(codes) == 0 or 16 not in found:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)
    f, r = found[16]
    small = mixed(np.minimum(*found[8]).astype(np.uint64))
    least = small
    for step in (1, 2, 4):
        least = np.minimum(least[:, :-step], least[:, step:])
    w = f.shape[1]
    first, last = small[:, :w], small[:, 8 : 8 + w]
    least = np.minimum(least[:, :w], last)
    row, col = np.nonzero(((first == least) | (last == least)) & _clean(codes, 16))
    back = r[row, col] < f[row, col]
    return row, np.where(back, -col - 1, col).astype(np.int32), mixed(np.minimum(f, r)[row, col].astype(np.uint64))


def window_keys(codes: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, signed place, whether it is clean) of each window of `size` bases, 4 to 64. Both strands of a window have one key."""
    w = max(0, codes.shape[1] - size + 1)
    if w == 0 or len(codes) == 0:
        return np.empty((len(codes), w), np.uint64), np.empty((len(codes), w), np.int32), np.empty((len(codes), w), bool)
    part, v, r = next(x for x in reversed(_doubled(codes, True)) if x[0] <= size)
    gap = size - part
    left, right = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F * (2 * salt + 1) & 0xFFFFFFFFFFFFFFFF)
    v, r = v.astype(np.uint64, copy=False), r.astype(np.uint64, copy=False)
    forth = v[:, :w] * left ^ v[:, gap : gap + w] * right
    back = r[:, gap : gap + w] * left ^ r[:, :w] * right
    place = np.broadcast_to(np.arange(w, dtype=np.int32), forth.shape)
    return mixed(np.minimum(forth, back)), np.where(back < forth, -place - 1, place), _clean(codes, size)


def flip(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of the other strand, again from column 0."""
    out = np.full_like(codes, UNKNOWN)
    rev = codes[:, ::-1]
    rev = np.where(rev < 4, 3 - rev, UNKNOWN).astype(np.uint8)
    w = codes.shape[1]
    at = (w - lengths)[:, None] + np.arange(w)[None, :]
    ok = at < w
    out[ok] = np.take_along_axis(rev, np.minimum(at, w - 1), axis=1)[ok]
    return out


def shifted(codes: np.ndarray, diag: np.ndarray, width: int) -> np.ndarray:
    """Rows moved so that column i holds what lies at i - diag, UNKNOWN outside; rows of one diagonal move together."""
    out = np.full((len(codes), width), UNKNOWN, np.uint8)
    order = np.argsort(diag, kind="stable")
    values, starts = np.unique(diag[order], return_index=True)
    for d, rows in zip(values.tolist(), np.split(order, starts[1:])):
        lo, hi = max(0, d), min(width, codes.shape[1] + d)
        if lo < hi:
            out[rows, lo:hi] = codes[rows, lo - d : hi - d]
    return out


def compared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bases compared, bases that differ) column by column."""
    both = (a | b) < UNKNOWN
    differ = both & (a != b)
    return both.view(np.uint8).sum(axis=1, dtype=np.uint32).astype(np.int64), differ.view(np.uint8).sum(axis=1, dtype=np.uint32).astype(np.int64)


def touched_pieces(a: np.ndarray, b: np.ndarray, diag: np.ndarray, reach: int) -> np.ndarray:
    """Pieces of 8 known columns of `a` that differ from `b` wherever they are laid within `reach` of the diagonal, where b is known too.

    An edit touches one piece, so this is no more than the edits of any alignment that stays within `reach`. Pieces near unknown bases do
    not count, since gaps over these cost nothing.
    """
    width = -(-a.shape[1] // 8) * 8
    x = np.full((len(a), width), UNKNOWN, np.uint8)
    x[:, : a.shape[1]] = a
    wide = shifted(b, diag + reach, width + 2 * reach)
    touched = ~((x >= UNKNOWN).view(np.uint64) != 0)
    holes = np.zeros((len(a), wide.shape[1] + 1), np.int32)
    np.cumsum(wide >= UNKNOWN, axis=1, out=holes[:, 1:])
    touched &= holes[:, 8 + 2 * reach :: 8] == holes[:, : width - 7 : 8]
    for d in range(2 * reach + 1):
        touched &= (x != wide[:, d : d + width]).view(np.uint64) != 0
    return touched.sum(axis=1)


def banded_edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, diag: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, bases compared) of the best overlap alignment whose path stays within `reach` of each pair's diagonal.

    What either sequence has beyond the other's end is free. UNKNOWN matches anything and is not compared. Of equally few edits, the
    path with most compared bases counts. Position i of `a` lies against i - diag of `b`.
    """
    n, big, unit, width = len(a), np.int32(1 << 28), np.int32(1 << 12), 2 * reach + 1
    top, off = int(la.max(initial=0)), np.arange(-reach, reach + 1)
    # column c of `y` holds b's base for row i = c - o and offset o; cost = edits * unit - compared
    y = shifted(b, diag + reach, top + width)
    known = y < UNKNOWN
    gap_b = np.where(known, unit, 0).astype(np.int32)
    prev = np.full((n, width), big, np.int32)
    best = np.full(n, big, np.int32)
    for i in range(top + 1):
        j = (i - diag)[:, None] + off
        inside = (j >= 0) & (j <= lb[:, None])
        if i == 0:
            cur = np.where(inside, 0, big).astype(np.int32)
        else:
            x = a[:, i - 1 : i]
            w = y[:, i - 1 : i - 1 + width]
            step = np.where((x < UNKNOWN) & known[:, i - 1 : i - 1 + width], np.where(x == w, np.int32(-1), unit - 1), 0)
            cur = prev + step
            np.minimum(cur[:, :-1], prev[:, 1:] + np.where(x < UNKNOWN, unit, 0), out=cur[:, :-1])
            cur[j == 0] = 0
            cur[~inside] = big
            run = np.cumsum(gap_b[:, i - 1 : i - 1 + width], axis=1, dtype=np.int32)
            cur = np.minimum.accumulate(cur - run, axis=1) + run
            cur[~inside] = big
        live = i <= la
        done = inside & ((j == lb[:, None]) | (i == la)[:, None]) & live[:, None]
        np.minimum(best, np.where(done, cur, big).min(axis=1), out=best)
        prev = cur
    edits = (best + unit - 1) // unit
    return edits, edits * unit - best


def pack(seq: bytes) -> bytes:
    """Four bases a byte, with the places of N beside them."""
    codes = CODES[np.frombuffer(seq, np.uint8)]
    holes = np.flatnonzero(codes == UNKNOWN).astype(np.uint32)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes & 3
    q = padded.reshape(-1, 4)
    body = (q[:, 0] << 6) | (q[:, 1] << 4) | (q[:, 2] << 2) | q[:, 3]
    return np.array([len(codes), len(holes)], np.uint32).tobytes() + holes.tobytes() + body.astype(np.uint8).tobytes()


_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_QUADS = _LETTERS[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]


def unpack(data: bytes) -> bytes:
    n, m = np.frombuffer(data, np.uint32, 2)
    out = _QUADS[np.frombuffer(data, np.uint8, offset=8 + 4 * int(m))].reshape(-1)[: int(n)].copy()
    if m:
        out[np.frombuffer(data, np.uint32, int(m), 8)] = 78
    return out.tobytes()
