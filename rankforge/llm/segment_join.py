"""The same or almost the same records across splits, by an edit-distance segment join (p1).

A sequence is cut into segments so short that edits leave some of them untouched in any sequence almost the same. A scan of
the other table looks up all windows of its sequences in an index of these segments and counts them for each pair; pairs with too few
for their overlap are dropped, and the rest is verified by comparison on the diagonal and, failing that, by banded dynamic programming.
The index is sorted files in the shared folder that workers map, so that hits, far more than pairs, are neither moved nor held; where
the shared folder is no path of the machine, segments and windows are joined by shuffle.

Unknown bases hide segments. A sequence is of the first class whose segments, laid between its stretches of unknown bases, leave enough of
them in any LEAST_BASES known bases; the segments of each class are shorter than those of the class before. Of a pair, the
sequence of the higher class is cut and the other one scanned: evaluation sequences are cut for the scan of the training table, and
the training sequences of the higher classes for one of the evaluation table.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.barcode_kernels import UNKNOWN, banded_edits, blocks, canonical, compared, flip, matrix, pack, plain_bases, shifted, touched_pieces, unpack, window_keys
from rankforge.runtime import bounded, built_once, cut, ensure_checkpoint_dir, forget_built, keep, shuffle_partitions, spread

LEAST_BASES = 300
#: Segments that class 1 and class 2 leave besides those which edits can hit, for the unknown bases of the other sequence.
SPARE = (0, 1, 2)
#: Bits of the table of segments for each segment, and at most in all (64 MB); a fuller table lets more windows through, no fewer.
BITS_EACH, MOST_BITS = 64, 1 << 29
CHUNK_WORDS = 4_096
PAIRS_AT_ONCE = 4_096
#: Bytes of evaluation sequences up to which each worker holds their segments; those of more are mapped from files, with the same result.
INDEX_BOUND = 32 * 1024 * 1024
#: Bases of the sequences of one file of a mapped index (about a million segments), and hits that a worker compares at once.
FILE_BASES, HITS_AT_ONCE = 1 << 24, 1 << 19
#: A window's or segment's numbers in one: (class + 4 x segments lost or held) x WIDE + length of its sequence.
WIDE = 1 << 32


@dataclass(frozen=True)
class Nearness:
    """What counts as almost the same: at least LEAST_BASES compared, at most `edits` + `share` of the compared bases edited."""

    edits: int = 5
    share: float = 0.0

    @property
    def tiers(self) -> tuple[tuple[int, int], ...]:
        """(length, step) of the segments of each class. Of class 0, any LEAST_BASES bases hold one whole segment more than edits; the last is for the rest."""
        at_least = self.edits + int(self.share * LEAST_BASES)
        whole = (LEAST_BASES + 1) // (at_least + 2)
        shorter = [max(14, int(whole * x)) for x in (0.7, 0.5)]
        return (whole, whole), (shorter[0], shorter[0]), (shorter[1], shorter[1]), (14, 7)

    def allowed(self, n):
        return self.edits + self.share * n


CROSS_SPLIT = Nearness()


def same_id(processid: Column) -> Column:
    """One spelling of a process id: capitals, letters and digits only, without the marker after a full stop."""
    plain = F.regexp_replace(F.upper(processid), r"\..*$", "")
    return F.regexp_replace(plain, r"[^A-Z0-9]", "")


def class_of(seq: bytes, near: Nearness) -> int:
    """First class of which any LEAST_BASES known bases of the sequence hold enough whole segments."""
    if b"N" not in seq:
        return 0
    known = np.frombuffer(seq, np.uint8) != 78
    before = np.r_[0, np.cumsum(known)]
    edges = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
    for c, (size, step) in enumerate(near.tiers[:-1]):
        if c == 0:
            continue
        at = np.concatenate([np.arange(x, y - size + 1, step) for x, y in zip(edges[::2], edges[1::2])])
        # the windows that hold least begin at the start or just after a segment's
        first = np.r_[0, at + 1]
        end = np.searchsorted(before, before[first] + LEAST_BASES)
        whole = np.searchsorted(at, end - size, "right") - np.searchsorted(at, first)
        whole = whole[end < len(before)]
        if len(whole) == 0 or whole.min() >= near.edits + int(near.share * LEAST_BASES) + 1 + SPARE[c]:
            return c
    return len(near.tiers) - 1


def _sid(seq: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(seq) - (1 << 63)


def segments(seqs: list[bytes], sid: np.ndarray, near: Nearness, classes: tuple[int, ...]) -> pd.DataFrame:
    """(h, sid, place, info): segments of the sequences of the classes given, laid from the start of each stretch of known bases.

    info has the class, the number of segments and the length of the sequence. h is the same for both strands; a place is negative where the other strand is the smaller.
    """
    cls = np.array([class_of(s, near) for s in seqs], np.int64)
    out = []
    for c in classes:
        size, step = near.tiers[c]
        own = np.flatnonzero(cls == c)
        for part in blocks([seqs[i] for i in own]):
            part = own[part]
            codes = matrix([seqs[i] for i in part])
            h, place, ok = window_keys(codes, size, c)
            if h.shape[1] == 0:
                continue
            col = np.arange(codes.shape[1])
            start = np.maximum.accumulate(np.where(codes == UNKNOWN, col + 1, 0), axis=1)[:, : h.shape[1]]
            row, at = np.nonzero(ok & ((col[: h.shape[1]] - start) % step == 0))
            n = np.bincount(row, minlength=len(part))
            length = np.array([len(seqs[i]) for i in part])
            out.append(pd.DataFrame({"h": h[row, at].view(np.int64), "sid": sid[part[row]], "place": place[row, at], "info": (c + 4 * n[row]) * WIDE + length[row]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: np.empty(0, np.int64) for k in ("h", "sid", "place", "info")})


def _lost(seq: bytes, size: int, step: int) -> int:
    """Segments of another sequence that the unknown bases of this one can hide."""
    out = 0
    if b"N" in seq:
        run = 0
        for piece in seq.split(b"N"):
            if run and piece:
                out += (run + size - 2) // step + 1
                run = 0
            run += 1
    return out


def listed_windows(seqs: list[bytes], sid: np.ndarray, near: Nearness, table: tuple[np.ndarray, frozenset[int]], above: int, parts: int = 1) -> pd.DataFrame:
    """(h, sid, place, info): windows of the sequences that may be a segment of a sequence of class `above` more or higher."""
    cls = np.array([class_of(s, near) for s in seqs], np.int64)
    out = []
    for c, (size, step) in enumerate(near.tiers):
        own = np.flatnonzero(cls + above <= c) if c in table[1] else []
        for part in blocks([seqs[i] for i in own]):
            part = own[part]
            h, place, ok = window_keys(matrix([seqs[i] for i in part]), size, c)
            row, at = np.nonzero(ok)
            hv = h[row, at]
            some = np.flatnonzero(_marked(hv, table[0], parts))
            row, at = row[some], at[some]
            lost = np.array([_lost(seqs[i], size, step) for i in part])
            length = np.array([len(seqs[i]) for i in part])
            out.append(pd.DataFrame({"h": hv[some].view(np.int64), "sid": sid[part[row]], "place": place[row, at], "info": (c + 4 * lost[row]) * WIDE + length[row]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: np.empty(0, np.int64) for k in ("h", "sid", "place", "info")})


def _marked(h: np.ndarray, bits: np.ndarray, parts: int = 1) -> np.ndarray:
    """Whether both bits of each number are set; with `parts`, a power of 2, its first bits say in which of so many equal tables they lie."""
    size = len(bits) * 64 // parts
    mask = np.uint64(size - 1)
    base = (h >> np.uint64(65 - parts.bit_length())) * np.uint64(size) if parts > 1 else np.uint64(0)
    hit = np.ones(len(h), bool)
    for probe in ((h & mask) + base, ((h >> np.uint64(32)) & mask) + base):
        at = np.flatnonzero(hit)
        p = probe[at]
        hit[at] = (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return hit


def bit_table(segs: DataFrame) -> tuple[np.ndarray, frozenset[int]]:
    """(the bits of all segments, two each; the classes that occur). Words are combined on the executors, and only the table, of bounded size, comes to the driver."""
    by_class = dict(segs.groupBy(F.pmod(F.floor(F.col("info") / WIDE), F.lit(4)).cast("int")).count().collect())
    count, size = sum(by_class.values()), 1 << 16
    while size < min(MOST_BITS, BITS_EACH * count):
        size <<= 1
    both = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1))))
    words = segs.select(both.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, at = b["word"].to_numpy() // CHUNK_WORDS, b["word"].to_numpy() % CHUNK_WORDS
            for c in np.unique(chunk).tolist():
                own = chunk == c
                held.setdefault(c, np.zeros(CHUNK_WORDS, np.int64))[at[own]] |= b["w"].to_numpy()[own]
        yield pd.DataFrame({"chunk": list(held), "bits": [x.tobytes() for x in held.values()]})

    n = shuffle_partitions(segs.sparkSession)
    out = np.zeros(size // 64, np.uint64)
    for r in words.repartition(n, F.floor(F.col("word") / CHUNK_WORDS)).mapInPandas(packed, "chunk long, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint64)
        at = r["chunk"] * CHUNK_WORDS
        out[at : at + CHUNK_WORDS] = part[: len(out) - at]
    return out, frozenset(by_class)


def verify(a: list[bytes], b: list[bytes], sign: np.ndarray, shift: np.ndarray, near: Nearness) -> np.ndarray:
    """Whether each pair, position x of a at sign * x + shift of b, has LEAST_BASES compared bases and no more edits than allowed."""
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), PAIRS_AT_ONCE):
        for part in blocks(a[at : at + PAIRS_AT_ONCE], PAIRS_AT_ONCE, b[at : at + PAIRS_AT_ONCE]):
            part = part + at
            x, y = [a[i] for i in part], [b[i] for i in part]
            la, lb = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            ma, mb = matrix(x), matrix(y)
            back, diag = sign[part] < 0, shift[part].astype(np.int64)
            if back.any():
                ma[back] = flip(ma[back], la[back])
                diag = np.where(back, diag - la + 1, diag)
            n, d = compared(ma, shifted(mb, -diag, ma.shape[1]))
            good = (n >= LEAST_BASES) & (d <= near.allowed(n))
            reach = int(near.allowed(LEAST_BASES))
            rest = np.flatnonzero(~good & (n >= LEAST_BASES - 2 * reach))
            if len(rest):
                least = touched_pieces(ma[rest], mb[rest], -diag[rest], reach)
                rest = rest[least <= near.allowed(n[rest] + 2 * reach)]
            if len(rest):
                edits, m = banded_edits(ma[rest], la[rest], mb[rest], lb[rest], -diag[rest], reach)
                good[rest] = (m >= LEAST_BASES) & (edits <= near.allowed(m))
            ok[part] = good
    return ok


def _enough(near: Nearness, ia, ib, sign, shift, hits):
    """Whether pairs of a scanned sequence (info ia) and a cut one (ib) have the overlap and the segments that the edits leave at least."""
    size, step = (np.array([t[i] for t in near.tiers])[ia // WIDE % 4] for i in (0, 1))
    lost, la, n, lb = ia // WIDE // 4, ia % WIDE, ib // WIDE // 4, ib % WIDE
    first = np.where(sign > 0, shift, shift - la + 1)
    start, end = np.maximum(first, 0), np.minimum(first + la, lb)
    touch = -(-size // step)
    outside = start // step + (lb - end) // step + 2 * touch
    edits = near.edits + np.ceil(near.share * (end - start))
    need = n - outside - edits * touch - lost
    return (end - start >= LEAST_BASES - edits) & (hits >= need) & (hits >= np.where(step < size, 2, 1))


def _outermost(near: Nearness, good, low, high):
    """Pairs whose segments lie on diagonals too far from each other for one band."""
    return good & (high - low > 2 * int(near.allowed(LEAST_BASES)))


def candidates(scanned: DataFrame, cut_: DataFrame, near: Nearness) -> DataFrame:
    """(a, b, sign, shift): pairs of a scanned sequence a and a cut one b with as many common segments as the edits leave at least.

    Both sides are (h, sid, place, info). Where a pair's segments lie on diagonals too far from each other for one band, the outermost
    are candidates too.
    """
    tiers = near.tiers
    s = scanned.select("h", F.col("sid").alias("a"), F.col("place").alias("pa"), F.col("info").alias("ia"))
    c = cut_.select("h", F.col("sid").alias("b"), F.col("place").alias("pb"), F.col("info").alias("ib"))
    hit = s.join(c, "h")
    size = F.element_at(F.array(*[F.lit(t[0]) for t in tiers]), F.pmod(F.floor(F.col("ia") / WIDE), F.lit(4)).cast("int") + 1)
    xa, xb = F.when(F.col("pa") < 0, -F.col("pa") - 1).otherwise(F.col("pa")), F.when(F.col("pb") < 0, -F.col("pb") - 1).otherwise(F.col("pb"))
    same = (F.col("pa") < 0) == (F.col("pb") < 0)
    # shift and, in the last bit, whether the strands differ
    one = hit.select("a", "b", "ia", "ib", F.when(same, 2 * (xb - xa)).otherwise(2 * (xb + size - 1 + xa) + 1).alias("rel")).groupBy("a", "b", "ia", "ib", "rel").agg(F.count(F.lit(1)).alias("c"))
    one = one.withColumn("sign", F.when(F.pmod("rel", F.lit(2)) == 0, 1).otherwise(-1)).withColumn("shift", F.floor(F.col("rel") / 2).cast("int"))
    pair = one.groupBy("a", "b", "ia", "ib", "sign").agg(F.sum("c").alias("hits"), F.max(F.col("c") * WIDE + F.col("shift") + WIDE // 2).alias("top"), F.min("shift").alias("lo"), F.max("shift").alias("hi"))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v = {c: x[c].to_numpy(np.int64) for c in ("ia", "ib", "sign", "hits", "top", "lo", "hi")}
            best = v["top"] % WIDE - WIDE // 2  # the diagonal of most segments, of equals the one furthest on
            good = _enough(near, v["ia"], v["ib"], v["sign"], best, v["hits"])
            wide = _outermost(near, good, v["lo"], v["hi"])
            for rows, shift in ((good, best), (wide, v["lo"]), (wide, v["hi"])):
                yield x.loc[rows, ["a", "b", "sign"]].assign(shift=shift[rows])

    return pair.mapInPandas(kept, "a long, b long, sign int, shift int")


def _counted(near: Nearness, a, pa, ia, b, pb, ib):
    """(a, b, sign, shift) of the pairs with enough hits, of window (place pa, info ia) of a on segment (pb, ib) of b, as candidates() has them."""
    size = np.array([t[0] for t in near.tiers])[ia // WIDE % 4]
    xa, xb, same = np.where(pa < 0, -pa - 1, pa), np.where(pb < 0, -pb - 1, pb), (pa < 0) == (pb < 0)
    turned, shift = (~same).astype(np.int64), np.where(same, xb - xa, xb + size - 1 + xa)
    order = np.lexsort((shift, turned, b, a))
    a, b, turned, shift, ia, ib = (x[order] for x in (a, b, turned, shift, ia, ib))
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (turned[1:] != turned[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(a)] - 1
    hits = last - first + 1
    # the diagonal of most segments of a pair, of equals the one furthest on
    line = np.flatnonzero(new | np.r_[True, shift[1:] != shift[:-1]])
    count, of = np.diff(np.r_[line, len(a)]), np.cumsum(new)[line] - 1
    by = np.lexsort((count, of))
    best = shift[line][by[np.r_[of[by][1:] != of[by][:-1], True]]]
    sign, low, high = 1 - 2 * turned[first], shift[first], shift[last]
    good = _enough(near, ia[first], ib[first], sign, best, hits)
    a, b = a[first], b[first]
    wide = _outermost(near, good, low, high)
    a, b, sign, shift = (np.concatenate([x[good], x[wide], x[wide]]) for x in (a, b, sign, best))
    shift[good.sum() :] = np.concatenate([low[wide], high[wide]])
    return a, b, sign, shift


class SegmentIndex:
    """Segments of a bounded number of sequences, sorted by hash, with a table of their bits."""

    def __init__(self, seqs: list[bytes], near: Nearness) -> None:
        self.seqs, self.near = seqs, near
        segs = segments(seqs, np.arange(len(seqs)), near, tuple(range(len(near.tiers)))).sort_values("h", kind="stable")
        self.h, self.who, self.place, self.info = (segs[c].to_numpy(np.int64) for c in ("h", "sid", "place", "info"))
        size = 1 << 16
        while size < min(MOST_BITS, BITS_EACH * len(self.h)):
            size <<= 1
        bits, mask, h = np.zeros(size // 64, np.uint64), np.uint64(size - 1), self.h.view(np.uint64)
        for probe in (h & mask, (h >> np.uint64(32)) & mask):
            np.bitwise_or.at(bits, (probe >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), probe & np.uint64(63)))
        self.table = bits, frozenset(np.unique(self.info // WIDE % 4).tolist())

    def pairs(self, seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the scanned sequence, number of the held one) of pairs almost the same, of which the held one is of the same class or a higher."""
        w = listed_windows(seqs, np.arange(len(seqs)), self.near, self.table, 0)
        h = w["h"].to_numpy(np.int64)
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n = hi - lo
        if n.sum() == 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        a, pa, ia = (np.repeat(w[c].to_numpy(np.int64), n) for c in ("sid", "place", "info"))
        b, pb, ib = self.who[at], self.place[at], self.info[at]
        a, b, sign, shift = _counted(self.near, a, pa, ia, b, pb, ib)
        ok = verify([seqs[i] for i in a], [self.seqs[i] for i in b], sign, shift, self.near)
        return a[ok], b[ok]


def shared_path(spark: SparkSession) -> str | None:
    """The shared checkpoint folder as a path of this machine, None where it is none."""
    local = re.sub(r"^file:(//)?(?=/)", "", ensure_checkpoint_dir(spark))
    return local if local.startswith("/") else None


def _save(path: str, data: bytes | np.ndarray) -> None:
    """Written aside and renamed: a task run twice leaves one whole file."""
    with open(aside := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(data)
    os.replace(aside, path)


def _mapped(path: str, kind: type) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.empty(0, kind)


def write_index(sequences: DataFrame, near: Nearness, classes: tuple[int, ...], folder: str) -> tuple[str, int, frozenset[int]]:
    """(folder, number of parts, classes that occur) of an index of the distinct (sid, seq), for MappedIndex.

    Part i has the segments, and the sequences, whose hash begins with the bits of i: files of the segments sorted by h, of their bits,
    and of the sequences sorted by sid. Each is written by one task; only the classes come to the driver. The sequences are read three times.
    An index that workers held before is let go, so that its files give their disk back.
    """
    os.makedirs(folder, exist_ok=True)
    letters = sequences.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    parts = 1 << max(0, int(4 * letters / FILE_BASES - 1e-9)).bit_length()
    first, size = 65 - parts.bit_length(), 1 << 16
    while size < min(MOST_BITS, BITS_EACH * 4 * letters // 16):
        size <<= 1
    size = max(64, size // parts)

    def cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_built()
        for b in batches:
            yield segments([unpack(x) for x in b["seq"]], b["sid"].to_numpy(np.int64), near, classes)

    def part_of(x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) >> np.uint64(first)).astype(np.int64) if parts > 1 else np.zeros(len(x), np.int64)

    def save_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [np.stack([b[c].to_numpy(np.int64) for c in ("h", "sid", "place", "info")]) for b in batches]
        if not sum(x.shape[1] for x in some):
            return
        all_ = np.concatenate(some, axis=1)
        all_ = all_[:, np.argsort(all_[0].view(np.uint64), kind="stable")]
        own = part_of(all_[0])
        for p in np.unique(own).tolist():
            x = all_[:, slice(*np.searchsorted(own, [p, p + 1]))]
            _save(f"{folder}/segments-{p}", np.ascontiguousarray(x))
            h, bits, mask = x[0].view(np.uint64), np.zeros(size // 64, np.uint64), np.uint64(size - 1)
            for probe in (h & mask, (h >> np.uint64(32)) & mask):
                np.bitwise_or.at(bits, (probe >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), probe & np.uint64(63)))
            _save(f"{folder}/bits-{p}", bits)
        yield pd.DataFrame({"c": np.unique(all_[3] // WIDE % 4)})

    def save_sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = [(b["sid"].to_numpy(np.int64), list(b["seq"])) for b in batches]
        sid = np.concatenate([np.empty(0, np.int64), *(x for x, _ in some)])
        seqs = [bytes(x) for _, xs in some for x in xs]
        order = np.argsort(sid.view(np.uint64), kind="stable")
        own = part_of(sid[order])
        for p in np.unique(own).tolist():
            at = order[slice(*np.searchsorted(own, [p, p + 1]))]
            begin = np.cumsum([0, *(len(seqs[i]) for i in at)])
            _save(f"{folder}/sequences-{p}", np.int64([len(at)]).tobytes() + sid[at].tobytes() + begin.astype(np.int64).tobytes() + b"".join(seqs[i] for i in at))
        yield pd.DataFrame({"c": np.empty(0, np.int64)})

    def by(c: str) -> Column:
        return F.shiftrightunsigned(c, first) if parts > 1 else F.lit(0)

    cut_ = sequences.mapInPandas(cut_rows, "h long, sid long, place int, info long")
    found = {r["c"] for r in cut_.repartition(parts, by("h")).mapInPandas(save_segments, "c long").distinct().collect()}
    sequences.select("sid", "seq").repartition(parts, by("sid")).mapInPandas(save_sequences, "c long").count()
    return folder, parts, frozenset(found)


class MappedIndex:
    """An index of write_index, mapped from its files: of any number of sequences, of which a worker holds the bits alone."""

    def __init__(self, written: tuple[str, int, frozenset[int]], near: Nearness) -> None:
        folder, self.parts, classes = written
        self.near, every = near, range(self.parts)
        self.segments = [_mapped(f"{folder}/segments-{p}", np.int64).reshape(4, -1) for p in every]
        bits = [_mapped(f"{folder}/bits-{p}", np.uint64) for p in every]
        size = max([1, *map(len, bits)])
        self.table = np.concatenate([b if len(b) else np.zeros(size, np.uint64) for b in bits]), classes
        self.sequences = []
        for p in every:
            x = _mapped(f"{folder}/sequences-{p}", np.uint8)
            n = int(x[:8].view(np.int64)[0]) if len(x) else 0
            self.sequences.append((x[8 : 8 + 8 * n].view(np.uint64), x[8 + 8 * n : 16 + 16 * n].view(np.int64), x[16 + 16 * n :]))

    def _by_part(self, h: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(part, its rows) of sorted hashes."""
        first = (h >> np.uint64(65 - self.parts.bit_length())).astype(np.int64) if self.parts > 1 else np.zeros(len(h), np.int64)
        edge = np.searchsorted(first, np.arange(self.parts + 1))
        return ((p, slice(edge[p], edge[p + 1])) for p in range(self.parts) if edge[p] < edge[p + 1])

    def _held(self, sid: np.ndarray) -> dict[int, bytes]:
        """The sequences of sorted distinct ids, which are all there."""
        out = {}
        for p, rows in self._by_part(sid.view(np.uint64)):
            ids, begin, letters = self.sequences[p]
            at = np.searchsorted(ids, sid[rows].view(np.uint64))
            for s, i, j in zip(sid[rows].tolist(), begin[at].tolist(), begin[at + 1].tolist()):
                out[s] = unpack(letters[i:j].tobytes())
        return out

    def pairs(self, seqs: list[bytes], above: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(number of the scanned sequence, sid of the held one) of pairs almost the same, of which the held one is of class `above` more or higher."""
        w = listed_windows(seqs, np.arange(len(seqs)), self.near, self.table, above, self.parts)
        h = w["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h, kind="stable")
        h, lo, n, part = h[order], np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for p, rows in self._by_part(h):
            keys = self.segments[p][0].view(np.uint64)
            lo[rows], part[rows] = np.searchsorted(keys, h[rows], "left"), p
            n[rows] = np.searchsorted(keys, h[rows], "right") - lo[rows]
        who, pa, ia = (w[c].to_numpy(np.int64)[order] for c in ("sid", "place", "info"))
        some = np.flatnonzero(n)
        some = some[np.argsort(who[some], kind="stable")]
        who, pa, ia, lo, n, part = (x[some] for x in (who, pa, ia, lo, n, part))
        # whole scanned sequences at a time, as many as make HITS_AT_ONCE hits
        ends = np.flatnonzero(np.r_[who[1:] != who[:-1], True]) + 1 if len(who) else np.empty(0, np.int64)
        hits = np.cumsum(n)[ends - 1] if len(ends) else ends
        out, begin, k = [], 0, 0
        while k < len(ends):
            k = max(k + 1, int(np.searchsorted(hits, (hits[k - 1] if k else 0) + HITS_AT_ONCE, "right")))
            x = slice(begin, ends[k - 1])
            begin = ends[k - 1]
            by = np.argsort(part[x], kind="stable") + x.start
            m = n[by]
            at = np.repeat(lo[by] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            b, pb, ib = (np.empty(len(at), np.int64) for _ in range(3))
            last = np.cumsum(m)
            edge = np.searchsorted(part[by], np.arange(self.parts + 1))
            for p in np.unique(part[by]).tolist():
                rows = slice(last[edge[p] - 1] if edge[p] else 0, last[edge[p + 1] - 1])
                b[rows], pb[rows], ib[rows] = (self.segments[p][c][at[rows]] for c in (1, 2, 3))
            a, b, sign, shift = _counted(self.near, *(np.repeat(v[by], m) for v in (who, pa, ia)), b, pb, ib)
            held = self._held(np.unique(b.view(np.uint64)).view(np.int64))
            ok = verify([seqs[i] for i in a], [held[i] for i in b.tolist()], sign, shift, self.near)
            out.append((a[ok], b[ok]))
        return tuple(np.concatenate([np.empty(0, np.int64), *(o[i] for o in out)]) for i in (0, 1))


#: kind 0: a record's sequence (processid, sid). 1: a window, 2: a segment (h, sid, place, info). 3: a sequence (sid, seq). 4: a pair (sid, other in h).
_SCAN = "kind int, processid string, h long, sid long, place int, info long, seq binary"
_COLUMNS = [c.split()[0] for c in _SCAN.split(", ")]


def _row_frame(df: pd.DataFrame, kind: int) -> pd.DataFrame:
    out = df.assign(kind=kind).reindex(columns=_COLUMNS)
    for c in ("processid", "seq"):
        if out[c].isna().all():
            out[c] = pd.Series([None] * len(out), dtype=object)
    return out.astype({c: "Int64" for c in ("h", "sid", "place", "info")} | {"kind": "int32"})


def _prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Canonical sequences of rows; null where fewer than LEAST_BASES bases are plain."""
    for b in batches:
        seqs = [canonical(x if isinstance(x, str) else None) for x in b["nucleotides"]]
        fit = [plain_bases(s) >= LEAST_BASES for s in seqs]
        yield pd.DataFrame({"processid": b["processid"], "sid": pd.array([_sid(s) if f else None for s, f in zip(seqs, fit)], dtype="Int64"), "seq": [pack(s) if f else None for s, f in zip(seqs, fit)]})


def _cut_rows(near: Nearness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield segments([unpack(x) for x in b["seq"]], b["sid"].to_numpy(np.int64), near, tuple(range(len(near.tiers))))

    return run


def sequence_pairs(evaluation: DataFrame, train: DataFrame, near: Nearness = CROSS_SPLIT) -> DataFrame:
    """(sid, train_processid): evaluation sequences with the training records that are almost the same, more than once where a record's rows are.

    `evaluation` has distinct (sid, seq). Both tables are scanned once, and pairs verified where the scan stands. Evaluation sequences of up
    to INDEX_BOUND bytes are held, cut, by each worker of the scan of the training table; those of more, and the training sequences of the
    higher classes, are mapped from files in the shared folder, which go when the pairs are written.

    Where that folder is no path of the machine, segments and the windows that a bit table lets through are joined by shuffle instead;
    nothing but this table, of at most MOST_BITS, comes to the driver.
    """
    spark = train.sparkSession
    context = spark.sparkContext
    form = "h long, sid long, place int, info long"
    n, letters = evaluation.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
    held = letters + 64 * n <= INDEX_BOUND
    token = uuid.uuid4().hex
    shared = shared_path(spark)
    folder = shared and f"{shared}/rankforge-segments-{token}"
    if not held and folder:
        shipped = context.broadcast(write_index(evaluation, near, tuple(range(len(near.tiers))), f"{folder}/evaluation"))
    elif held:
        got = evaluation.select("sid", "seq").toPandas()
        shipped = context.broadcast((got["sid"].to_numpy(np.int64), [bytes(x) for x in got["seq"]]))
    else:
        segs = keep(evaluation.mapInPandas(_cut_rows(near), form))
        shipped = context.broadcast(bit_table(segs))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if held:
            index = built_once(token, lambda: SegmentIndex([unpack(x) for x in shipped.value[1]], near))
        elif folder:
            index = built_once(token, lambda: MappedIndex(shipped.value, near))
        for b in batches:
            pids, rows, seen = [], [], {}
            for p, text in zip(b["processid"], b["nucleotides"]):
                s = canonical(text)
                if plain_bases(s) >= LEAST_BASES:
                    pids.append(p)
                    rows.append(seen.setdefault(s, len(seen)))
            if not rows:
                continue
            seqs = list(seen)
            sid = np.array([_sid(s) for s in seqs], np.int64)
            if folder:
                used, parts = np.array([class_of(s, near) for s in seqs]) > 0, []
            else:
                own = segments(seqs, sid, near, tuple(range(1, len(near.tiers))))
                used, parts = np.isin(sid, own["sid"].to_numpy()), [(own, 2)]
            if held or folder:
                t, e = index.pairs(seqs)
                parts.append((pd.DataFrame({"sid": sid[t], "h": shipped.value[0][e] if held else e}).drop_duplicates(), 4))
                named = used.copy()
                named[t] = True
            else:
                windows = listed_windows(seqs, sid, near, shipped.value, 0)
                parts.append((windows, 1))
                used |= np.isin(sid, windows["sid"].to_numpy())
                named = used
            records = pd.DataFrame({"processid": pids, "sid": sid[rows]}).drop_duplicates()
            parts.append((records[np.isin(records["sid"], sid[named])], 0))
            parts.append((pd.DataFrame({"sid": sid[used], "seq": [pack(s) for s, u in zip(seqs, used) if u]}), 3))
            for part, kind in parts:
                if len(part):
                    yield _row_frame(part.reset_index(drop=True), kind)

    usable = spread(train.select("processid", "nucleotides").where("processid is not null and nucleotides is not null"), "processid")
    read = usable.mapInPandas(scan, _SCAN)
    if folder:
        read = cut(read)
        shipped.unpersist()
        shutil.rmtree(f"{folder}/evaluation", ignore_errors=True)
        own = keep(read.where("kind = 3").select("sid", "seq").dropDuplicates(["sid"]))
        written = write_index(own, near, tuple(range(1, len(near.tiers))), f"{folder}/train")
        own.unpersist()

        def scan_mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = built_once(f"{token}-back", lambda: MappedIndex(written, near))
            for b in batches:
                e, t = index.pairs([unpack(x) for x in b["seq"]], 1)
                yield pd.DataFrame({"t": t, "sid": b["sid"].to_numpy(np.int64)[e]})

        good = cut(spread(evaluation, "sid").mapInPandas(scan_mapped, "t long, sid long"))
        shutil.rmtree(folder, ignore_errors=True)
        return _named(read, good.unionByName(read.where("kind = 4").select(F.col("sid").alias("t"), F.col("h").alias("sid"))))
    read = keep(read)
    seqs = keep(read.where("kind = 3").groupBy("sid").agg(F.first("seq").alias("seq")))
    other = keep(read.where("kind = 2").select("h", "sid", "place", "info").distinct())
    back = context.broadcast(bit_table(other))

    def scan_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield listed_windows([unpack(x) for x in b["seq"]], b["sid"].to_numpy(np.int64), near, back.value, 1)

    # position x of e at sign x + shift of t is position x of t at sign x - sign shift of e
    pairs = candidates(evaluation.mapInPandas(scan_back, form), other, near)
    pairs = pairs.select(F.col("b").alias("t"), F.col("a").alias("e"), "sign", (-F.col("sign") * F.col("shift")).cast("int").alias("shift"))
    if not held:
        # a sequence met in several batches has its windows as often, which only lets more pairs through
        pairs = pairs.unionByName(candidates(read.where("kind = 1"), segs, near).select(F.col("a").alias("t"), F.col("b").alias("e"), "sign", "shift")).distinct()
    small = bounded(evaluation, "seq")
    pairs = pairs.join(seqs.select(F.col("sid").alias("t"), F.col("seq").alias("ts")), "t").join(small(evaluation.select(F.col("sid").alias("e"), F.col("seq").alias("es"))), "e")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), PAIRS_AT_ONCE):
                x = b.iloc[at : at + PAIRS_AT_ONCE]
                ok = verify([unpack(s) for s in x["ts"]], [unpack(s) for s in x["es"]], x["sign"].to_numpy(), x["shift"].to_numpy(), near)
                yield pd.DataFrame({"t": x["t"].to_numpy()[ok], "sid": x["e"].to_numpy()[ok]})

    good = pairs.mapInPandas(checked, "t long, sid long")
    if held:
        good = good.unionByName(read.where("kind = 4").select(F.col("sid").alias("t"), F.col("h").alias("sid")))
    return _named(read, good)


def _named(read: DataFrame, good: DataFrame) -> DataFrame:
    """(sid, train_processid) of pairs (t, sid) of sequences."""
    records = read.where("kind = 0").select("processid", F.col("sid").alias("t")).distinct()
    return records.join(good.distinct(), "t").select("sid", F.col("processid").alias("train_processid"))


def _rows(splits: dict[str, DataFrame]) -> DataFrame:
    """(split, processid, source, nucleotides) of the evaluation rows that have a process id."""
    rows = None
    for name, df in splits.items():
        x = df.where("processid is not null").select(F.lit(name).alias("split"), "processid", "source", "nucleotides")
        rows = x if rows is None else rows.unionByName(x)
    return rows


def _matches(rows: DataFrame, train: DataFrame) -> DataFrame:
    """(processid, train_processid, i, s): pairs by id (i) and by sequence (s), each at least once. What is moved is one side of each join; pairs are not."""
    prepared = keep(rows.select("processid", "nucleotides").distinct().mapInPandas(_prepared, "processid string, sid long, seq binary"))
    usable = prepared.where("seq is not null")
    near = sequence_pairs(cut(usable.select("sid", "seq").dropDuplicates(["sid"])), train)
    by_sequence = usable.select("sid", "processid").distinct().join(near, "sid").select("processid", "train_processid", F.lit(False).alias("i"), F.lit(True).alias("s"))
    ids = train.where("processid is not null").select(F.col("processid").alias("train_processid"), same_id(F.col("processid")).alias("k")).where("k <> ''")
    by_id = rows.select("processid").distinct().withColumn("k", same_id(F.col("processid"))).join(ids, "k").select("processid", "train_processid", F.lit(True).alias("i"), F.lit(False).alias("s"))
    return by_sequence.unionByName(by_id)


def overlap_pairs(splits: dict[str, DataFrame], train: DataFrame) -> DataFrame:
    """(processid_a, processid_b): the process ids of the pairs of overlaps(), each pair once, the smaller first. Pairs are moved once."""
    a, b = F.col("processid"), F.col("train_processid")
    return _matches(_rows(splits), train).select(F.least(a, b).alias("processid_a"), F.greatest(a, b).alias("processid_b")).distinct()


def overlaps(splits: dict[str, DataFrame], train: DataFrame) -> DataFrame:
    """(split, source, eval_processid, train_processid, by_id, by_sequence): each pair of an evaluation and a training record
    with the same process id, however written, or almost the same sequence.

    source is the evaluation record's, the smallest where its rows differ. Null process ids are no records and pair with nothing;
    unusable sequences pair by id only. Empty tables give no rows.
    """
    rows = _rows(splits)
    records = rows.groupBy("split", "processid").agg(F.min("source").alias("source"))
    pairs = _matches(rows, train).groupBy("processid", "train_processid").agg(F.max("i").alias("by_id"), F.max("s").alias("by_sequence"))
    return records.join(pairs, "processid").select("split", "source", F.col("processid").alias("eval_processid"), "train_processid", "by_id", "by_sequence")


def overlap_report(found: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_by_id, n_by_sequence, n_eval_records) of the overlaps."""
    return found.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.col("by_id").cast("long")).alias("n_by_id"),
        F.sum(F.col("by_sequence").cast("long")).alias("n_by_sequence"),
        F.countDistinct("eval_processid").alias("n_eval_records"),
    )
