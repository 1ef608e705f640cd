"""Groups of near-identical texts by an exact set-similarity self-join.

Two texts are linked when the sets of their word sequences have a Jaccard similarity of at least ``threshold``.
The join is the universe-partition pigeonhole scheme:

* Sets are put into size bands.  A band cuts the universe of hashed shingles into segments, about ``0.6 / a`` shingles
  each, where ``a = (1 - t) / (1 + t)`` bounds the difference of a pair: ``|r ^ s| <= H = floor(a (|r| + |s|))``.
* A set is indexed under its subset of every segment and, for segments with two shingles or more, under every subset
  that lacks one of them (the one-deletion neighbourhood).  A segment in which two sets differ by at most ``k`` (0 for one
  shingle, 1 for more) *agrees* with weight ``k + 1``; all other segments cost at least their weight of the difference.
  So a pair within ``H`` agrees with a weight of at least ``capacity - H``.
* Allocation by cost: the work of a signature is the number of sets of fitting size that share it.  Where it is above
  ``cost_limit`` the segment is skipped (or falls from one deletion to none) for that set, and the weight is taken from its
  capacity.  A set that has no capacity left is allocated anew over neighbouring segments merged into larger ones
  (:meth:`Scheme.merged`), whose signatures of more shingles are rarer: one more pass, linear in the table, in which only such sets
  look for partners.  Where that does not do either, as in a group of more than ``cost_limit`` texts that really are alike, the
  least limit that leaves capacity is allocated to the set from its own costs, up to ``most_cost``.  What has none even then is
  compared with all sets, in blocks of a bounded number of such sets; their number is reported and bounded loudly.
* Pairs with enough agreement are verified on the whole sets.

Sets are classes: equal sets (copies) are one class from the start, so that a text that makes up a third of all rows costs one
row per input split.  A class is known by two independent 64-bit sums; only the first travels with signatures, and sets of equal
first and different second sum are told apart where members meet.  Signatures travel as packed sorted blocks, one per split and
bucket, and never as single rows.  Buckets are of bounded size: where there are more than ``1 << coarse_bits``, a second
exchange splits each coarse bucket, read as a stream, by further bits of the signature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.packing64 import U, mix, pack, ranges, unpack
from tessera.llm.shingles import BITS, shingle_sets, slices
from tessera.operators.components import connected_components
from tessera.staging import bucket_bits, discard, stage

DOC_BITS, KIND_BITS = 18, 3
SIG_BITS = 64 - DOC_BITS - KIND_BITS
#: Bits of a signature that travel.  Those of its bucket come on top, so that unequal signatures of 10**13 entries in 2**15 buckets
#: agree by chance in one of a hundred; a chance agreement costs a comparison and never a link.
SIG_KEPT = 35
#: Kinds of signature entries: whole subset of one shingle, of more, subset lacking one; +3 when taken in the next smaller band.
WHOLE1, WHOLE2, LACKING, LOWER = 0, 1, 2, 3


@dataclass(frozen=True)
class Scheme:
    """Parameters that fix the signatures."""

    threshold: float = 0.8
    width: int = 5
    min_words: int = 5
    first_band: int = 16
    band_ratio: int = 4
    #: Mean of the shingles in a segment of the largest sets of a band, times ``slack``.
    fill: float = 0.6
    cost_limit: int = 64
    most_cost: int = 1 << 12
    #: Shingles of sets without capacity that are compared with all rows in one pass, and passes beyond which it is an error.
    block_shingles: int = 1 << 22
    most_passes: int = 256
    #: Estimated input per bucket of signatures (about two million entries, 100 MB when unpacked), and bits of the first exchange.
    bucket_bytes: int = 1 << 21
    coarse_bits: int = 15

    @property
    def slack(self) -> float:
        return (1 - self.threshold) / (1 + self.threshold)

    def merged(self) -> Scheme:
        """The scheme for sets that this one leaves without capacity: narrow bands of segments as large as one deletion allows."""
        return replace(self, first_band=8, band_ratio=2, fill=0.75)

    @property
    def ratio(self) -> int:
        return max(self.band_ratio, int(1 / self.threshold) + 1)

    def difference(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.floor(self.slack * (a + b) + 1e-9).astype(np.int64)

    def band(self, n: np.ndarray) -> np.ndarray:
        """0 below ``first_band``, where every shingle is a segment of its own."""
        edges = self.first_band * self.ratio ** np.arange(0, 24, dtype=np.float64)
        return np.searchsorted(edges, n, "right")

    def lower_edge(self, band: np.ndarray) -> np.ndarray:
        return np.where(band > 0, self.first_band * float(self.ratio) ** (band - 1.0), 1)

    def segments(self, band: np.ndarray) -> np.ndarray:
        return np.ceil(self.lower_edge(band + 1) * self.slack / self.fill).astype(np.int64) + 1

    def least_size(self, n: np.ndarray) -> np.ndarray:
        """The size a partner of a set of ``n`` must have at least."""
        return np.ceil(self.threshold * n - 1e-9).astype(np.int64)


def class_ids(owner: np.ndarray, token: np.ndarray, salt: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit id for each set within its group, and an independent one to check it by."""
    start = np.searchsorted(owner, np.arange(len(n)))
    total = np.zeros(len(token) + 1, U)
    out = []
    for seed in (U(17), U(0x5851F42D4C957F2D)):
        np.cumsum(mix(token + seed), out=total[1:])
        out.append(mix(total[start + n] - total[start] + mix(salt + seed) + n.astype(U)))
    return out[0], out[1]


def sub_class(cls: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The id of a set whose class id another set took."""
    return mix(cls ^ mix(check))


def signatures(
    owner: np.ndarray, token: np.ndarray, salt: np.ndarray, band: np.ndarray, scheme: Scheme
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, signature, kind)`` of all segments of sets laid out in ``band``, and every set's capacity."""
    kept, value = mix(token), np.zeros(len(token), U)
    small = band[owner] == 0
    count = scheme.segments(band)
    # segments are ranges of the hash, so the sorted shingles of a set already stand segment by segment
    segment = ((token >> U(BITS - 32)) * count[owner].astype(U)) >> U(32)
    new = np.ones(len(token), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1]) | small[1:]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(token)))
    total = np.add.reduceat(kept, start) if len(start) else value
    who = owner[start]
    key = np.where(small[start], U(0), segment[start] * U(0x9E3779B97F4A7C15)) + mix(salt * U(64) + band.astype(U))[who]
    group = np.repeat(np.arange(len(start)), size)
    more = size[group] > 1
    sig = np.concatenate([mix(total + key), mix(total[group[more]] - kept[more] + key[group[more]])])
    kind = np.concatenate([np.where(size > 1, WHOLE2, WHOLE1), np.full(int(more.sum()), LACKING)]).astype(U)
    capacity = np.bincount(who, weights=np.minimum(size, 2), minlength=len(salt)).astype(np.int64)
    return np.concatenate([who, owner[more]]), sig, kind, capacity


def _index_rows(scheme: Scheme, bits: int):
    """Rows ``(id, salt, text, most)`` to packed blocks of signatures (kind 1) and of members (kind 0), in ``1 << bits`` buckets.

    ``most`` is the cost up to which a set looks for partners; below 0 it is only found by others."""

    def flush(docs: list, entries: list) -> pa.RecordBatch:
        ids, cls, check, n, own, low, most = (np.concatenate(x) for x in zip(*docs, strict=True))
        parts, kinds, values = [], [], []

        def add(part: int, kind: int, value: bytes) -> None:
            parts.append(part)
            kinds.append(kind)
            values.append(value)

        for b, o in _by_part(_bucket(cls, bits), 1 << bits):
            add(b, 0, pack(ids[o], cls[o], check[o], n[o], own[o], low[o]))
        sig, place = (np.concatenate(x) for x in zip(*entries, strict=True))
        code = (sig >> U(64 - SIG_KEPT) << U(DOC_BITS + KIND_BITS)) | place
        mask = U(((1 << DOC_BITS) - 1) << KIND_BITS)
        for b, o in _by_part(_bucket(sig, bits), 1 << bits):
            c = code[o]
            used, local = np.unique((c & mask) >> U(KIND_BITS), return_inverse=True)
            c = np.sort((c & ~mask) | (local.astype(U) << U(KIND_BITS)))
            used = used.astype(np.int64)
            add(b, 1, pack(c, cls[used], n[used].astype(np.uint32), most[used], ascending=1))
        return _blocks(parts, kinds, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        entries: list = []
        seen: dict[int, int] = {}
        held = 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy(zero_copy_only=False)
            all_salts = batch.column(1).to_numpy(zero_copy_only=False).view(U)
            all_most = batch.column(3).to_numpy(zero_copy_only=False)
            texts = batch.column(2).to_pylist()
            for lo, hi in slices([len(t) for t in texts]):
                owner, token = shingle_sets(texts[lo:hi], scheme.width, scheme.min_words)
                n = np.bincount(owner, minlength=hi - lo)
                part = np.flatnonzero(n)
                if not len(part):
                    continue
                owner = np.searchsorted(part, owner)
                n, ids, salt = n[part], all_ids[lo:hi][part], mix(all_salts[lo:hi][part])
                band, base = scheme.band(n), sum(len(d[0]) for d in docs)
                cls, check = class_ids(owner, token, salt, n)
                first = np.zeros(len(n), bool)
                for i, c in enumerate(cls.tolist()):
                    if c not in seen:
                        seen[c] = base + i
                        first[i] = True
                who, sig, kind, own = signatures(owner, token, salt, band, scheme)
                keep = first[who]
                low = np.zeros(len(n), np.int64)
                found = [(who[keep], sig[keep], kind[keep])]
                down = (band > 0) & (scheme.least_size(n) < scheme.lower_edge(band))
                if down.any():
                    take = down[owner]
                    w2, s2, k2, c2 = signatures(owner[take], token[take], salt, np.maximum(band - 1, 0), scheme)
                    low[down] = c2[down]
                    keep = first[w2]
                    found.append((w2[keep], s2[keep], k2[keep] + U(LOWER)))
                for w, s, k in found:
                    entries.append((s, ((w + base).astype(U) << U(KIND_BITS)) | k))
                    held += len(w)
                docs.append((ids.astype(np.int64), cls, check, n, own, low, all_most[lo:hi][part]))
                if held > 3_000_000 or base + len(n) > (1 << DOC_BITS) - 4096:
                    yield flush(docs, entries)
                    docs, entries, seen, held = [], [], {}, 0
        if docs:
            yield flush(docs, entries)

    return run


def _bucket(value: np.ndarray, bits: int) -> np.ndarray:
    return (value & U((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.int64)


def _blocks(parts: list, kinds: list, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(values, pa.binary())], ["part", "kind", "block"])


def _finer(bits: int, fine: int, cut):
    """Blocks of coarse buckets, read as a stream, to blocks of ``1 << fine`` buckets each; ``cut(kind, arrays, fine, bits)`` gives
    the arrays of each of them.  Small blocks of a bucket are put together by what reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, kinds, values = [], [], []
            for part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for sub, value in cut(kind, block, fine, bits):
                    parts.append((part << fine) | sub)
                    kinds.append(kind)
                    values.append(value)
            yield _blocks(parts, kinds, values)

    return run


def _cut_index(kind: int, block: bytes, fine: int, bits: int) -> Iterator[tuple[int, bytes]]:
    arrays = unpack(block)
    if kind == 0:  # members only pass through
        yield int(arrays[1][0] >> U(bits)) & ((1 << fine) - 1), block
        return
    code, cls, n, most = arrays
    mask = U(((1 << DOC_BITS) - 1) << KIND_BITS)
    for sub, o in _by_part((code >> U(SIG_KEPT + DOC_BITS + KIND_BITS - fine)).astype(np.int64), 1 << fine):
        used, local = np.unique((code[o] & mask) >> U(KIND_BITS), return_inverse=True)
        used = used.astype(np.int64)
        yield sub, pack(np.sort((code[o] & ~mask) | (local.astype(U) << U(KIND_BITS))), cls[used], n[used], most[used], ascending=1)


def _cut_matched(kind: int, block: bytes, fine: int, bits: int) -> Iterator[tuple[int, bytes]]:
    arrays = unpack(block)
    cls = {0: lambda: arrays[1], 1: lambda: arrays[1][(arrays[0] >> U(33)).astype(np.int64)], 2: lambda: arrays[0]}[kind]()
    for sub, o in _by_part((cls >> U(bits)) & U((1 << fine) - 1), 1 << fine):
        if kind == 1:
            yield sub, pack(arrays[0][o], arrays[1], arrays[2], arrays[3][o], ascending=1)
        else:
            yield sub, pack(*[a[o] for a in arrays])


def _exchanged(blocks: DataFrame, bits: tuple[int, int], cut):
    coarse, fine = bits
    return (blocks.repartition("part").mapInArrow(_finer(coarse, fine, cut), BLOCKS) if fine else blocks).groupBy("part")


BLOCKS = "part int, kind int, block binary"


def _match_bucket(scheme: Scheme, bits: tuple[int, int]):
    """The blocks of a bucket to packed pairs that agree and to the capacity that allocation took away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tables, base = [], [], 0
        for batch in batches:
            for part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    yield _blocks([part >> bits[1]], [0], [block])
                    continue
                code, cls, n, most = unpack(block)
                doc = (code >> U(KIND_BITS)) & U((1 << DOC_BITS) - 1)
                codes.append((code >> U(DOC_BITS + KIND_BITS), doc.astype(np.int64) + base, (code & U(7)).astype(np.int8)))
                tables.append((cls, n, most))
                base += len(cls)
        if codes:
            sig, doc, kind = (np.concatenate(x) for x in zip(*codes, strict=True))
            cls, n, most = (np.concatenate(x) for x in zip(*tables, strict=True))
            del codes, tables
            for part, kind, block in _match(sig, doc, kind, cls, n.astype(np.int64), most, scheme, bits[0]):
                yield _blocks([part], [kind], [block])

    return run


#: Pairs that a task holds before it packs them.
PAIRS_HELD = 1 << 22


def _match(sig, doc, kind, cls, n, most, scheme: Scheme, bits: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(sig)
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    order, sig = order[shared], sig[shared]
    doc, kind = doc[order], kind[order]
    # rank: classes by size, then id; a class from several splits gets one rank
    rank_order = np.lexsort((cls, n))
    c, m = cls[rank_order], n[rank_order]
    fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (m[1:] != m[:-1])))[: len(c)]
    rank = np.empty(len(c), np.int64)
    rank[rank_order] = np.cumsum(fresh) - 1
    cls, n, most = c[fresh], m[fresh], np.maximum.reduceat(most[rank_order], np.flatnonzero(fresh))
    rank = rank[doc]
    run = np.cumsum(np.concatenate(([True], sig[1:] != sig[:-1]))[: len(sig)]) - 1
    # equal sets from several splits have the same entries
    code = np.unique((run.astype(U) << U(35)) | (rank.astype(U) << U(3)) | kind.astype(U))
    run, rank, kind = (code >> U(35)).astype(np.int64), ((code >> U(3)) & U(0xFFFFFFFF)).astype(np.int64), (code & U(7)).astype(np.int8)
    key = (run << 32) | rank
    least = np.searchsorted(n, scheme.least_size(n))
    whole, lacking = key[kind < LACKING], key[kind == LACKING]
    looks = most[rank] >= 0

    def span(entries: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, k = run[entries], rank[entries]
        return np.searchsorted(index, (r << 32) | least[k]), np.searchsorted(index, (r << 32) | k)

    def packed() -> Iterator[tuple[int, int, bytes]]:
        value, weight = _summed([x[0] for x in pairs], [x[1] for x in pairs])
        r, s, low = value >> 32, (value & 0xFFFFFFFF) >> 1, value & 1
        for b, o in _by_part(_bucket(cls[r], bits), 1 << bits):
            used, local = np.unique(np.concatenate([r[o], s[o]]), return_inverse=True)
            a, z = local[: len(o)].astype(U), local[len(o) :].astype(U)
            yield b, 1, pack((a << U(33)) | (z << U(1)) | low[o].astype(U), cls[used], n[used], weight[o].astype(np.uint32), ascending=1)

    pairs, skipped, held = [], [], 0
    for lower in (0, LOWER):
        one, two, less = (np.flatnonzero((kind == lower + x) & looks) for x in (WHOLE1, WHOLE2, LACKING))
        for entries, indexes, weight in ((one, [whole], 1), (two, [whole, lacking], 2), (less, [whole], 2)):
            spans = [(index, *span(entries, index)) for index in indexes]
            cost = sum(hi - lo for _, lo, hi in spans)
            dear = cost > most[rank[entries]]
            loss = 1 if entries is less else weight
            level = np.ceil(np.log2(cost[dear] + 1)).astype(np.int64)  # the power of two that would not be below the cost
            skipped.append(((rank[entries[dear]] << 7) | (level << 1) | (lower > 0), np.full(len(level), loss)))
            for index, lo, hi in spans:
                take = np.where(dear, 0, hi - lo)
                total = np.cumsum(take)
                cuts = np.searchsorted(total, np.arange(PAIRS_HELD, total[-1] if len(total) else 0, PAIRS_HELD), "right")
                for x in np.split(np.arange(len(entries)), cuts):
                    owner, at = ranges(lo[x], lo[x] + take[x])
                    pairs.append(((rank[entries[x[owner]]] << 32) | ((index[at] & 0xFFFFFFFF) << 1) | (lower > 0), np.full(len(at), weight, np.int64)))
                    held += len(at)
                    if held >= PAIRS_HELD:
                        yield from packed()
                        pairs, held = [], 0
    if pairs:
        yield from packed()
    value, weight = _summed([x[0] for x in skipped], [x[1] for x in skipped])
    for b, o in _by_part(_bucket(cls[value >> 7], bits), 1 << bits):
        yield b, 2, pack(cls[value[o] >> 7], (value[o] & 127).astype(np.int8), weight[o])


def _summed(values: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value, weight = np.concatenate(values), np.concatenate(weights)
    order = np.argsort(value, kind="stable")
    value, weight = value[order], weight[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))[: len(value)])
    return value[start], np.add.reduceat(weight, start) if len(start) else weight


def _pairs_summed(found: list) -> tuple[np.ndarray, ...]:
    """``(class, partner, role, partner's size, weight)``, each pair and role once."""
    a, c, role, m, w = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((role, c, a))
    a, c, role, m, w = a[order], c[order], role[order], m[order], w[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (role[1:] != role[:-1])))[: len(a)])
    return a[start], c[start], role[start], m[start], np.add.reduceat(w, start) if len(start) else w


def _by_part(part: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part's elements, by part."""
    order = np.argsort(part, kind="stable")
    count = np.bincount(part.astype(np.int64), minlength=buckets)
    cut = np.append(0, np.cumsum(count))
    for b in np.flatnonzero(count):
        yield int(b), order[cut[b] : cut[b + 1]]


def _decide(scheme: Scheme, with_members: bool):
    """``(kind, a, b, c)``: members with their class (kind 0), pairs of classes with enough agreement (1), classes without capacity, their
    size and the least level (cost up to ``2**level``) that would leave some, or -1 (2), and sets whose class id another set
    took: class id, second sum, own id (3).  The latter have no capacity."""

    def run(table: pa.Table) -> pa.Table:
        kinds, blocks = table["kind"].to_numpy(), table["block"].to_pylist()
        take = {k: (unpack(blocks[i]) for i in np.flatnonzero(kinds == k)) for k in (0, 1, 2)}
        ids, member, check, size, own, low = (np.concatenate(x) for x in zip(*take[0], strict=True))
        cls, first, of = np.unique(member, return_index=True, return_inverse=True)
        taken = check != check[first][of]
        n = size[first]
        full = np.stack([own[first], low[first]], 1)
        capacity, dear = full.copy(), []
        for c, role, loss in take[2]:
            at = np.searchsorted(cls, c)
            np.subtract.at(capacity, (at, role & 1), loss)
            dear.append((at, role & 1, role >> 1, loss))
        band = scheme.band(n)
        edge = scheme.lower_edge(band)
        down = (band > 0) & (scheme.least_size(n) < edge)
        need = np.stack([scheme.difference(n, n), np.where(down, scheme.difference(n, edge - 1), -1)], 1)
        bad = ((capacity <= need) & (need >= 0)).any(1)
        # what is lost at each level, for sets without capacity
        level = np.full(len(cls), -1)
        sick = np.flatnonzero(bad)
        lost = np.zeros((len(sick), 2, 64), np.int64)
        for at, role, step, loss in dear:
            hit = bad[at]
            np.add.at(lost, (np.searchsorted(sick, at[hit]), role[hit], step[hit]), loss[hit])
        above = lost.sum(2, keepdims=True) - np.cumsum(lost, 2)
        enough = ((full[sick][:, :, None] - above > need[sick][:, :, None]) | (need[sick] < 0)[:, :, None]).all(1)
        level[sick] = np.where(enough.any(1), enough.argmax(1), -1)
        bad[of[taken]] = True
        level[of[taken]] = -1
        r, s = np.zeros(0, U), np.zeros(0, U)
        found: list = []
        held = 0
        for code, c, m, w in take[1]:
            a, z = (code >> U(33)).astype(np.int64), ((code >> U(1)) & U(0xFFFFFFFF)).astype(np.int64)
            found.append((np.searchsorted(cls, c[a]), c[z], (code & U(1)).astype(np.int64), m[z], w.astype(np.int64)))
            held += len(a)
            if held > 2 * PAIRS_HELD:
                found = [_pairs_summed(found)]
                held = len(found[0][0])
        if found:
            a, c, role, m, w = _pairs_summed(found)
            enough = (w >= capacity[a, role] - scheme.difference(n[a], m)) & ~bad[a]
            r, s = cls[a[enough]], c[enough]
        own_id = np.where(taken, sub_class(member, check), member)
        lost, at = np.unique(own_id[taken], return_index=True)
        at = np.flatnonzero(taken)[at]
        rows = [
            (0, ids, own_id, ids) if with_members else (0, ids[:0], ids[:0], ids[:0]),
            (1, r, s, r),
            (2, np.append(cls[bad], lost), np.append(n[bad], size[at]), np.append(level[bad], np.full(len(lost), -1))),
            (3, member[at], check[at], lost),
        ]
        kind = np.concatenate([np.full(len(a), k, np.int8) for k, a, _, _ in rows])
        a, b, c = (np.concatenate([x[k].view(np.int64) for x in rows]) for k in (1, 2, 3))
        return pa.table({"kind": kind, "a": a, "b": b, "c": pa.array(c, mask=kind < 2)})

    return run


def _sets_of(scheme: Scheme, wanted: np.ndarray | None):
    """``(id, sorted shingles)`` of the rows whose id is in the filter ``wanted``, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.arange(len(ids)) if wanted is None else np.flatnonzero(_in_filter(wanted, ids))
            texts = batch.column(2).take(pa.array(hit)).to_pylist()
            for lo, hi in slices([len(t) for t in texts]):
                owner, token = shingle_sets(texts[lo:hi], scheme.width, scheme.min_words)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                sets = [token[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit[lo:hi]]), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                a, b = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both / (len(a) + len(b) - both) >= threshold
            yield batch.select(["src", "dst"]).filter(pa.array(keep))

    return run


def _against_all(scheme: Scheme, query: tuple[np.ndarray, ...]):
    """``(src, chk, dst)``: links of all rows with a bounded block of query sets: ``(id, class sums, salted shingle, owner)``, sorted by
    shingle.  ``src`` and ``chk`` are the two sums of a row's set, ``dst`` is a query's class."""
    q_id, q_cls, q_check, q_key, q_owner = query
    q_size = np.bincount(q_owner, minlength=len(q_cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = batch.column(1).to_numpy(zero_copy_only=False).view(U)
            texts = batch.column(2).to_pylist()
            for lo, hi in slices([len(t) for t in texts], most_texts=256):
                owner, token = shingle_sets(texts[lo:hi], scheme.width, scheme.min_words)
                n = np.bincount(owner, minlength=hi - lo)
                salt = mix(salts[lo:hi])
                cls, check = class_ids(owner, token, salt, n)
                key = mix(token + salt[owner])
                of, at = ranges(np.searchsorted(q_key, key), np.searchsorted(q_key, key, "right"))
                code, both = np.unique(owner[of] * len(q_cls) + q_owner[at], return_counts=True)
                mine, other = code // len(q_cls), code % len(q_cls)
                itself = (cls[mine] == q_cls[other]) & (check[mine] == q_check[other])
                good = (both / (n[mine] + q_size[other] - both) >= scheme.threshold) & ~itself
                columns = cls[mine[good]], check[mine[good]], q_id[other[good]]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], ["src", "chk", "dst"])

    return run


#: The filter that says which rows' sets are needed takes 10 bits an id and this many at most (16 MiB); beyond, ids are joined.
FILTER_BITS = 1 << 27
_WORDS = 1 << 10


def _in_filter(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = mix(ids.view(U)) % U(len(words) * 64)
    return ((words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).astype(bool)


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """The filter over a column of ids.  Tasks send blocks of words, which are put together by block: the driver gets each once."""
    blocks = -(-bits // (64 * _WORDS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(blocks * _WORDS, U)
        for batch in batches:
            at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(U)) % U(len(words) * 64)
            np.bitwise_or.at(words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        used = np.flatnonzero(words.reshape(blocks, _WORDS).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([words[b * _WORDS : (b + 1) * _WORDS].tobytes() for b in used], pa.binary())], ["block", "words"])

    def combine(table: pa.Table) -> pa.Table:
        words = np.bitwise_or.reduce([np.frombuffer(w, U) for w in table["words"].to_pylist()])
        return pa.table({"block": table["block"].slice(0, 1), "words": pa.array([words.tobytes()], pa.binary())})

    out = np.zeros((blocks, _WORDS), U)
    for block, words in ids.mapInArrow(build, "block int, words binary").groupBy("block").applyInArrow(combine, "block int, words binary").collect():
        out[block] = np.frombuffer(words, U)
    return out.reshape(-1)


def _sets(rows: DataFrame, ids: DataFrame, scheme: Scheme) -> DataFrame:
    """``(id, shingles)`` of the rows whose ``id`` is among ``ids`` (and of few others): no other text is cut into shingles."""
    bits = 10 * ids.count()
    if bits <= FILTER_BITS:
        wanted = _filter(ids, max(bits, 1))
    else:
        rows, wanted = rows.join(ids.distinct(), "id", "left_semi"), None
    return rows.select("id", "salt", "text").mapInArrow(_sets_of(scheme, wanted), "id bigint, shingles binary")


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: ``(id, class)``, one row per text that takes part; ``links``: ``(src, dst)`` between classes, each once;
    ``components``: ``(class, component)`` of the classes that have links; ``merged`` and ``compared``: how many classes were
    allocated over merged segments, and how many of them were compared with all sets."""

    members: DataFrame
    links: DataFrame
    components: DataFrame
    merged: int = 0
    compared: int = 0

    def grouped(self) -> DataFrame:
        """``(id, class, component, links)``: one row per text that takes part; ``links`` counts linked classes."""
        degree = self.links.select("src").unionAll(self.links.select(F.col("dst").alias("src"))).groupBy(F.col("src").alias("class")).agg(F.count("*").alias("links"))
        return (
            self.members.join(self.components, "class", "left")
            .join(degree, "class", "left")
            .select("id", "class", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
        )

    def pairs(self) -> DataFrame:
        """``(id_a, id_b)`` with ``id_a < id_b`` for all texts of one component, copies included."""
        linked = self.components.select("class", "component")
        copied = self.members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        rows = stage(
            self.members.join(linked.unionByName(copied.join(linked, "class", "left_anti").withColumn("component", F.col("class"))), "class").select("id", "component"), "nd-rows"
        )
        return rows.alias("x").join(rows.alias("y"), (F.col("x.component") == F.col("y.component")) & (F.col("x.id") < F.col("y.id"))).select(
            F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")
        )


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    group_col: str | None = None,
    scheme: Scheme | None = None,
) -> NearDuplicates:
    """Group the texts of ``df`` (see the module's description); only texts of equal ``group_col`` are compared.

    ``id_col`` is an integer column.  Rows with a null id or text, and texts of fewer than ``min_words`` words (empty and blank
    ones among them), take no part.  A null group is a group of its own (coalesce it before to merge it with another).  Equal
    texts are one class; repeated ids stand for repeated rows and are kept.  Other columns of ``df`` are not read, whatever
    their names.  An empty table gives empty results.
    """
    scheme = scheme or Scheme()
    group = F.lit(0).cast("bigint") if group_col is None else F.when(F.col(group_col).isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(F.col(group_col)))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), group.alias("salt"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    bits = bucket_bits(rows, F.octet_length("text"), scheme.bucket_bytes, scheme.coarse_bits)
    decided = _allocated(rows, scheme, bits, None)
    members = decided.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("class"))
    chosen = decided.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    bad, taken = (decided.where(f"kind = {k}") for k in (2, 3))
    bad = bad.select(F.col("a").alias("class"), F.col("b").alias("size"), F.col("c").alias("level"))
    passes: list[DataFrame] = []
    n_merged = n_left = bad.count()
    merged = scheme.merged()
    # over merged segments: first within the common limit, then each set within the limit that its costs ask for
    own_cost = F.when(F.col("level") >= 0, F.pow(F.lit(2.0), F.least("level", F.lit(30))).cast("int"))
    for most in (F.lit(scheme.cost_limit), own_cost):
        if not n_left:
            break
        asking = stage(bad.withColumn("most", most).where(F.col("most") <= max(scheme.most_cost, scheme.cost_limit)), "nd-asking")
        of = stage(members.join(asking, "class").groupBy("id").agg(F.max("most").alias("most")), "nd-asking")
        again = _allocated(rows, merged, bits, of)
        # a class is the greater end of the pairs it was allocated for
        chosen = chosen.unionAll(again.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")).join(asking.select(F.col("class").alias("src")), "src", "left_semi"))
        left = again.where("kind = 2").select(F.col("a").alias("class"), F.col("c").alias("level"))
        silent = bad.join(asking, "class", "left_anti").select("class", "size", "level")
        bad = stage(asking.select("class", "size").join(left, "class").select("class", "size", "level").unionAll(silent), "nd-left")
        passes += [asking, of, again, bad]
        n_left = bad.count()

    deputy = members.groupBy("class").agg(F.min("id").alias("id"))
    chosen = chosen.where("src <> dst").distinct()
    chosen = stage(
        chosen.join(deputy.select(F.col("class").alias("src"), F.col("id").alias("i")), "src").join(deputy.select(F.col("class").alias("dst"), F.col("id").alias("j")), "dst").select("src", "dst", "i", "j"),
        "nd-pairs",
    )
    sets = _sets(rows, chosen.select(F.col("i").alias("id")).unionAll(chosen.select("j")).distinct(), scheme)
    one = sets.select(F.col("id").alias("i"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("j"), F.col("shingles").alias("y"))
    links = chosen.join(one, "i").join(two, "j").select("src", "dst", "x", "y").mapInArrow(_verified(scheme.threshold), "src bigint, dst bigint")
    if n_left:
        links = links.unionAll(_rest(rows, bad, taken, deputy, scheme))
    links = stage(links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "nd-links")
    discard(chosen, *passes)
    components = stage(connected_components(links), "nd-components").select(F.col("node").alias("class"), "component")
    return NearDuplicates(members, links, components, n_merged, n_left)


def _allocated(rows: DataFrame, scheme: Scheme, bits: tuple[int, int], asked: DataFrame | None) -> DataFrame:
    """What :func:`_decide` says under a scheme, staged: of all rows, or, without members, of those ``asked`` ``(id, most)`` for partners."""
    if asked is None:
        looking = rows.withColumn("most", F.lit(scheme.cost_limit))
    else:
        looking = rows.join(asked, "id", "left").select("id", "salt", "text", F.coalesce("most", F.lit(-1)).alias("most"))
    index = looking.mapInArrow(_index_rows(scheme, bits[0]), BLOCKS)
    matched = _exchanged(index, bits, _cut_index).applyInArrow(_match_bucket(scheme, bits), BLOCKS)
    return stage(_exchanged(matched, bits, _cut_matched).applyInArrow(_decide(scheme, asked is None), "kind tinyint, a bigint, b bigint, c bigint"), "nd-decided")


def _rest(rows: DataFrame, bad: DataFrame, taken: DataFrame, deputy: DataFrame, scheme: Scheme) -> DataFrame:
    """The links of sets without capacity, each block of them against all rows."""
    bad = stage(bad.select("class", "size").distinct().join(deputy, "class"), "nd-rest")
    blocks = 1 + int(bad.agg(F.sum("size")).first()[0] or 0) // scheme.block_shingles
    if blocks > scheme.most_passes:
        raise RuntimeError(f"{bad.count()} sets share each of their signatures with more than {scheme.cost_limit} others; comparing them with all rows takes {blocks} passes: raise cost_limit or most_passes")
    out = rows.sparkSession.createDataFrame([], "src bigint, chk bigint, dst bigint")
    for block in range(blocks):
        part = bad.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == block)
        sets = _sets(rows, part.select("id"), scheme)
        # a block holds about block_shingles hashes, whatever the size of the table
        found = part.join(sets, "id").join(rows.select("id", "salt"), "id").select("class", "salt", "shingles").dropDuplicates(["class"]).collect()
        if not found:
            continue
        token = [np.frombuffer(r.shingles, U) for r in found]
        salt = mix(np.array([r.salt for r in found], np.int64).view(U))
        owner = np.repeat(np.arange(len(found)), [len(t) for t in token])
        token = np.concatenate(token)
        cls, check = class_ids(owner, token, salt, np.bincount(owner, minlength=len(found)))
        key = mix(token + salt[owner])
        order = np.argsort(key)
        query = np.array([r["class"] for r in found], np.int64).view(U), cls, check, key[order], owner[order]
        out = out.unionAll(stage(rows.mapInArrow(_against_all(scheme, query), "src bigint, chk bigint, dst bigint"), "nd-rest"))
    own = taken.select(F.col("a").alias("src"), F.col("b").alias("chk"), F.col("c").alias("own")).distinct()
    return out.join(own, ["src", "chk"], "left").select(F.coalesce("own", "src").alias("src"), "dst").where("src <> dst")
