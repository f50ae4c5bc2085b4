"""Suffix-array deduplication of byte strings.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts anywhere else.

1. Anchors. In every window of LENGTH bytes the smallest hash of its ``GRAM``-byte substrings marks an anchor,
   so equal windows hold equal anchors at equal places. About 0.6 % of the bytes are anchors. A window belongs to its
   leftmost anchor of the smallest hash. It reaches ``LENGTH - GRAM`` bytes beyond that, so at least half of it on one
   side: each anchor has up to two *pieces* of text, one whose windows all hold the next bytes on the right, one
   whose windows all hold those on the left. A piece's key is a hash of what its windows hold in common, so only
   pieces of one key can share a window, and each window is in one piece.
2. Keys meet in buckets. Each chunk of input sends an entry once, however often it holds it; where it holds it several
   times, the places travel beside, never to one bucket. Keys held once are done with.
3. The text of each piece that no other equals is fetched, and of two pieces of each class of several equal ones, by a
   shuffle of texts and places by id.
4. Suffix arrays. The pieces of whole keys are joined to blocks and sorted by two-stage suffix sorting: only
   suffixes smaller than their successors are sorted directly; one scan over the buckets of first bytes, in
   rising order, induces the others. Neighbours whose first LENGTH bytes agree, byte by byte, are repeats. Nothing else
   is removed: where pieces are equal, the two that stand for their class are neighbours in the array.
5. A key with more than ``GROUP_PIECES`` different pieces is cut: a piece into parts of fewer windows, which hold more
   in common and so have finer keys, and which coincide more often. At one window each part is its key, so
   blocks stay bounded whatever one key holds.
6. Repeats go back from classes to all their places and become maximal spans of documents, which are cut out.

Scale: an entry costs about 25 bytes in one shuffle; texts of documents with shared keys are shuffled once, pieces of
different content twice at most. Nothing is broadcast but spans (checked, else a shuffle). Two pieces of a class are compared by
their bytes; that further copies are like these is told by 128 bits of hashes (key and content), and the fetched bytes must have those hashes.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep all; equal texts of LENGTH
bytes lose all, in every copy, and so do repeated rows; a row without id takes no part and keeps all; where
texts differ under one id the spans of both apply to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import append_columns, cut, map_batches
from ._blobs import pack, pack_ids, unpack, unpack_ids
from ._hashing import groups, mix, powers, prefix_sums
from ._spans import buckets_for, merged_spans, with_spans

LENGTH, GRAM = 400, 64
CHUNK_BYTES = 24 << 20
#: Text in one suffix array; keys are not cut by it.
BLOCK_BYTES = 1 << 20
#: Different pieces of one key that are sorted together.
GROUP_PIECES = 4096
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALT = np.uint64(0x510E527FADE682D1)
_MANY = np.uint64(0x9B05688C2B3E6C1F)


def _slide(values: np.ndarray, w: int, smallest: bool) -> np.ndarray:
    """Minimum (or maximum) of each w consecutive values: running ones over blocks of w, from both ends."""
    pick = np.minimum if smallest else np.maximum
    n = len(values)
    filler = _TOP if smallest else np.uint64(0)
    blocks = np.concatenate([values, np.full(-n % w, filler, dtype=np.uint64)]).reshape(-1, w)
    forward = pick.accumulate(blocks, axis=1).reshape(-1)
    backward = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(backward[: n - w + 1], forward[w - 1 : n])


class Anchors:
    """The anchors of a group of texts: text number, place in the text, hash, and sizes and hashes of both sides."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.data, self.starts, self.ends, self.length, self.gram = data, starts, ends, length, gram
        self.sums, self.inverse = prefix_sums(data), powers(len(data) + 1)[1]
        n, w = len(data), length - gram + 1
        self.at = np.zeros(0, dtype=np.int64)
        if n >= length:
            h = mix((self.sums[gram:] - self.sums[:-gram]) * self.inverse[: n - gram + 1])
            smallest = _slide(h, w, True)
            valid = np.zeros(n + 1, dtype=np.int32)  # places where a window of one text starts
            long = sizes >= length
            np.add.at(valid, starts[long], 1)
            np.add.at(valid, ends[long] - length + 1, -1)
            smallest[np.cumsum(valid[: len(smallest)]) == 0] = 0
            pad = np.zeros(w - 1, dtype=np.uint64)
            self.at = np.flatnonzero(_slide(np.concatenate([pad, smallest, pad]), w, False) == h)
            self.hash = h[self.at]
        else:
            self.hash = np.zeros(0, dtype=np.uint64)
        self.text = np.searchsorted(starts, self.at, side="right") - 1
        while len(self.at) and (empty := self.at >= ends[self.text]).any():  # empty texts share a start
            self.text[empty] -= 1

    def reaches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the least and the most that its own windows reach to its left; most < least for none.

        A window is its leftmost smallest anchor's own. So an anchor before, of no larger hash, and one after, of a
        smaller hash, bound the windows of an anchor.
        """
        reach, n = self.length - self.gram, len(self.at)
        least = np.maximum(0, self.at + self.length - self.ends[self.text])
        most = np.minimum(reach, self.at - self.starts[self.text])
        for side, step in ((-1, -1), (1, 1)):
            todo, other = np.arange(n), np.arange(n) + step
            while len(todo):
                inside = (other >= 0) & (other < n)
                todo, other = todo[inside], other[inside]
                far = np.abs(self.at[other] - self.at[todo])
                near = far <= reach
                todo, other, far = todo[near], other[near], far[near]
                beats = self.hash[other] <= self.hash[todo] if side < 0 else self.hash[other] < self.hash[todo]
                if side < 0:
                    most[todo[beats]] = np.minimum(most[todo[beats]], far[beats] - 1)
                else:
                    least[todo[beats]] = np.maximum(least[todo[beats]], reach + 1 - far[beats])
                todo, other = todo[~beats], other[~beats] + step
        return least, most

    def pieces(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Both kinds of pieces: bytes that all windows hold to the left of the anchor; number of the anchor, key, content hash, bounds in the data."""
        reach = self.length - self.gram
        slack = (reach + 1) // 2
        least, most = self.reaches()
        for left, last in ((0, slack), (slack + 1, reach)):  # how far windows reach to the left
            low, high = np.maximum(least, left), np.minimum(most, last)
            fit = np.flatnonzero(low <= high)
            at, low, high = self.at[fit], self.at[fit] - high[fit], self.at[fit] - low[fit] + self.length
            key = mix(mix(self.hash[fit] + self.of(at - left, at)) + self.of(at + self.gram, at + self.length - last) + np.uint64(left))
            yield left, fit, key, piece_hash(self.of(low, at), self.of(at, high)), low, high

    @staticmethod
    def ranges(data: np.ndarray):
        """A function of bounds: hashes of byte ranges, sizes included."""
        sums, inverse = prefix_sums(data), powers(len(data) + 1)[1]

        def of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64) * _SALT)

        return of

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, sizes included."""
        return mix((self.sums[high] - self.sums[low]) * self.inverse[low] + (high - low).astype(np.uint64) * _SALT)


def piece_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Content hash of pieces from those of their bytes before the anchor and from it on."""
    return mix(left * _MANY + right)


def two_stage(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of bytes, in order of the first ``depth`` bytes at least. A last byte counts as larger than its successor.

    ``wanted`` marks the suffixes to sort (default: all); those between a wanted one and the next smaller than its
    successor are sorted too, as it is induced from them.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # smaller than its successor: the next different byte is larger
    change = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.concatenate([change, [n - 1]])
    rises = np.concatenate([text[change + 1] > text[change], [False]])
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], run_end])))
    if wanted is None:
        needed = np.ones(n, dtype=bool)
    else:  # a larger one needs its successor, and so on up to one that is sorted directly
        last = np.maximum.accumulate(np.where(wanted, np.arange(n), -1))  # the nearest wanted one at or before
        stop = np.maximum.accumulate(np.where(smaller, np.arange(n), -1))  # the nearest direct one at or before
        before = np.concatenate([[-1], stop[:-1]])
        needed = wanted | ((last >= 0) & (last > before))
    small = smaller & needed
    first = np.bincount(text[needed], minlength=256)
    heads = np.cumsum(first) - first  # of the buckets
    small_count = np.bincount(text[small], minlength=256)
    out = np.full(int(first.sum()), -1, dtype=np.int64)
    # larger ones come before smaller ones in a bucket: larger(c..) has a smaller byte after its run
    direct = _sort_directly(text, np.flatnonzero(small), depth)
    start = 0
    tails = heads + first
    for c in range(256):
        out[tails[c] - small_count[c] : tails[c]] = direct[start : start + small_count[c]]
        start += small_count[c]
    # induce: scanning buckets upwards, the predecessor of a suffix, if larger than it, is next in its own bucket
    fill = heads.copy()
    induced = needed & ~smaller

    def place(of: np.ndarray) -> None:
        before = of[of > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return
        c = text[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        bounds = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1], [True]]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            k = int(c[a])
            out[fill[k] : fill[k] + b - a] = before[a:b]
            fill[k] += b - a

    place(np.array([n]))  # the empty suffix is the smallest
    for c in range(256):
        done = heads[c]
        while done < fill[c]:  # runs of c put more into this bucket while it is read
            now = fill[c]
            place(out[done:now])
            done = now
        place(out[tails[c] - small_count[c] : tails[c]])
    return out


def _sort_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first ``depth`` bytes. Those that agree in all of them stand together, so one of each is sorted."""
    if not len(at):
        return at
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    sums, inverse = prefix_sums(padded), powers(len(padded) + 1)[1]
    _, first, which = np.unique((sums[at + depth] - sums[at]) * inverse[at], return_index=True, return_inverse=True)
    one = at[first]
    rank = np.empty(len(text), dtype=np.int64)
    rank[_sort_different(text, padded, one, depth)] = np.arange(len(one))
    return at[np.argsort(rank[one][which], kind="stable")]


def _sort_different(text: np.ndarray, padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Sort different suffixes by 8 bytes, then each group still equal around its first member.

    Where a member parts from that one is found by bisection over rolling sums; on either side members stand by
    how long they agree with it and by the next 8 bytes, so long common passages cost no more rounds than short ones.
    """
    sums, inverse = prefix_sums(padded), powers(len(padded) + 1)[1]
    words = np.zeros(len(padded) - 8, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | padded[i : i + len(words)].astype(np.uint64)
    order = at[np.argsort(words[at], kind="stable")]
    w = words[order]
    group = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])])
    known = np.full(len(order), 8, dtype=np.int64)
    place = np.arange(len(order))  # of what is still open in the final order
    out = order.copy()
    while True:
        alone = np.bincount(group)[group] == 1
        out[place[alone]] = order[alone]
        order, group, known, place = order[~alone], group[~alone], known[~alone], place[~alone]
        if not len(order):
            return out
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.repeat(order[head], np.diff(head, append=len(order)))
        agree = known.copy()
        long = np.flatnonzero((words[order + known] == words[first + known]) & (order != first))
        if len(long):
            e, f, low, high = order[long], first[long], known[long], np.full(len(long), depth, dtype=np.int64)
            se, sf, ie, jf = sums[e], sums[f], inverse[e], inverse[f]
            while True:  # low bytes agree, high bytes do not
                mid = (low + high + 1) >> 1
                same = (sums[e + mid] - se) * ie == (sums[f + mid] - sf) * jf
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
                if (low >= high).all():
                    break
            agree[long] = low
        w, other = words[order + agree], words[first + agree]
        side = np.where(order == first, depth + 1, np.where(w < other, agree, 2 * depth + 2 - agree))
        by = np.lexsort((w, side, group))
        order, w, side, agree, old = order[by], w[by], side[by], agree[by], group[by]
        fresh = (old[1:] != old[:-1]) | (side[1:] != side[:-1]) | (w[1:] != w[:-1])
        group = np.concatenate([[0], np.cumsum(fresh)])
        known = np.minimum(agree + 8, depth)


def common_prefixes(text: np.ndarray, array: np.ndarray, length: int) -> np.ndarray:
    """For neighbours in the suffix array: whether their first ``length`` bytes agree, by their bytes.

    Neighbours at one distance in the text that follow each other share most of their bytes: the bytes of all
    such pairs are compared once, and a pair agrees if no difference lies in its stretch.
    """
    same = np.zeros(len(array) - 1, dtype=bool)
    i = np.flatnonzero(np.maximum(array[1:], array[:-1]) + length <= len(text))
    if not len(i):
        return same
    sums, inverse = prefix_sums(text), powers(len(text) + 1)[1]
    a, b = array[i], array[i + 1]
    likely = (sums[a + length] - sums[a]) * inverse[a] == (sums[b + length] - sums[b]) * inverse[b]
    i = i[likely]
    a, b = np.minimum(array[i], array[i + 1]), np.maximum(array[i], array[i + 1])
    if not len(i):
        return same
    far = b - a
    order = np.lexsort((a, far))
    a, far = a[order], far[order]
    apart = np.concatenate([[True], (far[1:] != far[:-1]) | (a[1:] > a[:-1] + length)])
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(a)) - 1
    size = a[last] + length - a[first]
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(a[first] - begin, size)
    wrong = np.concatenate([[0], np.cumsum(text[at] != text[at + np.repeat(far[first], size)])])
    run = np.cumsum(apart) - 1
    start = begin[run] + a - a[first[run]]
    same[i[order]] = wrong[start + length] == wrong[start]
    return same


def repeated_starts(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece number and place in it of each ``length``-byte string that starts twice or more."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    wanted = np.zeros(len(text) + 1, dtype=np.int32)  # starts of windows
    long = sizes >= length
    np.add.at(wanted, starts[long], 1)
    np.add.at(wanted, ends[long] - length + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    array = two_stage(text, length, wanted)
    array = array[wanted[array]]
    if not len(array):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    group = np.concatenate([[0], np.cumsum(~common_prefixes(text, array, length))])
    array = np.sort(array[(np.bincount(group) > 1)[group]])
    piece = piece_of[array]
    return piece, array - starts[piece]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return ((i, t or b"") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) if i is not None)


SENT = "bucket long, key long, content long, payload binary"


def _send(buckets: int, length: int, gram: int):
    """A chunk's entries, packed for each bucket, and the places (payload: ids, offsets) of entries that it holds several times (bucket -1).

    An entry held several times counts as two and goes with a second place, that counts as none.
    """
    names, kinds = ["bucket", "key", "content", "payload"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def flush(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, content, doc, low, at, size, left = (np.concatenate(x) for x in zip(*found))
        bucket = (mix(key ^ _SALT) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((content, key, bucket))
        key, content, doc, low, at, size, left, bucket = (x[order] for x in (key, content, doc, low, at, size, left, bucket))
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
        n = np.diff(heads, append=len(key))
        rows: list[tuple] = []
        for h in np.flatnonzero(n > 1):
            a, b = heads[h], heads[h] + n[h]
            rows.append((-1, int(key[a].view(np.int64)), int(content[a].view(np.int64)), pack(pack_ids(doc[a:b]), low[a:b])))
        sent = np.concatenate([heads, heads[n > 1] + 1])
        count = np.concatenate([np.minimum(n, 2), np.zeros(len(sent) - len(heads), dtype=n.dtype)])
        order = np.argsort(sent)
        sent, count = sent[order], count[order]
        bounds = np.searchsorted(bucket[sent], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(bounds)):
            o = slice(bounds[b], bounds[b + 1])
            own = sent[o]
            rows.append((int(b), None, None, pack(key[own], content[own], count[o], pack_ids(doc[own]), low[own], at[own], size[own], left[own])))
        for a in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 256]), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for group in groups(_rows(batches)):
            a = Anchors([t for _, t in group], length, gram)
            ids = np.array([i for i, _ in group], dtype=np.int64)
            for left, anchor, key, content, low, high in a.pieces():
                if len(anchor):
                    text = a.text[anchor]
                    found.append((key, content, ids[text], low - a.starts[text], a.at[anchor] - low, high - low, np.full(len(anchor), left)))
            size += len(a.data)
            if size > CHUNK_BYTES and found:
                yield from flush(found)
                found, size = [], 0
        if found:
            yield from flush(found)

    return run


MET = "role int, key long, content long, doc_id long, low long, at int, size int, left int, payload binary"
CLASS, PLACE, PLACES = 0, 1, 2


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a bucket, of keys held twice or more: two rows for each class of equal pieces (one if it has one), and one for each single place. Places pass through."""
    names = [c.split()[0] for c in MET.split(", ")]
    parts = []
    for b in batches:
        some = b.filter(pc.less(b.column(0), 0))
        if some.num_rows:
            n = some.num_rows
            empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, PLACES, np.int32)), some.column(1), some.column(2), *empty, some.column(3)], names=names)
        for payload in b.filter(pc.greater_equal(b.column(0), 0)).column(3).to_pylist():
            key, content, n, doc, *rest = unpack(payload)
            parts.append((key.astype(np.uint64), content.astype(np.uint64), n.astype(np.int64), unpack_ids(doc), *(x.astype(np.int64) for x in rest)))
    if not parts:
        return
    key, content, n, doc, low, at, size, left = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.argsort(key)
    k = key[order]
    group = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
    live = order[np.bincount(group, weights=n[order])[group] > 1]
    live = live[np.lexsort((content[live], key[live]))]
    key, content, n, doc, low, at, size, left = (x[live] for x in (key, content, n, doc, low, at, size, left))
    if not len(key):
        return
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])])
    second = np.concatenate([[False], head[:-1] & ~head[1:]])
    classes, single = np.flatnonzero(head | second), np.flatnonzero(n == 1)
    for role, some in ((CLASS, classes), (PLACE, single)):
        for i in range(0, len(some), 20_000):
            x = some[i : i + 20_000]
            columns = [pa.array(np.full(len(x), role, np.int32)), pa.array(key[x].view(np.int64)), pa.array(content[x].view(np.int64))]
            columns += [pa.array(doc[x]), pa.array(low[x]), *(pa.array(y[x].astype(np.int32)) for y in (at, size, left)), pa.nulls(len(x), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


PIECES = "key long, content long, doc_id long, low long, at int, left int, piece binary"


def _fetch(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The bytes of the pieces that stand for each class. Texts and places meet by id; a piece must have its class's hash, as texts may differ under one id."""
    place = F.struct("key", "content", "low", "at", "size", "left")
    places = classes.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(place).alias("places"))
    texts = docs.where("text is not null").join(places.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "places")
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def checked(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[6]) for r in rows], dtype=np.int64)
        end = np.cumsum(sizes)
        at = end - sizes + np.minimum(np.array([r[4] for r in rows], dtype=np.int64), sizes)
        of = Anchors.ranges(data)
        same = piece_hash(of(end - sizes, at), of(at, end)).view(np.int64) == np.array([r[1] for r in rows], dtype=np.int64)
        kept = [r for r, ok in zip(rows, same.tolist()) if ok]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                rows += [(p["key"], p["content"], doc, p["low"], p["at"], p["left"], text[p["low"] : p["low"] + p["size"]]) for p in own]
                if len(rows) > 4000:
                    yield from checked(rows)
                    rows = []
        if rows:
            yield from checked(rows)

    return map_batches(texts, run, PIECES)


def _sorted_blocks(length: int):
    """Rows sorted by key and content: blocks of whole keys, a suffix array each; repeats as spans of places in their classes.

    Two rows of a class are enough (repeated rows may have brought more).
    """

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        piece, place = repeated_starts([r[6] for r in rows], length)
        if not len(piece):
            return
        first = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (place[1:] > place[:-1] + length)]))
        last = np.append(first[1:], len(piece)) - 1
        owner = piece[first]
        columns = [pa.array([rows[i][c] for i in owner.tolist()], pa.int64()) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(place[first].astype(np.int32)), pa.array((place[last] + length).astype(np.int32))], names=["key", "content", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, seen, members = 0, (None, None), 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7))):
                members = members + 1 if row[:2] == seen else 1
                if members > 2:
                    continue
                if row[0] != seen[0] and size > BLOCK_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                seen = row[:2]
                held.append(row)
                size += len(row[6])
        if held:
            yield from solve(held)

    return run


def _parts(pieces: DataFrame, slack: int, step: int, length: int, gram: int) -> DataFrame:
    """Pieces cut into parts of up to ``step`` windows each, by how far these reach to the left of the anchor. _key and _content are the part's."""
    reach = length - gram
    most = F.least(F.col("_least") + (step - 1), F.col("left") + slack)  # bytes to the left of the anchor
    each = pieces.withColumn("_least", F.explode(F.sequence(F.col("left"), F.col("left") + slack, F.lit(step)))).withColumn("_most", most)
    size = F.octet_length("piece")
    each = each.withColumns({"_from": F.greatest(F.col("at") - F.col("_most"), F.lit(0)), "_to": F.least(F.col("at") + length - F.col("_least"), size)})
    fit = (F.col("at") >= F.col("_least")) & (F.col("at") + length - F.col("_most") <= size) & (F.col("_to") - F.col("_from") >= length)
    part = F.col("piece").substr(F.col("_from") + 1, F.col("_to") - F.col("_from"))
    shared = F.col("piece").substr(F.col("at") - F.col("_least") + 1, F.col("_least") + gram + reach - F.col("_most"))
    return each.where(fit).select(
        F.xxhash64("key", "_least", shared).alias("_key"), F.xxhash64(F.lit(1), part).alias("_content"), "key", "content", "doc_id",
        (F.col("low") + F.col("_from")).alias("low"), (F.col("at") - F.col("_from")).alias("at"), F.col("_least").alias("left"), F.col("_from"), part.alias("part"),
    )


def _repeats(pieces: DataFrame, slack: int, length: int, gram: int) -> DataFrame:
    """key, content, start, end: repeated stretches of the pieces' classes. Pieces hold up to ``slack`` + 1 windows; keys of very many pieces are cut first."""
    large = None
    if slack:
        sizes = pieces.groupBy("key").agg(F.count("*").alias("_n"))
        large = cut(sizes.where(F.col("_n") > GROUP_PIECES).select(F.col("key").alias("_large")), "large-keys")
    usual, found = pieces, None
    if large is not None and not large.isEmpty():
        usual = pieces.join(large, F.col("key") == F.col("_large"), "left_anti")
        step = max(1, (slack + 1) // 4)
        some = pieces.join(large, F.col("key") == F.col("_large"), "left_semi")
        parts = cut(_parts(some, slack, step, length, gram), "parts")
        # two pieces stand for each part that several have; parts of one piece differ in their keys
        place, by = F.struct("doc_id", "low", "at", "left", "part"), F.struct("doc_id", "low")
        finer = parts.groupBy("_key", "_content").agg(F.count("*").alias("_n"), F.min_by(place, by).alias("p"), F.max_by(place, by).alias("q"))
        finer = finer.withColumn("p", F.explode(F.when(F.col("_n") > 1, F.array("p", "q")).otherwise(F.array("p"))))
        finer = cut(finer.select(F.col("_key").alias("key"), F.col("_content").alias("content"), "p.doc_id", "p.low", "p.at", "p.left", F.col("p.part").alias("piece")), "finer-pieces")
        spans = _repeats(finer, step - 1, length, gram).withColumnsRenamed({"key": "_k", "content": "_c"})
        own = parts.select("key", "content", "_from", "_key", "_content").distinct()
        back = own.join(spans, (F.col("_key") == F.col("_k")) & (F.col("_content") == F.col("_c")))
        found = back.select("key", "content", (F.col("_from") + F.col("start")).alias("start"), (F.col("_from") + F.col("end")).alias("end"))
    dealt = usual.repartition("key").sortWithinPartitions("key", "content")
    direct = map_batches(dealt, _sorted_blocks(length), "key long, content long, start int, end int")
    return direct if found is None else direct.unionByName(found)


def _open_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, low, high of repeated stretches, from places and packed places of their classes."""
    names = ["doc_id", "low", "high"]
    for b in batches:
        doc, low, payload, start, end = (b.column(i) for i in range(5))
        start, end = start.to_numpy().astype(np.int64), end.to_numpy().astype(np.int64)
        one = pc.is_valid(doc).to_numpy(zero_copy_only=False)
        if one.any():
            base = low.filter(pa.array(one)).to_numpy()
            yield pa.RecordBatch.from_arrays([doc.filter(pa.array(one)), pa.array(base + start[one]), pa.array(base + end[one])], names=names)
        for i in np.flatnonzero(~one).tolist():
            ids, lows = unpack(payload[i].as_py())
            lows = lows.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(unpack_ids(ids)), pa.array(lows + start[i]), pa.array(lows + end[i])], names=names)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, low, high: byte ranges of repeated strings, in no order and overlapping. docs: doc_id long, text."""
    buckets = buckets_for(docs, "text")
    sent = map_batches(docs, _send(buckets, length, gram), SENT)
    spread = F.when(F.col("bucket") < 0, F.xxhash64("payload") % buckets).otherwise(F.col("bucket"))
    met = cut(map_batches(sent.repartition(max(1, buckets // 2), spread), _meet, MET), "met-pieces")
    pieces = cut(_fetch(docs, met.where(F.col("role") == CLASS)), "pieces")
    slack = (length - gram + 1) // 2
    repeats = cut(_repeats(pieces, slack, length, gram), "repeats")
    places = met.where(F.col("role") != CLASS).select("key", "content", "doc_id", "low", "payload")
    both = places.join(repeats, ["key", "content"]).select("doc_id", "low", "payload", "start", "end")
    return map_batches(both, _open_places, "doc_id long, low long, high long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """Add ``kept`` (bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``. Columns of these names are replaced."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both, spans = with_spans(docs, merged_spans(repeated_spans(own, length, gram)), doc_id)
    names = ["kept", "n_bytes", "n_removed", "n_spans"]
    fields = [T.StructField("kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in names[1:])]

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            at = batch.schema.get_field_index
            kept, sizes, gone, runs = [], [], [], []
            for t, own in zip(batch.column(at(text)).cast(pa.binary()).to_pylist(), batch.column(at(spans)).to_pylist()):
                t = t or b""
                out, last, count = [], 0, 0
                for low, high in np.frombuffer(own or b"", dtype=np.int64).reshape(-1, 2).tolist():
                    if low >= len(t):  # another text under the same id
                        break
                    out.append(t[last:low])
                    last, count = high, count + 1
                out.append(t[last:])
                kept.append(b"".join(out))
                sizes.append(len(t))
                gone.append(len(t) - len(kept[-1]))
                runs.append(count)
            return [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))]

        return work

    wanted = [c for c in (docs.columns if keep is None else keep) if c not in names]
    return append_columns(both, fields, make, wanted)
