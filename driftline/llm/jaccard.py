"""N-gram Jaccard join: near copies by word shingles, with a prefix-tree join.

A document's set holds its distinct shingles of ``WORDS`` words (lower-cased A-Z); two documents link when
they share at least ``PERCENT`` of the union. The work is on different sets: equal sets are one node.

1. One pass over the texts gives each document its set's size and node, and finds the frequent shingles:
   a chunk reports what it holds three times, so whatever is in more sets than twice the number of chunks
   is seen. Those in at least one set in ``RARE_SHARE`` are kept: their number is bounded by the mean set
   size times ``RARE_SHARE``, whatever the corpus, so they are broadcast.
2. The global order puts rare shingles first, by hash, then frequent ones by frequency. Two sets that link
   share at least k shingles within their first n - need + k. These prefixes meet in buckets by shingle, as
   packed arrays of many sets. Small groups give pairs with the number of shingles shared; in large groups
   each member is paired with a leader only. Pairs stay whose sizes allow a link with what they share of prefixes at most, and
   whose sketches (parities of classes of shingles) differ no more than linked sets may.
3. Prefix-tree join. The sets of the pairs that one shingle (or one leader) showed are a block. A block stores its sets
   in one trie, in an order of its own shingles, and all of them walk it together: what stored sets share is
   counted once for every walker, a subtree is left by those that all that remains cannot bring to the overlap
   needed, or that are joined with its sets already, and left altogether when none is left in it.
4. Links make components. Sets of large groups that still stand in several components, and whose sizes and common
   shingles allow a link, are compared across components by the same tree, so no link is lost; then components
   are made anew.

Defined results: texts without words (null, empty) have an empty set and are linked with nothing; fewer than
five words are one shingle; equal texts and repeated rows link; rows of one id with different texts are sets of their
own, with that id; a row without id takes no part and gets no component; sets are told apart by a 64-bit hash of shingles and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import cut, map_batches
from ._blobs import bytes_hash, hash_bytes, pack, unpack
from ._graph import components
from ._hashing import Words, as_long, groups, mix, ngrams
from ._spans import buckets_for

WORDS, PERCENT = 5, 75
#: Shingles in at least one set of so many are ordered last.
RARE_SHARE = 2000
CHUNK_BYTES, CHUNK_TOKENS = 16 << 20, 2_500_000
#: Groups of up to so many sets give all their pairs.
SMALL_GROUP = 16
BLOCK = 64
#: Bits of the sketch of a small and of a large set.
SKETCH_BITS = 128, 8192
TOKEN_BYTES, SET_BYTES = 5, 6
#: Places of sets are broadcast up to so many rows and bytes; beyond, texts are shuffled to them.
BROADCAST_IDS, BROADCAST_BYTES = 200_000, 16 << 20
_SALT = np.uint64(0xBB67AE8584CAA73B)


def token_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    words = Words(texts, lower=True)
    own = words.hashes()
    h, first, out = ngrams(own, k), words.first.tolist(), []
    for a, b in zip(first, first[1:]):
        if b - a >= k:
            tokens = np.sort(h[a : b - k + 1])
            again = tokens[1:] == tokens[:-1]
            out.append(tokens[np.concatenate([[True], ~again])] if again.any() else tokens)
        else:
            out.append(ngrams(own[a:b], b - a) if b > a else h[:0])
    return out


def nodes_of(sets: list[np.ndarray]) -> list[int | None]:
    """64-bit names of sets; None of empty ones."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return [None] * len(sets)
    first = np.cumsum(sizes[some]) - sizes[some]
    total = np.add.reduceat(mix(np.concatenate([sets[i] for i in some.tolist()]) ^ _SALT), first)
    names = as_long(mix(total + sizes[some].astype(np.uint64) * _SALT)).tolist()
    out: list[int | None] = [None] * len(sets)
    for i, name in zip(some.tolist(), names):
        out[i] = name
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each class of shingles: whether the set holds an odd number of them. There are some 4 to 8 classes a shingle, within bounds."""
    bits = min(max(4 * len(tokens), SKETCH_BITS[0]), SKETCH_BITS[1])
    bits = 1 << (bits - 1).bit_length()
    return np.packbits((np.bincount(((tokens >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart_at_least(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many shingles only one of two sets has, at least; a row of bytes for each sketch. The longer sketches are folded."""
    short = min(one.shape[1], other.shape[1])
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(len(x), -1, short), axis=1)
    return np.bitwise_count(fold(one) ^ fold(other)).sum(axis=1, dtype=np.int64)


def need(n, percent: int = PERCENT):
    """Shingles that a set of n must share with any set it links to."""
    return (n * percent + 99) // 100


def extra(n):
    """k: how many shingles the prefixes of linked sets share at least."""
    return 1 + n // 16


def overlap_of(na, nb, percent: int = PERCENT):
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (na + nb) // (100 + percent))


def least_shared(na, nb, percent: int = PERCENT):
    """Shingles that the prefixes of two sets of these sizes share at least, if they link.

    Of the set whose prefix ends first, ``need - extra`` shingles come after it; all others that both have are in both prefixes.
    """
    return overlap_of(na, nb, percent) - np.maximum(need(na, percent) - extra(na), need(nb, percent) - extra(nb))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return ((i, t or b"") for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()))


def _first_pass(k: int):
    """A row for each document (doc_id, row, n, node, sketch); rows with a payload: shingles that a chunk holds three times, with counts."""
    names = ["doc_id", "row", "n", "node", "sketch", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0

        def report() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            row = [None, None, None, None, None, pack(tokens[n > 2], n[n > 2])]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        named = ((i, r, t or b"") for b in batches for i, t, r in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()))
        for group in groups(named):
            sets = token_sets([t for _, _, t in group], k)
            nodes = nodes_of(sets)
            columns = [i for i, _, _ in group], [r for _, r, _ in group], [len(s) for s in sets], nodes, [sketch(s) if len(s) else None for s in sets], [None] * len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)
            for node, tokens in zip(nodes, sets):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(tokens)
                    total += len(tokens)
            if total > CHUNK_TOKENS:
                yield report()
                held, total = [], 0
                seen.clear()
        if held:
            yield report()

    return run


def _frequent(reports: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order of hash, and the place of each in order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column(0).to_pylist():
                tokens, n = unpack(payload)
                for a in range(0, len(tokens), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(tokens[a : a + 100_000].astype(np.uint64))), pa.array(n[a : a + 100_000].astype(np.int64))], names=["token", "n"])

    counted = map_batches(reports.select("payload"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(32, documents // RARE_SHARE)).toPandas()
    rows["token"] = rows["token"].to_numpy(np.int64).view(np.uint64)
    rows = rows.sort_values(["n", "token"]).reset_index(drop=True).reset_index().sort_values("token")
    return rows["token"].to_numpy(np.uint64), rows["index"].to_numpy(np.int64)


def ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """A set in global order, and how many of it are frequent."""
    known, place = frequent
    if not len(known):
        return tokens, 0
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    hit = known[at] == tokens
    if not hit.any():
        return tokens, 0
    return np.concatenate([tokens[~hit], tokens[hit][np.argsort(place[at[hit]])]]), int(hit.sum())


def _send(frequent, k: int, percent: int, buckets: int):
    """Prefixes of a chunk's different sets, packed for each bucket."""

    def flush(found: dict[int, tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes = np.array(list(found), dtype=np.int64).view(np.uint64)
        sizes = np.array([n for n, _, _ in found.values()], dtype=np.int64)
        central = np.array([c for _, c, _ in found.values()], dtype=np.int64)
        prefixes = [p for _, _, p in found.values()]
        row = np.repeat(np.arange(len(nodes)), [len(p) for p in prefixes])
        h = np.concatenate(prefixes)
        bucket = (mix(h ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        names, payloads = [], []
        for b in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[b] : bounds[b + 1]]
            heads = np.flatnonzero(np.diff(row[own], prepend=-1))
            r = row[own][heads]
            payloads.append(pack(nodes[r], sizes[r], central[r], np.diff(heads, append=len(own)), hash_bytes(h[own], TOKEN_BYTES)))
            names.append(int(b))
        for a in range(0, len(names), 16):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 16], pa.int32()), pa.array(payloads[a : a + 16], pa.binary())], names=["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = frequent.value
        found: dict[int, tuple[int, int, np.ndarray]] = {}
        size = 0
        for group in groups((i, t) for i, t in _rows(batches) if i is not None):
            sets = token_sets([t for _, t in group], k)
            for node, tokens in zip(nodes_of(sets), sets):
                n = len(tokens)
                if n and node not in found:
                    full, common = ordered(tokens, order)
                    found[node] = n, common * 255 // n, full[: n - need(n, percent) + min(extra(n), need(n, percent))]
            size += sum(len(t) for _, t in group)
            if size > CHUNK_BYTES and found:
                yield from flush(found)
                found, size = {}, 0
        if found:
            yield from flush(found)

    return run


CANDIDATES = "a long, b long, shared long, leader long, na long, nb long, token long, payload binary"


def _candidate_batch(a, b, shared, leader, na, nb, token=None, payloads=None) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    for i in range(0, len(a), 20_000):
        cutout = slice(i, i + 20_000)
        n = len(a[cutout])
        arrays = [pa.array(a[cutout], pa.int64()), pa.array(b[cutout], pa.int64()), pa.array(shared[cutout], pa.int64())]
        arrays += [pa.nulls(n, pa.int64()) if leader is None else pa.array(leader[cutout], pa.int64()), pa.array(na[cutout], pa.int64()), pa.array(nb[cutout], pa.int64())]
        arrays.append(pa.nulls(n, pa.int64()) if token is None else pa.array(token[cutout], pa.int64()))
        arrays.append(pa.nulls(n, pa.binary()) if payloads is None else pa.array(payloads[cutout], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _counted(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, key: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Different pairs, smaller node first, whose sizes allow a link; with how often each came and the smallest key that showed it."""
    fit = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (a != b)
    a, b, na, nb, key = a[fit], b[fit], na[fit], nb[fit], key[fit]
    turn = a > b
    a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
    order = np.lexsort((key, b, a))
    a, b, na, nb, key = a[order], b[order], na[order], nb[order], key[order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[heads], b[heads], na[heads], nb[heads], key[heads], np.diff(heads, append=len(a))


def _meet(percent: int):
    """In a bucket: pairs of small groups, leader pairs and membership of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes, sizes, central, counts, h = unpack(payload)
                key = bytes_hash(h, TOKEN_BYTES) | (np.uint64(bucket & 0x3FFFFF) << np.uint64(8 * TOKEN_BYTES))
                counts = counts.astype(np.int64)
                parts.append((key, *(np.repeat(x.astype(np.uint64).view(np.int64), counts) for x in (nodes, sizes, central))))
        if not parts:
            return
        key, node, n, central = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])  # of groups of two and more
        order, key = order[keep], key[keep]
        inner = np.lexsort((node[order], key))
        order, key = order[inner], key[inner]
        node, n, central = node[order], n[order], central[order]
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])]) if len(key) else np.zeros(0, bool)
        key, node, n, central = key[first], node[first], n[first], central[first]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(heads, append=len(key))
        size = np.repeat(sizes, sizes)
        small = size <= SMALL_GROUP
        sk, sn, sz = key[small], node[small], n[small]
        left, right = [], []
        for step in range(1, SMALL_GROUP):
            at = np.flatnonzero(sk[step:] == sk[:-step])
            if not len(at):
                break
            left.append(at)
            right.append(at + step)
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            a, b, na, nb, token, shared = _counted(sn[i], sn[j], sz[i], sz[j], as_long(sk[i]), percent)
            yield from _candidate_batch(a, b, shared, None, na, nb, token)
        lead_a, lead_b, lead_na, lead_nb = [], [], [], []
        for start, m in zip(heads[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
            members = slice(start, start + m)
            best = start + int(np.lexsort((node[members], -central[members]))[0])
            lead_a.append(np.full(m, node[best]))
            lead_b.append(node[members])
            lead_na.append(np.full(m, n[best]))
            lead_nb.append(n[members])
            for s in range(start, start + m, 50_000):
                piece = slice(s, min(s + 50_000, start + m))
                none = np.zeros(1, np.int64)
                yield from _candidate_batch(as_long(key[s : s + 1]), none, np.full(1, m), None, none, none, None, [pack(node[piece].view(np.uint64), n[piece])])
        if lead_a:
            leader, member = np.concatenate(lead_a), np.concatenate(lead_b)
            order = np.lexsort((leader, member))
            once = np.concatenate([[True], (leader[order][1:] != leader[order][:-1]) | (member[order][1:] != member[order][:-1])])
            at = order[once]
            na, nb = np.concatenate(lead_na)[at], np.concatenate(lead_nb)[at]
            leader, member = leader[at], member[at]
            fit = (leader != member) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            leader, member, na, nb = leader[fit], member[fit], na[fit], nb[fit]
            turn = leader > member
            yield from _candidate_batch(np.where(turn, member, leader), np.where(turn, leader, member), np.zeros(len(leader), np.int64), leader, np.where(turn, nb, na), np.where(turn, na, nb))

    return run


def trie_join(sets: list[np.ndarray], percent: int = PERCENT, forest: bool = False, of: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of indexes of linked sets. All sets walk one prefix tree of them together.

    ``forest``: only as many links as join each component; a walker leaves a subtree whose sets it is joined with. ``of``: the
    component that each set is known to be in, so that links within it are not looked for.
    """
    m = len(sets)
    tokens = np.concatenate(sets)
    distinct, which, often = np.unique(tokens, return_inverse=True, return_counts=True)
    place = np.empty(len(distinct), dtype=np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(distinct))  # common tokens first, so that prefixes are shared
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    ranked = [np.sort(place[which[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
    order = sorted(range(m), key=lambda i: ranked[i].astype(">u8").tobytes())
    stored = [ranked[i] for i in order]
    joined = np.arange(m) if of is None else np.unique(np.array(of)[order], return_inverse=True)[1]
    sizes = np.array([len(s) for s in stored])
    needed = (percent * (sizes[:, None] + sizes) + 99 + percent) // (100 + percent)  # overlap o: 100 o >= percent (a + b - o)
    token = np.concatenate(stored)
    holder = np.repeat(np.arange(m), sizes)
    by = np.lexsort((holder, token))
    token, holder = token[by], holder[by]
    start = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(distinct)))])  # of a token's holders
    out: list[tuple[int, int]] = []
    todo = [(0, m, 0, np.zeros(m, dtype=np.int64), np.arange(m))]
    while todo:
        low, high, depth, overlap, walkers = todo.pop()
        first, last = stored[low], stored[high - 1]
        n = min(len(first), len(last))
        apart = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + int(apart[0]) if len(apart) else n  # sorted: what first and last share, all share
        label = first[depth:end]
        if len(label):  # counted once for all walkers
            size = start[label + 1] - start[label]
            at = np.arange(int(size.sum())) + np.repeat(start[label] - np.cumsum(size) + size, size)
            overlap = overlap + np.bincount(holder[at], minlength=m)
        while low < high and len(stored[low]) == end:  # sets that end here
            for w in walkers[(overlap[walkers] >= needed[walkers, low]) & (walkers < low)].tolist():
                if not forest or joined[w] != joined[low]:
                    out.append((order[w], order[low]))
                    joined[joined == joined[w]] = joined[low]
            low += 1
        if low == high:
            continue
        rest = np.array([len(stored[w]) - np.searchsorted(stored[w], first[end - 1], side="right") if end else len(stored[w]) for w in walkers.tolist()])
        most = overlap[walkers, None] + np.minimum(sizes[low:high] - end, rest[:, None])
        able = (most >= needed[walkers, low:high]) & (walkers[:, None] < np.arange(low, high))
        if forest:
            able &= joined[walkers, None] != joined[low:high]
        walkers = walkers[able.any(axis=1)]
        if not len(walkers):
            continue
        branch = np.array([s[end] for s in stored[low:high]])
        cuts = [0, *(np.flatnonzero(branch[1:] != branch[:-1]) + 1).tolist(), high - low]
        todo += [(low + a, low + b, end, overlap, walkers) for a, b in zip(cuts, cuts[1:])]
    return out


def _join_blocks(percent: int):
    """Rows sorted by block: its sets, each as (node, component so far, tokens). Links of a block, as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, comps, sets = None, [], [], []
        left, right = [], []

        def done() -> None:
            if len(nodes) > 1:
                for i, j in trie_join(sets, percent, forest=True, of=comps):
                    left.append(nodes[i])
                    right.append(nodes[j])

        for b in batches:
            for of, part, node, comp, tokens in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (of, part) != key:
                    done()
                    key, nodes, comps, sets = (of, part), [], [], []
                if not nodes or node != nodes[-1]:  # repeated rows bring a set again
                    nodes.append(node)
                    comps.append(comp)
                    sets.append(bytes_hash(np.frombuffer(tokens, np.uint8), SET_BYTES))
            if len(left) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        done()
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, leader, token) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column(4), batch.column(5)
            na, nb = (batch.column(i).to_numpy() for i in (6, 7))
            sizes = np.stack([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in (one, other)], axis=1)
            able = np.zeros(len(na), bool)
            for kind in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == kind).all(axis=1))
                x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for c in (one, other))
                able[at] = apart_at_least(x, y) <= na[at] + nb[at] - 2 * overlap_of(na[at], nb[at], percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(able)) for i in range(4)], names=["a", "b", "leader", "token"])

    pairs = cut(pairs.select("a", "b", "leader", "token"), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    own = cut(sketches.join(nodes, F.col("node") == F.col("_node"), "left_semi"), "sketches")
    of = lambda side: own.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return map_batches(both.select("a", "b", "leader", "token", "sketch_a", "sketch_b", "na", "nb"), run, "a long, b long, leader long, token long")


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, percent: int, k: int, labels: DataFrame | None = None) -> DataFrame:
    """Links among the sets of the pairs (a, b, leader, token), by prefix trees.

    Pairs of a small group are one block, named by its shingle; those of a leader are cut into blocks of ``BLOCK`` sets
    besides the leader. A set is made from the text of one document that has it, once, and goes with all its blocks in
    the one shuffle of whole sets. ``labels``: components so far (node, comp); no links are looked for within them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = F.col("leader").isNotNull()
    of = F.coalesce("leader", "token")
    pairs = cut(pairs.select(of.alias("of"), led.alias("led"), "a", "b"), "blocks")
    degree = pairs.where("led").groupBy("of").agg(F.count("*").alias("degree"))
    member = F.when(F.col("a") == F.col("of"), F.col("b")).otherwise(F.col("a"))
    placed = pairs.join(degree, "of", "left").withColumn("part", F.when(F.col("led"), F.pmod(F.xxhash64(member), F.ceil(F.col("degree") / BLOCK))).otherwise(F.lit(-1)))
    members = placed.select("of", "part", F.explode(F.array("a", "b")).alias("node")).distinct()
    # a set in very many blocks has its places in several rows, so that no row is long
    share = F.pmod(F.xxhash64("of", "part"), F.lit(64))
    places = members.groupBy("node", share.alias("share")).agg(F.collect_list(F.struct("of", "part")).alias("places"))
    reps = rows.groupBy("node").agg(F.min("doc_id").alias("_rep"))
    named = places.join(reps, "node")
    comp = F.col("node") if labels is None else F.coalesce("comp", "node")
    placed = cut((named if labels is None else named.join(labels, "node", "left")).select("_rep", "node", comp.alias("comp"), "places"), "places")
    n_rows, n_places = placed.select(F.count("*"), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    small = n_rows <= BROADCAST_IDS and n_places * 24 <= BROADCAST_BYTES
    texts = docs.where("text is not null").join(F.broadcast(placed) if small else placed, F.col("doc_id") == F.col("_rep")).select("text", "node", "comp", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[tuple[int, int, list]]] = {}
            for text, node, comp, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.setdefault(text, []).append((node, comp, own))
            for group in groups((None, t.encode()) for t in held):
                sets = token_sets([t for _, t in group], k)
                for (_, text), name, tokens in zip(group, nodes_of(sets), sets):
                    if name is None:
                        continue
                    packed = hash_bytes(np.unique(bytes_hash(hash_bytes(tokens, SET_BYTES), SET_BYTES)), SET_BYTES).tobytes()
                    out = [(p["of"], p["part"], comp) for node, comp, own in held[text.decode()] if node == name for p in own]  # else another text under the same id
                    step = max(1, (4 << 20) // max(1, len(packed)))
                    for i in range(0, len(out), step):
                        some = out[i : i + step]
                        of, part, comps = (pa.array([p[c] for p in some], pa.int64()) for c in range(3))
                        columns = [of, part, pa.array([name] * len(some), pa.int64()), comps, pa.array([packed] * len(some), pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["of", "part", "node", "comp", "tokens"])

    dealt = map_batches(texts, run, "of long, part long, node long, comp long, tokens binary").repartition(parts, "of", "part").sortWithinPartitions("of", "part", "node")
    return map_batches(dealt, _join_blocks(percent), "a long, b long").distinct()


def _large_groups(met: DataFrame) -> DataFrame:
    """token, node, n and the group's size, a row for each membership of a large group."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, size, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                nodes, n = unpack(payload)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), key, np.int64)), pa.array(nodes.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.full(len(n), size, np.int64))], names=["token", "node", "n", "size"])

    return map_batches(met.where("payload is not null").select("a", "shared", "payload"), spread, "token long, node long, n long, size long")


def _across(large: DataFrame, held: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in one large group but, so far, in different components, that no small group has shown.

    Two such sets must share ``least_shared`` tokens of large groups alone. A set that holds fewer than k takes no part, and of those
    that hold more, in order of group size, only the first that k shared ones cannot all miss. From the first shared token on,
    both hold as many as they must share (``room``).
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], [], [], [], []]
        for b in batches:
            for i in range(5):
                columns[i].append(b.column(i).to_numpy())
        if not columns[0]:
            return
        token, node, n, comp, room = (np.concatenate(c) for c in columns)
        order = np.lexsort((n, token))
        token, node, n, comp, room = token[order], node[order], n[order], comp[order], room[order]
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        found, size = [], 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for i, j in apart(n[a:b], comp[a:b], room[a:b], percent):
                found.append((node[a:b][i], node[a:b][j], n[a:b][i], n[a:b][j], np.full(len(i), token[a])))
                size += len(i)
                if size > 2_000_000:
                    found = [_counted(*(np.concatenate(x) for x in zip(*found)), percent)[:5]]
                    size = len(found[0][0])
        if found:
            x, y, *_ = _counted(*(np.concatenate(f) for f in zip(*found)), percent)
            for i in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]), pa.array(y[i : i + 50_000])], names=["a", "b"])

    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.least(_extra_column(F.col("n")), _need_column(F.col("n"), percent))
    heavy = large.join(held, "node").where(F.col("held") >= least)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("size", "token"))
    first = heavy.withColumn("rank", rank).where(F.col("rank") <= F.col("held") - least + 1)
    rows = cut(first.join(labels, "node", "left").select("token", "node", "n", F.coalesce("comp", "node").alias("comp"), (F.col("held") - F.col("rank") + 1).alias("room")), "large-groups")
    split = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    open_rows = rows.join(split, "token").select("token", "node", "n", "comp", "room")
    pairs = map_batches(open_rows.repartition(parts, "token"), pair, "a long, b long").distinct()
    return pairs.select("a", "b", F.col("a").alias("leader"), F.lit(None).cast("long").alias("token"))


#: Cells of a table of pairs that are looked at together.
PAIR_CELLS = 1 << 18


def apart(n: np.ndarray, comp: np.ndarray, room: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of sets in order of size: pairs of indexes in different components that may link, by sizes and room.

    Sets of the largest component are partners only, so what is looked at grows with those outside it.
    """
    names, of, often = np.unique(comp, return_inverse=True, return_counts=True)
    most = int(np.argmax(often))
    rest = np.flatnonzero(of != most)
    step = max(1, PAIR_CELLS // len(n))
    for s in range(0, len(rest), step):
        i = rest[s : s + step]
        j = np.arange(np.searchsorted(n, need(n[i[0]], percent)), np.searchsorted(n, n[i[-1]] * 100 // percent, side="right"))
        able = (of[i][:, None] != of[j]) & ((of[j] == most) | (j > i[:, None]))
        able &= np.minimum(room[i][:, None], room[j]) >= least_shared(n[i][:, None], n[j], percent)
        left, right = np.nonzero(able)
        if len(left):
            yield i[left], j[right]


def _extra_column(n: Column) -> Column:
    return F.lit(1) + F.floor(n / 16)


def _need_column(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100)


def _least_column(na: Column, nb: Column, percent: int) -> Column:
    """``least_shared`` of columns."""
    rest = [_need_column(n, percent) - F.least(_extra_column(n), _need_column(n, percent)) for n in (na, nb)]
    return F.ceil((na + nb) * percent / (100 + percent)) - F.greatest(*rest)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row (a hash of its text), n_shingles, node (its set; null for none), group (its component) and component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    passed = cut(map_batches(docs.withColumn("row", F.xxhash64("text")), _first_pass(k), "doc_id long, row long, n long, node long, sketch binary, payload binary"), "sets-first-pass")
    rows = passed.where("payload is null").select("doc_id", "row", "n", "node")
    linkable = rows.where("node is not null and doc_id is not null").select("doc_id", "node")
    sketches = cut(passed.where("node is not null and doc_id is not null").select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")  # copies before any shuffle
    frequent = spark.sparkContext.broadcast(_frequent(passed.where("payload is not null"), rows.count()))
    buckets = buckets_for(docs, "text")  # by bytes of text; a task has about two
    sent = map_batches(docs, _send(frequent, k, percent, buckets), "bucket int, payload binary")
    met = cut(map_batches(sent.repartition(max(parts, buckets // 2), "bucket"), _meet(percent), CANDIDATES), "candidates")
    pairs = met.where("payload is null").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("leader").alias("leader"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.min("token").alias("token"))
    # what both hold of large groups may be shared too: such pairs are not looked for again
    large = cut(_large_groups(met), "large-members")
    held = cut(large.groupBy("node").agg(F.count("*").alias("held")), "large-held")
    of = lambda side: held.select(F.col("node").alias(side), F.col("held").alias(f"held_{side}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = F.coalesce(F.least("held_a", "held_b", F.when(F.col("held_a").isNull() | F.col("held_b").isNull(), F.lit(0))), F.lit(0))
    pairs = pairs.where(F.col("shared") + more >= _least_column(F.col("na"), F.col("nb"), percent))
    links = cut(_verified(docs, linkable, _sketched(pairs, sketches, percent), percent, k), "links")
    labels = components(links)
    if held.limit(1).count():
        more = cut(_sketched(_across(large, held, labels, percent), sketches, percent), "across")
        if more.limit(1).count():
            again = cut(_verified(docs, linkable, more, percent, k, labels), "links")
            if again.limit(1).count():
                labels = components(links.union(again))
    smallest = linkable.groupBy("node").agg(F.min("doc_id").alias("own"))
    joined = cut(smallest.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "nodes")
    best = joined.groupBy("comp").agg(F.min("own").alias("component"))
    named = cut(joined.join(best, "comp").select(F.col("node").alias("_node"), "component", F.col("comp").alias("group")), "components")
    out = rows.join(named, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "node", "group", own.alias("component_id"))
