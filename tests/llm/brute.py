"""What the operators must return, computed the plain way on small data."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import e, log

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def bpe_rows(docs, path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, text in docs:
        ids = coder.encode_ordinary(text or "")
        yield i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def shingles(text: str | None, k: int = 5) -> set[tuple[bytes, ...]]:
    words = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(docs) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_row(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(a + b + c))
    return len(a), len(b), len(c), sha(joined.encode())


def warc_rows(pages):
    holder = {}
    for i, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000:
            holder[data] = max(i, holder.get(data, i))
    for i, html in pages:
        data = (html or "").encode()
        other = holder.get(data, i)
        yield i, len(data), hashlib.sha1(data).hexdigest(), "response" if other == i else "revisit", None if other == i else other


def window_rows(docs, k: int = 13):
    words = {i: WORD.findall((t or "").encode()) for i, t in docs}
    first = {}
    for i, w in sorted(words.items()):
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    for i, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = True
        yield i, len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone) if not g))


def byte_rows(docs, length: int = 400):
    """Windows are told apart by Python's 64-bit hash of their bytes."""
    texts = {i: (t or "").encode() for i, t in docs}
    seen = Counter()
    for t in texts.values():
        seen.update(hash(t[p : p + length]) for p in range(len(t) - length + 1))
    for i, t in texts.items():
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if seen[hash(t[p : p + length])] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        yield i, len(t), int(gone.sum()), runs, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())


def top_rows(vectors, k: int = 20, every: int = 20):
    """vectors: (vec_id, list). Exact integers by Python."""
    kept = []
    for i, v in vectors:
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(64.0 * float(x))) for x in v]))
    for q, v in kept:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)
            for rank, (score, i) in enumerate(scored[:k], 1):
                yield q, rank, i, -score


def leak_rows(docs, items, percent: int = 75):
    held = {j: shingles(t) for j, t in items}
    for i, text in docs:
        s = shingles(text)
        for j, h in held.items():
            n = len(s & h)
            if h and 100 * n >= percent * len(h):
                yield i, j, len(h), n


class _Tag(dict):
    """Itself only, whatever it holds."""

    __eq__, __ne__, __hash__ = object.__eq__, object.__ne__, object.__hash__


class _Dom(HTMLParser):
    """A DOM for pages whose tags are all closed, but for ``br`` and inline markup at the end of a paragraph."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Tag(name="#root", attrs={}, kids=[], up=None)
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attrs):
        if name == "p":
            while self.at["name"] in ("b", "p"):
                self.at = self.at["up"]
        node = _Tag(name=name, attrs=dict(attrs), kids=[], up=self.at)
        self.at["kids"].append(node)
        if name not in ("br", "meta"):
            self.at = node

    def handle_endtag(self, name):
        node = self.at
        while node["name"] not in (name, "#root"):
            node = node["up"]
        if node["up"]:
            self.at = node["up"]

    def handle_data(self, data):
        if self.at["name"] not in ("script", "style", "title"):
            self.at["kids"].append(data)


def main_text(page, marks, weight, p_weight):
    """Composite text density from its definition: everything is counted anew for each node."""
    blocks = "body div article section p h1 h2 ul li".split()
    never = ("nav", "footer", "aside", "form", "script", "style", "title")

    def below(n):
        for k in n["kids"]:
            if not isinstance(k, str):
                yield k
                yield from below(k)

    def ups(n):
        while n:
            yield n
            n = n["up"]

    def count(n, all_):
        inside = [k for k in below(n) if all_ or not any(u["name"] in never for u in ups(k) if u not in list(ups(n)))]
        inside = [k for k in inside if k["name"] not in ("script", "style", "title")]
        length = lambda k: sum(len("".join(s.split())) for s in k["kids"] if isinstance(s, str))
        linked = [k for k in [n, *inside] if any(u["name"] == "a" for u in ups(k) if u is n or u in inside)]
        return sum(length(k) for k in [n, *inside]), sum(map(length, linked)), len(inside), sum(k["name"] == "a" for k in inside)

    def marked(n):
        words = [t.replace("-", " ").split() for t in n["attrs"].get("class", "").split()]
        return any(w and set(w) <= marks for w in words) and n["name"] not in ("h1", "h2", "article", "body")

    def density(n, all_=False):
        c, lc, t, lt = count(n, all_)
        if not c:
            return 0
        pc, plc, _, _ = count(root, False)
        factor = min([1] + [p_weight if u["name"] == "p" else weight for u in ups(n) if marked(u)])
        base = max(log(c / max(c - lc, 1) * lc + plc / max(pc, 1) * c + e), e)
        return factor * (c / max(t, 1) * (log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / log(base)))

    root = _Dom(page).root
    kids = lambda n: [k for k in n["kids"] if not isinstance(k, str) and k["name"] not in never]
    total = lambda n: sum(map(density, kids(n)))

    def top(n):
        """The first of the largest sums, a node before what is below it."""
        found = n if count(n, False)[0] and n["name"] not in ("a", "b") else None
        for k in kids(n):
            t = top(k)
            if t is not None and (found is None or total(t) > total(found)):
                found = t
        return found

    best = top(root)
    if best is None:
        return ""
    path = [u for u in ups(best) if u["name"] not in ("#root", "html")]
    high = min(map(density, [best, *path]))
    low = min([high, *(density(u, True) for u in path)])
    mild = lambda n: not any(map(marked, ups(n)))
    kept = []

    def visit(n):
        if n["name"] not in ("#root", "html"):
            t = top(n)
            if t is None or density(n) < (low if mild(n) else high):
                return
            kept.append(next((u for u in ups(t) if u["name"] in ("article", "section", "div", "body") or t is not best and u is n), root))
        for k in kids(n):
            if k["name"] not in ("a", "b"):
                visit(k)

    visit(root)
    lines = [""]

    def write(n):
        c, lc, _, lt = count(n, False)
        if n not in kept and (n["name"] in never or marked(n) and density(n) < high or n["name"] in ("ul", "div", "section") and lt > 1 and 2 * lc > c and density(n) < low):
            lines.append("")
            return
        if n["name"] in blocks:
            lines.append("")
        for k in n["kids"]:
            if isinstance(k, str):
                lines[-1] += k
            elif k["name"] == "br":
                lines[-1] += " "
            else:
                write(k)
        if n["name"] in blocks:
            lines.append("")

    def order(n):
        if n in kept or n is root and not kept:
            lines.append("")
            write(n)
        else:
            for k in kids(n):
                order(k)

    order(root)
    return "\n".join(t for t in (" ".join(x.split()) for x in lines) if t)
