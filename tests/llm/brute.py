"""Plain definitions of the operators' results, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(docs, n=200):
    """op2: {id: (n_bytes, n_removed, n_spans, sha)}; docs is a list of (id, text)."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[a : a + n] for _, b in data for a in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - n + 1):
            if seen[b[a : a + n]] > 1:
                gone[a : a + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(t, k=5):
    w = BLANK.findall(lower(t))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near(docs, k=5, percent=75):
    """op3: (id, n_shingles, component_id, kept)."""
    sets = [shingles(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inv = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inv[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inv[x] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * len(s | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = root(i)
            low[r] = min(low.get(r, d), d)
    return [(d, len(sets[i]), low.get(root(i)), d == low.get(root(i))) for i, (d, _) in enumerate(docs)]


def leaks(docs, items, n=10):
    """op5: (id, n_words, n_hit, n_items, sha, contaminated)."""
    wins = defaultdict(set)
    for i, t in items:
        w = BENCH.findall(lower(t))
        m = min(n, len(w))
        for a in range(len(w) - m + 1) if m else ():
            wins[tuple(w[a : a + m])].add(str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w = BENCH.findall(lower(t))
        hit, found = set(), set()
        for m in sizes:
            for a in range(len(w) - m + 1):
                k = tuple(w[a : a + m])
                if k in wins:
                    hit.update(range(a, a + m))
                    found |= wins[k]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(docs):
    """op7: (id, n_assign, n_access, n_hex, sha)."""
    out = []
    for d, t in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(s[3] for s in spans)
        out.append((d, kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))))
    return out


def rules(docs):
    """op8: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = []
    for d, t in docs:
        t = t or ""
        w = BLANK.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if BLANK.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                rep.update((i, i + 1, i + 2))
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    return out


def crc(x):
    return zlib.crc32(x.encode())


def simhash(t, k=3):
    w = lower(t).encode().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def lowest_linked(ids, linked):
    """Smallest id (not null) reachable from each position; ``linked(i, j)`` for i < j."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if linked(i, j):
                parent[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(docs, least=3, top=200):
    """op12 rows; docs is a list of (text, lang, source)."""
    docs = [(LETTER.findall(lower(t)), la or "", s or "") for t, la, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(w for words, _, _ in own for w in set(words))
        kept = sorted(w for w, n in df.items() if n >= least)
        v = len(kept)

        def profile(words):
            c = Counter(w for w in words if df[w] >= least)
            n = sum(c.values())
            return c, {w: 1 + 10**9 * (c[w] + 1) // (n + v) for w in kept}

        whole = profile([w for words, _, _ in own for w in words])[1]
        sources = {s: profile([w for words, _, x in own for w in words if x == s]) for s in {d[2] for d in own}}
        f = lambda p, q: (p - q) * (p - q) // q
        for s, (c, p) in sources.items():
            pair = [(o, sum(f(p[w], q[w]) for w in kept)) for o, (_, q) in sources.items() if o != s]
            term = [(w, f(p[w], whole[w])) for w in kept if c[w] and p[w] > whole[w]]
            for part, items in (("pair", pair), ("term", term)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, x, k + 1) for k, (i, x) in enumerate(items) if part == "pair" or k < top]
    return out
