"""Plain versions of the operators' results, quadratic and in one process."""

import hashlib
import math
import re
from collections import defaultdict

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def classes(nodes, links):
    """Smallest member of each node's component."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, width=5):
    w = words(lower(text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard(docs, percent=80):
    """doc_id -> (set size, component)"""
    sets = {d: shingles(t) for d, t in docs}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    both = defaultdict(int)
    for ds in where.values():
        ds = sorted(ds)
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    c = classes(sets, links)
    return {d: (len(s), c[d]) for d, s in sets.items()}


def suffix(docs, length=50):
    """doc_id -> (bytes, removed, spans, digest); rows of (id, text), ids may repeat"""
    first = {}
    raws = [(d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), runs, sha(bytes(b for b, x in zip(raw, gone, strict=True) if not x))))
    return sorted(out)


def lines(docs, min_words=40):
    """(id, text) -> kept lines; ids may repeat with other texts, equal rows are one"""
    rows = sorted(set(docs), key=lambda r: r[0])
    found = defaultdict(list)
    for key, (d, text) in enumerate(rows):
        own = text.split("\n")
        for i in range(len(own)):
            n = 0
            for j in range(i, len(own)):
                n += len(words(own[j]))
                if n >= min_words:
                    found["\n".join(own[i : j + 1])].append((d, i, key, j + 1))
                    break
    gone = defaultdict(set)
    for at in found.values():
        at = sorted(at)
        for d, i, key, end in at[1:]:
            gone[key] |= set(range(i, end))
    return {
        row: "\n".join(x for i, x in enumerate(row[1].split("\n")) if i not in gone[key]) for key, row in enumerate(rows)
    }


def cosine_links(rows, least=0.98):
    import numpy as np

    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        u = np.array(v, float)
        if np.linalg.norm(u):
            good[i] = (label, len(v), u / np.linalg.norm(u))
    links = []
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= least:
                links.append((a, b))
    c = classes([r[0] for r in rows if r[0] is not None], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], c[i]) for i in c}


TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def leaks(docs, items, window=16, percent=80):
    """doc -> ids of the items that some window of it agrees with; every place of an item with every place of a text"""
    import numpy as np

    number = {}
    tok = lambda t: np.array([number.setdefault(x.lower() if x.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in x), len(number)) for x in TOKEN.findall((t or "").encode())], int)
    out = {}
    known = [(i, tok(t)) for i, t in items if t]
    for d, t in docs:
        text, found = tok(t), set()
        for i, item in known:
            size = min(window, len(item))
            n, m = len(text) - size + 1, len(item) - size + 1
            if not size or n <= 0:
                continue
            same = text[:, None] == item[None, :]
            total = sum(same[k : k + n, k : k + m].astype(int) for k in range(size))
            if 100 * total.max() >= percent * size:
                found.add(i)
        out[d] = sorted(found)
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


WEAK = (
    (3, re.compile(r"\b(?=[A-Z0-9]*[0-9])[A-Z][A-Z0-9]{11,31}\b", re.A)),
    (4, re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}")),
    (5, re.compile(r"\b(?:https?|postgres|mysql|redis|amqp|s3)://[^ \t\n\x0b\f\r\"'<>]+", re.I | re.A)),
)


def all_spans(text, scope=200):
    """Base spans and the weak ones that have their complements near, each pair compared."""
    base = base_spans(text)
    weak = [(m.start(), k, m.end()) for k, p in WEAK for m in p.finditer(text or "")]
    weak = [w for w in weak if all(w[2] <= b[0] or b[2] <= w[0] for b in base)]
    part = lambda k: 0 if k in (1, 3) else 2 if k == 5 else 1
    out = list(base)
    for w in weak:
        met = set()
        for o in base + weak:
            apart = o[0] >= w[2] or w[0] >= o[2]
            if apart and o[0] <= w[2] + scope and w[0] <= o[2] + scope and part(o[1]) != part(w[1]):
                met.add(part(o[1]))
        if met & {0, 1} if w[1] < 5 else met >= {0, 1}:
            out.append(w)
    return sorted(set(out))


def chat_windows(turns, budget=512, history=128):
    """The windows of one conversation of few turns in order: [(repeated system?, context turns, new turns)], by filling up."""
    size = [len(words(body)) + 2 for _, _, body in turns]
    system = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
    out, i = [], 0
    while i < len(turns):
        again = system is not None and turns[system] < turns[i]
        own = size[system] if again else 0
        room = budget - own - (history if i else 0)
        j, used = i + 1, size[i]
        while j < len(turns) and used + size[j] <= room:
            used += size[j]
            j += 1
        left, k = min(history, budget - own - used), i
        while k and size[k - 1] <= left:
            k -= 1
            left -= size[k]
        out.append((again, [t for t in turns[k:i] if system is None or t != turns[system]], turns[i:j]))
        i = j
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """source -> target by filling up in rounds"""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
            open_.discard(s)
    return out
