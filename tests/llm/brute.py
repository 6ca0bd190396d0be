"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str) -> tuple:
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = Counter(s[3] for s in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))


def shingles(text: str, n: int = 5) -> frozenset:
    w = [x.translate(LOWER) for x in WORD.findall(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)}) if w else frozenset()


def components(texts: dict[int, str], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def dedup(texts: list[tuple[int, str]], span: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = t.encode()
        gone = [False] * len(b)
        for s in range(len(b) - span + 1):
            w = b[s : s + span]
            if w in seen:
                gone[s : s + span] = [True] * span
            seen.add(w)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def rules(text: str) -> tuple:
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    cover = {p for ks in places.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def leaks(texts: dict[int, str], items: dict[int, str], threshold: float = 0.75) -> dict[tuple[int, int], tuple[int, int]]:
    out = {}
    for i, t in texts.items():
        s = shingles(t)
        for j, x in items.items():
            q = shingles(x)
            if q and len(s & q) >= threshold * len(q):
                out[i, j] = (len(s & q), len(q))
    return out


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mix(rows: list[tuple]) -> dict:
    """doc_id: words taken, of (doc_id, source, text) rows; sources weigh 1, 2, 3 in turn, and targets stop at three times their size."""
    sized = [(i, s, len(WORD.findall(t or "")), int(hashlib.md5(f"0:{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)) for i, s, t in rows]
    own = defaultdict(int)
    for _, s, n, _ in sized:
        own[s] += n
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(own, key=lambda s: (s is None, s or "")))}
    open_, target, left = set(own), {}, float(sum(own.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * own[s]}
        target |= share if not over else {s: 3.0 * own[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    out = {}
    for s in own:
        budget, before = round(target[s]), 0
        whole, rest = divmod(budget, own[s]) if own[s] else (0, 0)
        for i, _, n, _ in sorted((x for x in sized if x[1] == s), key=lambda x: (x[3], x[0], x[2])):
            out[i] = whole * n + max(0, min(n, rest - before))
            before += n
    return out
