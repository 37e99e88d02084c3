"""Plain versions of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def repeats(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple[int, str | None]], n: int, percent: int) -> list[tuple[int, int, int, int]]:
    """id, set size, smallest id of the component, links."""
    sets = [shingles(t, n) for _, t in rows]
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[find(i)].append(k)
    return sorted((k, len(sets[i]), min(low[find(i)]), links[i]) for i, (k, _) in enumerate(rows))


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def quality_base(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    again = {k for i, g in enumerate(tri) if n[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def padding(lengths: list[int], buckets: int) -> int:
    """Least padding over all choices of bucket bounds."""
    from itertools import combinations

    values = sorted(set(lengths))
    best = None
    for k in range(min(buckets, len(values))):
        for inner in combinations(values[:-1], k):
            bounds = [*inner, values[-1]]
            total = sum(next(b for b in bounds if b >= x) - x for x in lengths)
            best = total if best is None else min(best, total)
    return best or 0


def url_tree(rows: list[tuple[str, str, str | None]], wide: int, enough: int, differs: float, prior: float, reject: float) -> dict[tuple[str, str], tuple[str, float, str]]:
    """(host, path) -> template, share, verdict. rows: host, path, verdict of a rule or None."""
    general = lambda path: tuple(re.sub(r"^(?=[^.]*[0-9])([^.])[^.]*", r"\1*", s) for s in (path[1:] if path[:1] == "/" else path).split("/"))
    count = defaultdict(lambda: [0, 0, 0])
    for h, p, v in rows:
        c = count[h, general(p)]
        c[0] += 1
        c[1] += v is not None
        c[2] += v == "block"
    where = dict.fromkeys(count, "")
    active = set(count)

    def test(k1, b1, k, b):
        k2, b2 = k - k1, b - b1
        if not k1 or not k2:
            return False
        p = b / k
        error = (p * (1 - p) * (1 / k1 + 1 / k2)) ** 0.5
        return error > 0 and abs(b1 / k1 - b2 / k2) > differs * error

    depth = 0
    while active:
        groups = defaultdict(list)
        for x in active:
            groups[x[0], where[x]].append(x)
        seg = {}
        for own in groups.values():
            values = {x[1][depth] for x in own}
            variable = len(values) > wide and 2 * len(values) > sum(count[x][0] for x in own)
            for x in own:
                s = x[1][depth]
                tail = re.search(r"[^.](\..*)?$", s)
                seg[x] = s[:1] + "*" + ((tail[1] or "") if tail else "") if variable and "*" not in s else s
        host, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for x in active:
            t = where[x]
            for table, keys in ((host, ((x[0], t, seg[x]), (x[0], t))), (every, ((t, seg[x]), (t,)))):
                for key in keys:
                    table[key][0] += count[x][1]
                    table[key][1] += count[x][2]
        new, going = {}, set()
        for (h, t), own in groups.items():
            for x in own:
                (k, b), (hk, hb) = host[h, t, seg[x]], host[h, t]
                named = test(k, b, hk, hb) if k >= enough and hk - k >= enough else test(*every[t, seg[x]], *every[t,])
                new[x] = f"{t}/{seg[x] if named else '*'}"
                if len(x[1]) > depth + 1:
                    if len(own) == 1:
                        new[x] += "/**"
                    else:
                        going.add(x)
        where.update(new)
        active, depth = going, depth + 1
    total = [sum(c[i] for c in count.values()) for i in range(3)]
    above = total[2] / max(total[1], 1)
    host, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for x, t in where.items():
        for c in (host[x[0], t], every[t]):
            c[0] += count[x][1]
            c[1] += count[x][2]
    out = {}
    for h, p, _ in rows:
        t = where[h, general(p)]
        (k, b), (gk, gb) = host[h, t], every[t]
        share = (b + prior * (gb + prior * above) / (gk + prior)) / (k + prior)
        out[h, p] = (t, share, "block" if share >= reject else "allow")
    return out
