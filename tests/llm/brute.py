"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    t = text or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, r = len(words), len(covered)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": r, "base_failed": n < 20 or 100 * r > 30 * n}


def targets(sizes):
    """source -> target, from source -> size."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        if not free:
            return {s: 2.0 * sizes[s] for s in order}
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def shingles(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def components(rows, n=3, percent=90):
    """doc_id -> (set size, component), comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    by, parent = defaultdict(list), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in by[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def topk(rows, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in good:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def base_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{s}:{e}" for s, k, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def candidate_parts(text, base, pattern, least):
    """Parts of the runs of key characters that no base span covers, character by character."""
    covered = {i for s, _, e in base for i in range(s, e)}
    out = []
    for m in re.finditer(pattern, text, re.A):
        at = None
        for i in range(m.start(), m.end() + 1):
            free = i < m.end() and i not in covered
            if free and at is None:
                at = i
            if not free and at is not None:
                if i - at >= least:
                    out.append((at, i))
                at = None
    return out


def redacted(text, spans):
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], ("[ASSIGN]", "[ACCESS]", "[HEX]", "[RANDOM]")[k]]
        at = max(at, e)
    return "".join(out) + text[at:]


def battery(candidate, given):
    """The step of a candidate; constants and the table of letter pairs come from the module under test."""
    s = candidate.rstrip("=")
    if len(s) < 20:
        return 0
    core = re.sub("[^0-9A-Za-z]+", "", s)
    n, codes = len(s), [ord(c) for c in s]
    fits = [(10, "[0-9]+"), (16, "[0-9a-f]+|[0-9A-F]+"), (26, "[a-z]+|[A-Z]+"), (32, "[A-Z2-7]+"), (36, "[0-9a-z]+|[0-9A-Z]+"), (52, "[A-Za-z]+"), (62, "[0-9A-Za-z]+")]
    k = next((k for k, p in fits if re.fullmatch(p, s)), 64)
    kinds = [len(re.findall(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]")]
    runs, c, squares = len(re.findall("[a-z]+|[A-Z]+|[0-9]+", core)), sum(kinds), sum(x * x for x in kinds)
    sq = sum(x * x for x in Counter(s).values())
    even = (k / n * sq - n - (k - 1)) / math.sqrt(2 * (k - 1))
    mean = sum(codes) / n
    var = sum((x - mean) ** 2 for x in codes)
    serial = sum((codes[i] - mean) * (codes[(i + 1) % n] - mean) for i in range(n)) / var if var > 0 else 1.0
    few = (1 + (c * c - squares) / max(c, 1) - runs) / math.sqrt(max(c, 1) / 4)
    if not (even <= given.REJECT and abs(serial) <= given.REJECT / math.sqrt(n) and few <= given.REJECT and k > 10):
        return 0
    tail = lambda z: 0.5 * math.exp(-z * z / 2) if z > 0 else 1.0
    pairs, agree = n * (n - 1) / 2, (sq - n) / 2
    spread = math.sqrt(pairs * given.TEXT_MATCH * (1 - given.TEXT_MATCH) + n * (n - 1) * (n - 2) * given.TEXT_TRIPLE)
    low = s.lower()
    evidence = sum((ord(given.PAIRS[26 * (ord(a) - 97) + ord(b) - 97]) - ord("q")) / 5 for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z")
    p_pairs = min(math.exp(-evidence), 1.0) * (given.TEXT_DIGIT ** kinds[2] if k == 32 else 1.0)
    use = given.TEXT_HEX**n if k == 16 else min(2 * min(tail((pairs * given.TEXT_MATCH - agree) / spread), p_pairs), 1.0)
    p_runs = tail((runs - 1 - (c - 1) * given.TEXT_CHANGE) / math.sqrt(max(c - 1, 1) * given.TEXT_CHANGE * (1 - given.TEXT_CHANGE)))
    both = max(use * p_runs, 1e-300)
    p = max(use, 1e-300) if squares == c * c else min(both * (1 - math.log(both)), 1.0)
    return min(math.floor(-10 * math.log10(p)), given.STEPS)


def accepted(steps, fdr):
    """stratum -> least accepted step: the largest rank r of the ascending p-values with p <= fdr * r / m."""
    out = {}
    for stratum in {s for s, _ in steps}:
        p = sorted(10 ** (-step / 10) if step else 1.0 for s, step in steps if s == stratum)
        ranks = [r for r in range(1, len(p) + 1) if p[r - 1] <= fdr * r / len(p)]
        if ranks:
            out[stratum] = round(-10 * math.log10(p[ranks[-1] - 1]))
    return out


def symbols4(text):
    """Start marks, characters (white space as one space, digits as 0, beyond 16 bits as one) and an end mark."""
    words = (text or "").split()
    if not words:
        return []
    one = lambda c: "0" if "0" <= c <= "9" else "\ufffd" if ord(c) > 0xFFFF else c
    return ["\x02"] * 3 + [one(c) for c in " ".join(words)] + ["\x03"]


def kneser_ney(texts):
    """Count tables by order, discounts and the number of symbols: modified Kneser-Ney over four symbols."""
    counts = {4: Counter()}
    for t in texts:
        s = symbols4(t)
        counts[4].update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    context, discount = {}, {}
    for k, table in counts.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        discount[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2, 0.05), i) for i in (1, 2, 3)]
        of = defaultdict(lambda: [0, 0.0])
        for g, c in table.items():
            of[g[:-1]][0] += c
            of[g[:-1]][1] += discount[k][min(c, 3) - 1]
        context[k] = of
    return counts, context, discount


def cross_entropy(text, counts, context, discount):
    """Symbols and bits of a text."""
    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k = len(g)
        total, mass = context[k].get(g[:-1], (0, 0.0))
        if not total:
            return p(g[1:])
        c = counts[k].get(g, 0)
        return (max(c - discount[k][min(c, 3) - 1], 0) / total if c else 0) + mass / total * p(g[1:])

    s = symbols4(text)
    return max(len(s) - 3, 0), -sum(math.log2(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3))
