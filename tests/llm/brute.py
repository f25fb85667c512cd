"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter()
    for b in raw:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, kept))
    return out


def leaks(texts, items, window=13, share=20):
    """(n_words, n_hit, sorted items, contaminated) of each text; items are (id, text)."""
    wins = defaultdict(set)
    for item, text in items:
        if item is None:
            continue
        w = ALNUM.findall((text or "").translate(LOW))
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[i : i + k])].add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for text in texts:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = bytearray(len(w)), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (here := tuple(w[i : i + k])) in wins:
                    hit[i : i + k] = b"\1" * k
                    found |= wins[here]
        n = sum(hit)
        out.append((len(w), n, sorted(found), n > 0 and share * n >= len(w)))
    return out


def shingles(text, words):
    w = NON_SPACE.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def near_duplicates(rows, words, percent=80):
    """rows of (doc_id, text) -> {doc_id: (n_shingles, component)} over all pairs that share a shingle."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = Counter()
    for at in by.values():
        for a in range(len(at)):
            for b in range(a):
                common[at[b], at[a]] += 1
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def backoff(texts, order=2, min_count=1, factor=0.4):
    """(n_tokens, n_backoff, log_score) of each text."""
    from math import log

    tokens = [NON_SPACE.findall((t or "").translate(LOW)) for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in tokens for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, tokens))
    out = []
    for w in tokens:
        steps, score = 0, 0.0
        for i in range(len(w)):
            n, down = min(order, i + 1), 0
            while n > 1 and count[tuple(w[i - n + 1 : i + 1])] < min_count:
                n, down = n - 1, down + 1
            top = count[tuple(w[i - n + 1 : i + 1])]
            score += log(top / (total if n == 1 else count[tuple(w[i - n + 1 : i])])) + down * log(factor)
            steps += down
        out.append((len(w), steps, score if w else None))
    return out


def url(text, rules):
    """(host, path, rule, verdict or None)."""
    host = path = ""
    if text is not None and "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group().translate(LOW)
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def tree(text):
    """(root, [(branch, [leaf, ...]), ...]) with whole hashes, by the rules of the fingerprints."""
    from lodestar.llm import merkle

    ends = merkle.ENDS.replace(r"\n", "\n")
    word_ends = " \t\x0b\f\r,;:、，；："
    pieces = []
    for p in re.findall(f"[^{ends}]{{0,{merkle.WIDEST}}}[{ends}]+|[^{ends}]+", text):
        if len(p) > merkle.WIDEST and p[-1] not in ends:
            for q in re.sub(f"([{merkle.LAST}][{word_ends}]+)([{merkle.FIRST}])", "\\1\n\\2", p).split("\n"):
                pieces += [q[i : i + merkle.WIDEST] for i in range(0, len(q), merkle.WIDEST)]
        else:
            pieces.append(p)
    assert "".join(pieces) == text
    sections, own = [], []
    for p in pieces:
        own.append(sha(p.encode()))
        if own[-1][0] in merkle.CUTS:
            sections.append(own)
            own = []
    sections += [own] if own else []
    branches = [(sha(",".join(s).encode()), s) for s in sections]
    return sha(",".join(b for b, _ in branches).encode()), branches


def likeness(a, b):
    """Of two trees: 1 for equal roots, else shared leaves over all, sections with equal branches counting whole."""
    if a[0] == b[0]:
        return 1.0
    x, y = {h: s for h, s in a[1]}, {h: s for h, s in b[1]}
    same = sum(len(x[h]) for h in x.keys() & y.keys())
    u, v = ({leaf for h, s in p.items() if h not in q for leaf in s} for p, q in ((x, y), (y, x)))
    return (same + len(u & v)) / (same + len(u | v)) if same or u or v else 0.0


def aliases(edges):
    """{node: its component's smallest node} by union-find."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}
