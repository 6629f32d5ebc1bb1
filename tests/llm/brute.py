"""Plain one-by-one versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def jaccard_components(rows, k, percent):
    """rows: (doc_id, text); place to the least doc_id of its component."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and 100 * common >= percent * (len(x) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(len(x), least.get(find(i)) if x else rows[i][0]) for i, x in enumerate(sets)]


def quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    marked = [False] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            marked[i : i + 5] = [True] * 5
    n, repeat = len(w), sum(marked)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, n < 10 or 100 * repeat > 20 * n


SECRETS = (
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12),
    ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 18),
    ("hex", re.compile(r"([0-9a-f]+)"), 16),
)


def secrets(text):
    found = []
    for order, (kind, pattern, least) in enumerate(SECRETS):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[1]) >= least]
    return [x[2] for x in sorted(found)]


def without_repeats(texts, width):
    ws = [words(t) for t in texts]
    c = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if c[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def keepers(rows):
    """rows: (doc_id, text); of equal texts the largest doc_id, and the group's size."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return {t: (max((d for d in ds if d is not None), default=None), len(ds)) for t, ds in groups.items()}


def _low(v):
    """A sketch's value of v: the least of its bucket."""
    if v < 32:
        return v
    drop = v.bit_length() - 4
    return v >> drop << drop


def _fence(values, slack):
    values = sorted(map(_low, values))
    q = lambda p: values[-(-len(values) * p // 100) - 1]
    return min(q(95) + slack + 2 * (q(95) - q(75)), q(25) + 2 * slack + 12 * (q(25) - q(5)))


def kept_by_quality(rows):
    """rows: (doc_id, text, lang, source, ...); doc_id to the verdict by limits from each group, its language and all."""
    measured = {}
    for d, t, lang, source, *_ in rows:
        n, chars, symbols, dup, repeat, failed = quality(t)
        lines = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        upper = len(re.findall("[A-Z]", t or ""))
        measured[d] = (lang, source, failed, [symbols * 1000 // max(chars, 1), upper * 1000 // max(chars, 1), dup * 1000 // max(lines, 1), repeat * 1000 // max(n, 1)])
    out = {}
    for d, (lang, source, failed, m) in measured.items():
        good = not failed
        for k, slack in enumerate((20, 40, 150, 90)) if good else ():
            sound = [x for x in measured.values() if not x[2]]
            one = [x[3][k] for x in sound if x[:2] == (lang, source)]
            two = [x[3][k] for x in sound if x[0] == lang]
            three = [x[3][k] for x in sound]
            around = (len(two) * _fence(two, slack) + 50 * _fence(three, slack)) // (len(two) + 50)
            good = good and m[k] <= (len(one) * _fence(one, slack) + 50 * around) // (len(one) + 50)
        out[d] = good
    return out


def grouped(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    return by.items()


def mixed(sizes, block_rows, temperature):
    """(source, block, rows) in the order of an earliest-deadline-first schedule: slot by slot, the released block due first."""
    from fractions import Fraction

    weight = {s: Fraction(n**temperature) for s, n in sizes}
    total = sum(weight.values())
    share = {s: weight[s] / total for s in weight}
    left = {s: -(-n // block_rows) for s, n in sizes}
    done, out, t = Counter(), [], 0
    rows = dict(sizes)
    while any(done[s] < left[s] for s in left):
        ready = [(-(-(done[s] + 1) // share[s]), i, s) for i, s in enumerate(sorted(left)) if done[s] < left[s] and done[s] // share[s] <= t]
        if ready:
            s = min(ready)[2]
            out.append((s, done[s], min(block_rows, rows[s] - done[s] * block_rows)))
            done[s] += 1
        t += 1
    return out
