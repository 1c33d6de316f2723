"""Plain Python versions of the operators, straight from their contracts."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def groups(docs, size, p, q):
    """doc_id -> (set size, least id reachable)."""
    sets = {k: shingles(t, size) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and q * len(x & y) >= p * len(x | y):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {k: (len(s), find(k)) for k, s in sets.items()}


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, size=10):
    w = ALNUM.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for name, item in items:
        v = ALNUM.findall((item or "").translate(LOW))
        if name is None or not v:
            continue
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def word_hash(word):
    data, top = word.translate(LOW).encode(), (1 << 64) - 1
    x = (sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(data)) + len(data) * 0xD6E8FEB86659FD93) & top
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
    return x ^ (x >> 31)


def units(text, around=3, longest=64):
    """The units of a text, each a list of (word, start, end, line)."""
    words = [(m[0].translate(LOW), m.start(), m.end(), text.count("\n", 0, m.start())) for m in WORD.finditer(text)]
    h, out = [word_hash(w[0]) for w in words], []
    for i, w in enumerate(words):
        near = range(max(0, i - around), min(len(words), i + around + 1))
        least = all(h[i] < h[j] if j < i else h[i] <= h[j] for j in near)
        if not i or least or w[3] != words[i - 1][3] or len(out[-1]) == longest:
            out.append([])
        out[-1].append(w)
    return out


def repeats(docs, least, lines=False):
    """doc_id -> (start, end) of what goes: sequences of units of at least so many words, and whole lines, that occur earlier.

    Sequences of up to least units are enough, as longer ones are unions of these.
    """
    cut = {k: units(t or "") for k, t in docs}
    first, places = {}, {}
    for k in sorted(cut):
        for i in range(len(cut[k])):
            for j in range(i + 1, min(i + least, len(cut[k])) + 1):
                key = tuple(tuple(w[0] for w in u) for u in cut[k][i:j])
                if sum(map(len, key)) >= least and first.setdefault(key, (k, i)) != (k, i):
                    places.setdefault(k, set()).update(range(i, j))
        for line in sorted({u[0][3] for u in cut[k]}) if lines else ():
            at = [i for i, u in enumerate(cut[k]) if u[0][3] == line]
            key = ("line", *(w[0] for i in at for w in cut[k][i]))
            if first.setdefault(key, (k, line)) != (k, line):
                places.setdefault(k, set()).update(at)
    out = {}
    for k, us in cut.items():
        out[k], gone = [], places.get(k, set())
        for i in sorted(gone):
            last, nxt = us[i][-1], us[i + 1][0] if i + 1 < len(us) else None
            stop = nxt[1] if nxt and nxt[3] == last[3] else last[2]
            start = out[k].pop()[0] if i - 1 in gone else us[i][0][1]
            out[k].append((start, stop))
    return out


def runs(words, least=12):
    """(start, length, period) of all runs, by trying all periods."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q and i + q - s >= least:
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def run_row(doc_id, text):
    """What op11 returns of a document, without its id."""
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    return len(found), s, length, q, found and 1000 * length // q or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
