"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

from sigweave.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    w = WORD.findall(text or "")
    fives = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    marks = {p for k in range(len(w) - 4) if fives[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(marks),
        "n_upper": len(re.findall("[A-Z]", text or "")), "n_lines": len(lines), "n_stutter": sum(a == b for a, b in zip(w, w[1:])),
    }


def base_failed(m):
    return m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"]


def _bucket(v):
    n = 1 << quality.BITS
    octave = v.bit_length() - quality.BITS - 1
    return v if v < 2 * n else n * octave + (v >> octave)


def _value(b):
    n = 1 << quality.BITS
    return b if b < 2 * n else (n + b % n) << (b // n - 1)


def quality_kept(rows, prior=quality.PRIOR):
    """rows: (doc_id, text, lang, source). Whether each row is kept."""
    found = [measures(r[1]) for r in rows]
    groups = defaultdict(list)
    for r, m in zip(rows, found):
        if not base_failed(m) and m["n_lines"] and m["word_chars"]:
            for key in ((r[2], r[3]), (r[2],), ()):
                groups[key].append(m)

    def ends(key, name):
        scale, count, size = quality.FENCES[name][:3]
        b = sorted(_bucket(scale * m[count] // m[size]) for m in groups[key])
        at = lambda share: b[max(0, -(-len(b) * share // 1).__int__() - 1)]
        mid, low, high = at(0.5), at(0.25), at(0.75)
        return [float(x) for x in (_value(mid), _value(mid + 1) - 1, _value(low), _value(high + 1) - 1)]

    def fence(key, name):
        weights = [float(len(groups[k])) ** 2 for k in (key, key[:1])]
        own, lang, every = ends(key, name), ends(key[:1], name), ends((), name)
        p = float(prior) ** 2
        mid, mid_end, low, high_end = ((weights[0] * o + p * ((weights[1] * x + p * e) / (weights[1] + p))) / (weights[0] + p) for o, x, e in zip(own, lang, every))
        reach, least = quality.FENCES[name][3], mid / 128 + 1
        return mid - max(reach * (mid_end - low), least), mid + max(reach * (high_end - mid), least)

    fences = {key: {name: fence(key, name) for name in quality.FENCES} for key in groups if len(key) == 2}

    def kept(r, m):
        if base_failed(m):
            return False
        for name, (scale, count, size, _, spare, is_high, is_low) in quality.FENCES.items():
            low, high = fences[r[2], r[3]][name]
            if (is_high and scale * m[count] - scale * spare > high * m[size]) or (is_low and scale * m[count] + scale * spare < low * m[size]):
                return False
        return True

    return [kept(r, m) for r, m in zip(rows, found)]


def classes(texts):
    """{id: (set size, smallest linked id)} of (id, text)."""
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(texts, window=35):
    """(id, words, kept words) of (id, text)."""
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    for i, w in words:
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        yield i, w, [x for k, x in enumerate(w) if k not in gone]


def contamination(text, items, n=13):
    """(words, hit words, item ids) of a text; items: (id, text)."""
    w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    grams = {}
    for item, t in items:
        own = ALNUM.findall((t or "").translate(LOWER))
        size = min(n, len(own))
        if not size:
            continue
        if size not in grams:
            grams[size] = defaultdict(list)
            for k in range(len(w) - size + 1):
                grams[size][tuple(w[k : k + size])].append(k)
        for k in range(len(own) - size + 1):
            for at in grams[size].get(tuple(own[k : k + size]), ()):
                hit |= set(range(at, at + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
