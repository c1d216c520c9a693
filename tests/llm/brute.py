"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def decontaminated(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    met |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return out


def repeats_removed(docs, size=400):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(r[i : i + size] for _, r in raws for i in range(len(r) - size + 1))
    out = []
    for d, r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return out


def passages(docs, size=224, least=50):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(r[i : i + size] for _, r in raws for i in range(len(r) - size + 1))
    out = []
    for d, r in raws:
        runs = []
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + size
                else:
                    runs.append([i, i + size])
        out.append((d, tuple(f"{a}:{z}" for a, z in runs if len(r[a:z].split()) >= least)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in PII]


def shingles(text, size=5):
    w = BLANK_WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_duplicates(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    part = list(range(len(sets)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            same = len(a & b)
            if a and b and 100 * same >= percent * (len(a) + len(b) - same):
                part[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return [(d, len(s), least[root(i)] if s else d) for i, (d, s) in enumerate(sets)]


def quality(text):
    t = text or ""
    w = BLANK_WORD.findall(t)
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {p for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if BLANK_WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))


def kept_lines(docs, depth=3, min_tokens=3, min_docs=10, similar=0.7, frequent=5):
    """(doc, text) -> remaining text, by the template tree as its docstring tells it."""
    order = lambda k: (k[0] is not None, k[0] or 0)
    lines = []
    for key in set(docs):
        for i, x in enumerate(key[1].split("\n") if key[1] is not None else []):
            tokens = tuple(w for w in re.split(r"\s+", x.strip(" ")) if w)
            if len(tokens) >= min_tokens:
                tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in tokens)
            if tokens:
                lines.append((key, i, (len(tokens), tokens[:depth]), tokens))
    members = defaultdict(set)
    for _, _, leaf, tokens in lines:
        members[leaf].add(tokens)
    templates = {}
    for leaf, own in members.items():
        counts = [Counter(t[p] for t in own) for p in range(leaf[0])]
        for t in own:
            held = [counts[p][w] > 1 and frequent * counts[p][w] >= len(own) for p, w in enumerate(t)]
            general = len(t) >= min_tokens and sum(held) >= similar * len(t)
            templates[t] = " ".join(w if h or not general else "<*>" for w, h in zip(t, held))
    groups = defaultdict(list)
    for key, i, _, tokens in lines:
        groups[templates[tokens]].append((key, i))
    gone = defaultdict(set)
    for own in groups.values():
        texts = {k[1] for k, _ in own}
        if len(texts) >= min_docs:
            first = min((k for k, _ in own), key=order)[1]
            for key, i in own:
                if key[1] != first:
                    gone[key].add(i)
    return [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])) for d, t in docs]
