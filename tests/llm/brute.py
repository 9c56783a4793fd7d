"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WHITE = " \t\n\v\f\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def exact_groups(rows):
    """Result rows of the exact dedup, in the order of ``rows`` (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        _, null, keep = min(groups[body])
        keep = None if null else keep
        out.append((doc_id, keep, len(groups[body]), doc_id == keep, hashlib.sha256(body.encode()).hexdigest()))
    return out


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def similar_components(rows):
    """{doc_id: (n_shingles, component)} of rows with different ids, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_lines(a, b, edits):
    """Whether the edit distance is small; an edit changes the counts of two characters at most."""
    if abs(len(a) - len(b)) > edits:
        return False
    x, y = Counter(a), Counter(b)
    return (x - y).total() + (y - x).total() <= 2 * edits and edit_distance(a, b) <= edits


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_lines(rows, edits=2, near_chars=20):
    """{doc_id: [(line, of_doc, of_line, exact)]} of rows with different ids; lines of ``near_chars``
    characters or more are compared with edits."""
    first, places = {}, []
    for doc_id, text in sorted(rows):
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(WHITE)
            if line:
                places.append((doc_id, n, line))
                first.setdefault(line, (doc_id, n))
    out = defaultdict(list)
    for doc_id, n, line in places:
        near = [x for x in first if x != line and len(x) >= near_chars and near_lines(x, line, edits)] if len(line) >= near_chars else []
        earlier = [(first[x], x == line) for x in [line, *near]]
        earlier = [e for e in earlier if e[0] < (first[line] if not e[1] else (doc_id, n))]
        if earlier:
            (of_doc, of_line), exact = min(earlier)
            out[doc_id].append((n, of_doc, of_line, exact))
    return out


def without_repeats(texts, width=200):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        rest = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def hard_negatives(rows):
    """Result rows of the hard negatives; rows are (vec_id, label, vector)."""
    found = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        found[(vec_id, label, tuple(math.floor(256 * Fraction(x)) for x in vector))] = None

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    out = []
    for a in [r for r in found if r[0] % 50 == 0]:
        others = [(-score(a, r), r[0], r[1]) for r in found if r[0] != a[0]]
        wrong = sorted(r for r in others if r[2] != a[1])
        for p, positive, _ in sorted(r for r in others if r[2] == a[1])[:5]:
            fits = [(n, vec_id) for n, vec_id, _ in wrong if 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a[0], positive, k, vec_id, -p, -n) for k, (n, vec_id) in enumerate(fits, 1)]
    return sorted(out)


def damaged_conversations(rows):
    """{conv_id: rows (turn, role, text) in order} after the damage; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(held, key=order) for conv, held in out.items()}


# What a turn makes of the state of a repaired conversation: nothing yet, behind system, user, assistant.
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of ordered rows."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(found, state, option):
        if state not in found or option < found[state]:
            found[state] = option

    def with_inserts(found):
        for _ in range(4):
            for state, (cost, audit, made) in list(found.items()):
                for turn in "ua":
                    if (state, turn) in STEPS:
                        offer(found, STEPS[state, turn], (cost + 2, audit + "I", (*made, {"u": "user:", "a": "assistant:"}[turn])))
        return found

    best = with_inserts(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, made) in best.items():
            offer(after, state, (cost + 3, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (state, role[:1]) in STEPS:
                offer(after, STEPS[state, role[:1]], (cost + extra, audit + "K", (*made, f"{role}:{text}")))
            for turn, name in (("u", "user"), ("a", "assistant")):
                if (state, turn) in STEPS:
                    offer(after, STEPS[state, turn], (cost + 2 + extra, audit + "R", (*made, f"{name}:{text}")))
        best = with_inserts(after)
    cost, audit, made = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()
