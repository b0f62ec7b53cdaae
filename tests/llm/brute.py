"""Plain versions of the contracts, for small tables."""

import collections
import hashlib
import math
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, sha256) of each row, and the number of rows that stay."""
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        out += [(m[3], keep, len(members), sha(norm)) for m in members]
    return out, len(groups)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").translate(UPPER))
        size = min(13, len(words))
        for at in range(len(words) - size + 1) if words else ():
            if item is not None:
                windows[tuple(words[at : at + size])].add(str(item))
            else:
                windows[tuple(words[at : at + size])] |= set()
    out = []
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(UPPER))
        hit, met = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if (w := tuple(words[at : at + size])) in windows:
                    met |= windows[w]
                    hit.update(range(at, at + size))
        out.append((doc_id, len(words), len(hit), tuple(sorted(met)), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def near(rows, size=4, percent=85):
    """(doc_id, set size, component) of each row, by comparing all pairs of different sets."""
    sets = []
    for _, text in rows:
        words = [w for w in SPACE.split((text or "").translate(UPPER)) if w]
        sets.append(frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    first = {}
    for a, s in enumerate(sets):
        if s:
            parent[find(a)] = find(first.setdefault(s, a))
    kinds = sorted(first.values(), key=lambda k: len(sets[k]))
    for at, a in enumerate(kinds):
        for b in kinds[at + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(rows[k][0], len(sets[k]), least.get(find(k), rows[k][0])) for k in range(len(rows))]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def entropy_spans(text, module):
    """Entropy spans of a text: every window of a candidate that no base span touches, counted afresh."""
    text, out = text or "", []
    base = secrets(text)
    for m in re.finditer(module.CANDIDATE, text):
        run, a, e = m[0], m.start(), m.end()
        if any(s < e and t > a for s, _, t in base) or any(re.search(p, run) for p in module.ALLOW):
            continue
        least = next((bits for _, whole, has, bits in module.CLASSES if re.search(whole, run) and re.search(has, run)), None)
        if least is None:
            continue
        hot = []
        for k in range(len(run) - module.WINDOW + 1):
            counts = collections.Counter(run[k : k + module.WINDOW]).values()
            if math.log2(module.WINDOW) - sum(c * math.log2(c) for c in counts) / module.WINDOW >= least:
                hot.append(k)
        if hot:
            out.append((a + hot[0], 3, a + hot[-1] + module.WINDOW))
    return out
