"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def secrets(text):
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def personal(text):
    text = text or ""

    def good(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(part) <= 255 for part in match.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 9 <= len(digits) <= 15

    order = list(PERSONAL)
    spans = [(k, *m.span()) for k, p in PERSONAL.items() for m in re.finditer(p, text) if good(k, m[0])]
    return sorted(spans, key=lambda s: (s[1], order.index(s[0])))


def without_repeats(texts):
    """(doc_id, text) -> doc_id: bytes, mark of each byte."""
    seen, out = set(), {}
    for doc, text in sorted(texts):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(window)
        out[doc] = data, bytes(mark)
    return out


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    words = (text or "").encode().translate(UPPER).split()
    if 0 < len(words) < 5:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(texts):
    sets = {doc: shingle_set(text) for doc, text in texts}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    return {doc: len(s) for doc, s in sets.items()}, roots(sets, links)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged_words(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def word_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q - start), q)
    return sorted((s, size, q) for (s, size), q in found.items())


def collapse(words):
    """The columns of the periodic runs after doc_id."""
    runs = sorted(word_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    line = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), sha(line), sha(left))


def digest_ids(ids):
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def damaged_rows(rows):
    """(conv_id, turn, role, text) -> conv_id: rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        name = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(":".join(name).encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if fate == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def cheapest_edits(symbols):
    """Cost and letters by trying every edit; symbols are (initial, fault)."""
    following = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = {s: (0, "") if s in (0, 3) else None for s in range(4)}

    def put_in(best):
        for _ in range(3):
            for s in range(4):
                for role in "ua":
                    to = best.get(following[s].get(role))
                    if to is not None and (best[s] is None or (to[0] + 5, "I" + to[1]) < best[s]):
                        best[s] = (to[0] + 5, "I" + to[1])
        return best

    best = put_in(best)
    for initial, fault in reversed(symbols):
        new = {}
        for s in range(4):
            ways = [(best[s][0] + 2, "D" + best[s][1])] if best[s] else []
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for letter, role, cost in (("K", initial, 0), ("R", "u", 1), ("R", "a", 1)):
                    to = best.get(following[s].get(role))
                    if to is not None:
                        ways.append((to[0] + cost + extra, letter + to[1]))
            new[s] = min(ways, default=None)
        best = put_in(new)
    return best[0]


def repaired(rows):
    """The columns of the conversation repair after conv_id, for rows in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else ""
        faults.append(fault or ("" if shown[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest_edits(list(zip(initials, faults)))
    out, state, left = [], "", iter(rows)
    for letter in audit:
        if letter == "D":
            next(left)
            continue
        role, text = (None, "") if letter == "I" else next(left)[1:]
        if letter != "K":
            role = "assistant" if state == "u" else "user"
        state = role[:1]
        out.append(f"{role}:{text}")
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, sha("\n".join(out))
