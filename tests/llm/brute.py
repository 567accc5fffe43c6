"""Plain Python versions of the query contracts."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - (9 if d > 4 else 0)
        total += d
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
]
SECRETS = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 12,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
]


def spans(text, rules):
    """``(start, rank, end)`` of the base spans."""
    out = []
    for rank, (_, pattern, good) in enumerate(rules):
        out += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text or "") if good(m)]
    return sorted(out)


def joined(found, rules):
    return ",".join(f"{rules[r][0]}:{s}:{e}" for s, r, e in sorted(found))


def base_row(text, rules):
    found = spans(text, rules)
    return tuple(sum(r == i for _, r, _ in found) for i in range(len(rules))), hashlib.sha256(joined(found, rules).encode()).hexdigest(), set(joined(found, rules).split(",")) - {""}


def shingles(text, width=5):
    w = WORD.findall(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def grouped(sets):
    """Smallest reachable id of every id."""
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def quality_counts(text):
    w = WORD.findall(text or "")
    n = len(w)
    places = {}
    for i in range(n - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed
