"""Plain versions of the operators, to hold the Spark results against."""
from __future__ import annotations

import collections
import hashlib
import re


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def pii_base(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def bag(text: str | None) -> collections.Counter:
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, int]:
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = bags[i], bags[j]
            if a and b and min(a.total(), b.total()) >= least * max(a.total(), b.total()):
                if (a & b).total() >= least * (a | b).total():
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


def repeats(rows: list[tuple[int, str | None]], n: int = 50) -> list[tuple]:
    texts = [(i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, b in texts:
        for k in range(len(b) - n + 1):
            first[b[k:k + n]] = min(first.get(b[k:k + n], i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if first[b[k:k + n]] < i:
                gone[k:k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)
