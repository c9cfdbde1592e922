"""A plain version of the URL filter."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

A2Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return host.translate(A2Z), re.split("[?#]", rest[len(host) :])[0]


def ruled(host, path):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def judge(urls, order=4):
    """(host, path, rule, verdict, score) of each URL, and the threshold."""
    rows = [(u, *parts(u)) for u in urls]
    rows = [(u, h, p, *ruled(h, p), u is not None and int(hashlib.md5(u.encode()).hexdigest()[:6], 16) % 5 == 0) for u, h, p in rows]
    counts = {v: [Counter() for _ in range(order + 2)] for v in ("allow", "block")}  # of grams, by length
    kinds = {v: Counter() for v in counts}
    totals = {v: Counter() for v in counts}
    text = lambda u: "\x02" * order + (u or "") + "\x03"
    for u, _, _, _, v, out in rows:
        if v and not out:
            t = text(u)
            for i in range(order, len(t)):
                for k in range(1, order + 2):
                    gram = t[i - k + 1 : i + 1]
                    if not counts[v][k][gram]:
                        kinds[v][k, gram[:-1]] += 1
                    counts[v][k][gram] += 1
                    totals[v][k, gram[:-1]] += 1

    def chance(v, t, i):
        p = 1 / 256
        for k in range(1, order + 2):
            gram = t[i - k + 1 : i + 1]
            n, kind = totals[v][k, gram[:-1]], kinds[v][k, gram[:-1]]
            if n:
                p = (counts[v][k][gram] + kind * p) / (n + kind)
        return p

    scores = []
    for u, *_ in rows:
        t = text(u)
        scores.append(sum(round((math.log(chance("allow", t, i)) - math.log(chance("block", t, i))) * 1e6) for i in range(order, len(t))) / (len(t) - order))
    held = [(max(min(math.floor(s / 1e6 * 50), 1000), -1000), v == "allow") for s, (*_, v, out) in zip(scores, rows) if v and out]
    good, bad = sum(ok for _, ok in held), sum(not ok for _, ok in held)
    best = 0
    if good and bad:
        right = {a: round(sum(b >= a for b, ok in held if ok) / good + sum(b < a for b, ok in held if not ok) / bad, 12) for a in range(-1000, 1002)}
        best = min(right, key=lambda a: (-right[a], abs(a), a))
    limit = best / 50
    return [(h, p, rule, v or ("allow" if s / 1e6 >= limit else "block"), s / 1e6) for (u, h, p, rule, v, out), s in zip(rows, scores)], limit
