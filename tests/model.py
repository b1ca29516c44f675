"""The search engine once more as plain Python over dictionaries, written from its definition, to compare with."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict


def normalize(text: str | None) -> str:
    x = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not 0x300 <= ord(c) <= 0x36F).lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in x).split())


def tokens(text: str | None) -> list[str]:
    return re.findall("[a-z0-9]+|[㐀-鿿]|[^ ]+", normalize(text))


def compact(text: str | None) -> str:
    return normalize(text).replace(" ", "")


def ascii_join(text: str | None) -> str:
    return re.sub("[^a-z0-9]", "", normalize(text))


def units(token: str) -> int:
    return len(token.encode("utf-16-le")) // 2


def is_ascii(token: str) -> bool:
    return re.fullmatch("[a-z0-9]+", token) is not None


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def osa(a: str, b: str) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def deletions(term: str, most: int) -> list[str]:
    out: dict[str, None] = {}

    def walk(t: str, start: int, left: int) -> None:
        for i in range(start, len(t)):
            cut = t[:i] + t[i + 1 :]
            if cut:
                out.setdefault(cut)
            if left > 1:
                walk(cut, i, left - 1)

    walk(term, 0, most)
    return list(out)


def overlap(a: str, b: str) -> float:
    if len(a) < 2 or len(b) < 2:
        return float(a[:1] == b[:1])
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return len(x & y) / max(len(x), len(y), 1)


class Model:
    """fields: (name, weight, kind); documents: dicts with id and the fields, in order."""

    def __init__(self, documents, fields, store=None, tags=None, fuzzy=True, cutoff=0.4):
        self.docs, self.fields, self.tags = documents, fields, tags
        self.store = store if store is not None else [f for f, _, _ in fields]
        top = max(w for _, w, _ in fields)
        raw, best = defaultdict(dict), defaultdict(float)
        for i, d in enumerate(documents):
            scores: dict[tuple[str, str], float] = defaultdict(float)
            for name, w, kind in fields:
                self._field(scores, d.get(name), w, kind)
            for t in self._tags(d):
                self._field(scores, t, 120, "keyword")
            for f, s in scores.items():
                raw[f][i] = math.floor(min(s, 65535))
                best[f] = max(best[f], min(s, 65535))
        n = len(documents)
        cap, join_cap = math.floor(n * cutoff), max(16, math.floor(n * min(cutoff, 0.08)))
        self.postings = {f: p for f, p in raw.items() if not (f[0] in "phg" and len(p) > cap) and not (f[0] == "j" and len(p) > join_cap)}
        self.deletes = defaultdict(list)
        for f in sorted(self.postings):
            if fuzzy and f[0] in "es" and re.fullmatch("[a-z0-9]{3,14}", f[1]) and best[f] >= top:
                for x in deletions(f[1], 2 if len(f[1]) >= 6 else 1):
                    if x != f[1]:
                        self.deletes[x].append(f)
        self.signal, self.gate = [], []
        for d in documents:
            said = " ".join(d.get(f) or "" for f, _, k in fields if k != "url")
            c, a = compact(said)[:2048], ascii_join(said)[:2048]
            a = a or c
            more = " ".join([*(d.get(f) or "" for f in self.store), *self._tags(d)])
            self.signal.append((c, a))
            self.gate.append((compact(f"{c} {more}"), ascii_join(f"{a} {more}")))

    def _tags(self, d) -> list[str]:
        t = d.get(self.tags) if self.tags else None
        return [x or "" for x in t] if isinstance(t, list) else [t] if t else []

    def _field(self, scores, text, w, kind) -> None:
        own = tokens(text)
        if not own:
            return
        joined, whole = "".join(t for t in own if is_ascii(t)), "".join(own)
        for t in own:
            if units(t) >= 2:
                scores["e", t] += w
                if is_ascii(t):
                    for k in range(2, min(4, len(t)) + 1):
                        scores["p", t[:k]] += max(6, half_up(w * 0.4))
        if kind != "url":
            if 3 <= len(joined) <= 32:
                scores["s", joined] += half_up(w * 1.28)
                for k in range(2, min(4, len(joined)) + 1):
                    scores["p", joined[:k]] += max(6, half_up(w * 0.56))
                if len(joined) <= 12:
                    for i in range(len(joined) - 1):
                        scores["g", joined[i : i + 2]] += max(4, half_up(w * 0.16))
            if 3 <= len(whole) <= 32:
                scores["j", whole] += half_up(w * 1.08)
            han = lambda t: re.fullmatch("[㐀-鿿]", t)
            for pair in {a + b for a, b in zip(own, own[1:]) if han(a) and han(b)}:
                scores["h", pair] += max(4, half_up(w * 0.22))
        seen = set()
        for i in range(len(own)):
            for width in (1, 2, 3):
                part = own[i : i + width]
                x = "".join(part)
                if len(part) < width or not 3 <= len(x) <= 12 or x in seen:
                    continue
                seen.add(x)
                if width > 1 and len(x) >= 5 and all(units(t) >= 2 for t in part[1:]):
                    scores["j", x] += max(8, half_up(w * (1.02 - 0.16 * (width - 1))))

    def near(self, term: str):
        """Accepted (feature, distance) in order, and the correction."""
        if len(term) < 3:
            return [], None
        visited, found = set(), []
        for x in [term, *deletions(term, 2 if len(term) >= 6 else 1)]:
            for f in self.deletes.get(x, []):
                if f in visited or len(found) == 12:
                    continue
                visited.add(f)
                t = f[1]
                if abs(len(t) - len(term)) <= 2 and t[0] == term[0] and overlap(t, term) >= 0.34 and (n := osa(term, t)) <= (2 if len(t) > 6 else 1):
                    found.append((f, n))
        best = min(enumerate(found), key=lambda x: (x[1][1], -len(self.postings[x[1][0]]), x[0]), default=None)
        return found, (term, best[1][0][1], best[1][1]) if best else None

    def search(self, query: str, limit=10, ratio=0.18):
        """([(id, score)], corrections)."""
        query = query.strip()
        own = tokens(query)
        if units(query) < 2 or not own:
            return [], []
        c, a = compact(query), ascii_join(query)
        long = [t for t in own if units(t) >= 2]
        terms = list(dict.fromkeys(long))
        total, anchored, bits, first = defaultdict(int), set(), defaultdict(set), {}
        direct, order = 0, 0

        def fire(kind, term, mult, points=0, anchor=True, bit=None):
            nonlocal direct, order
            order += 1
            if (kind, term) in self.postings:
                direct += points
                for doc, s in self.postings[kind, term].items():
                    total[doc] += s * mult
                    first.setdefault(doc, order)
                    if anchor:
                        anchored.add(doc)
                    if bit is not None and bit < 31:
                        bits[doc].add(bit)

        for t in long:
            fire("e", t, 100, 2, bit=terms.index(t))
            fire("p", t, 72, 1, bit=terms.index(t))
        if len(c) >= 3:
            fire("j", c, 110, 1)
        if len(a) >= 3:
            fire("s", a, 125, 2)
            fire("p", a, 88, 1)
            fire("j", a, 108, 1)
        strong = [*terms, *([c] if len(c) >= 2 else []), *([a] if len(a) >= 3 and a != c else [])]
        corrections = []
        if direct < 2:
            if 2 <= len(c) <= 24:
                for i in range(len(c) - 1):
                    fire("g", c[i : i + 2], 17, anchor=False)
                    fire("h", c[i : i + 2], 28, anchor=False)
            if len(a) >= 3:
                for i in range(len(a) - 1):
                    fire("g", a[i : i + 2], 22, anchor=False)
            last = next((t for t in reversed(own) if is_ascii(t)), None)
            for term in [a or c, *([last] if last and last != a else [])]:
                found, best = self.near(term)
                for f, n in found:
                    fire(*f, 64 if n == 1 else 42)
                    strong.append(f[1])
                if best:
                    corrections.append(best)
        scored = []
        for doc, e2 in total.items():
            sc, sa = self.signal[doc]
            if doc not in anchored and not any(x in self.gate[doc][0] or x in self.gate[doc][1] for x in strong):
                continue
            e2 += (10_000 if len(c) >= 3 and c in sc else 0) + (12_500 if len(a) >= 3 and a in sa else 0)
            n, covered = len(terms), sum(i in bits[doc] or t in sc or t in sa for i, t in enumerate(terms))
            if len(own) <= 1 or n < 2:
                e4 = e2 * 100
            elif covered == n:
                e4 = e2 * 160 + 2_000_000
            elif n >= 3 and covered >= n - 1:
                e4 = e2 * 118 + 600_000
            elif covered == 0:
                e4 = e2 * 40
            elif n >= 3 and covered == 1:
                e4 = e2 * 70
            else:
                e4 = e2 * 100
            scored.append((-e4, first[doc], doc))
        hits = [(doc, (50 - e4) // 100 / 100) for e4, _, doc in sorted(scored)[: max(3 * limit, 24)]]
        hits = [h for i, h in enumerate(hits) if i == 0 or h[1] >= max(0, hits[0][1] * ratio)][:limit]
        return [(self.docs[doc]["id"], score) for doc, score in hits], corrections

    def suggest(self, prefix: str, limit=8, fuzzy=True):
        p = prefix.strip().lower()
        if not is_ascii(p):
            return []
        terms = {f[1]: len(d) for f, d in self.postings.items() if f[0] == "e"}
        found = sorted((t != p, -n, len(t), t) for t, n in terms.items() if t.startswith(p))
        if found or not fuzzy or len(p) < 3:
            return [(t, -n, "prefix", None) for _, n, _, t in found[:limit]]
        near = []
        for t, n in terms.items():
            if t[0] == p[0] and len(t) >= len(p) - 1:
                d = min(osa(t[: len(p)], p), osa(t[: len(p) + 1], p))
                if d <= (2 if len(p) >= 6 else 1):
                    near.append((d, -n, t))
        return [(t, -n, "fuzzy", d) for d, n, t in sorted(near)[:limit]]
