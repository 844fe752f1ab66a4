"""Plain versions of the corpus operators, for small inputs. Documents are rows with doc_id, text, source."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def covered(items, window, earlier):
    """Flags of the items inside windows for which earlier(window) holds."""
    gone = [False] * len(items)
    for i in range(len(items) - window + 1):
        if earlier(items[i : i + window], i):
            gone[i : i + window] = [True] * window
    return gone


def repeated_words(docs, window):
    """Flags of removed words for each row, in the order of docs."""
    first = {}
    for d in docs:
        w = words(d.text)
        for i in range(len(w) - window + 1):
            if d.doc_id is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, d.doc_id), d.doc_id)
    out = []
    for d in docs:
        later = lambda x, _, d=d: d.doc_id is not None and first[tuple(x)] < d.doc_id
        out.append(covered(words(d.text), window, later))
    return out


def repeated_bytes(docs, window):
    first = {}
    for d in docs:
        x = (d.text or "").encode()
        for i in range(len(x) - window + 1):
            if d.doc_id is not None:
                key, place = x[i : i + window], (d.doc_id, i)
                first[key] = min(first.get(key, place), place)
    out = []
    for d in docs:
        later = lambda x, i, d=d: d.doc_id is not None and first[x] < (d.doc_id, i)
        out.append(covered((d.text or "").encode(), window, later))
    return out


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard_classes(docs, size=5):
    """For each row: (class, links, shingles)."""
    owner, texts = {}, defaultdict(set)
    for d in docs:
        s = shingles(d.text, size)
        if s and d.doc_id is not None:
            owner[s] = min(owner.get(s, d.doc_id), d.doc_id)
            texts[s].add(d.text)
    parent = {i: i for i in owner.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    sets = list(owner)
    for k, a in enumerate(sets):
        for b in sets[:k]:
            shared = len(a & b)
            if 5 * shared >= 4 * (len(a) + len(b) - shared) and owner[a] != owner[b]:
                links[a] += len(texts[b])
                links[b] += len(texts[a])
                x, y = find(owner[a]), find(owner[b])
                parent[max(x, y)] = min(x, y)
    out = []
    for d in docs:
        s = shingles(d.text, size)
        if d.doc_id is None:
            out.append((None, 0, len(s)))
        else:
            out.append((find(owner[s]) if s else d.doc_id, links[s] + len(texts[s]) - 1 if s else 0, len(s)))
    return out


def quality(docs, share=0.01, least_docs=10):
    """For each row: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    hosts = Counter(host for host, _ in {(d.source or "", d.text) for d in docs})
    found = defaultdict(dict)
    rows = []
    for d in docs:
        text = d.text or ""
        w = words(text)
        counts = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = covered(w, 3, lambda x, _: counts[tuple(x)] > 1)
        lines = [line for line in text.split("\n") if words(line)]
        own = Counter()
        for line in lines:
            own[b" ".join(words(line)).translate(LOWER)] += len(words(line))
        for line in own:
            old = found[d.source or "", line].get(text)
            ids = [i for i in (old, d.doc_id) if i is not None]
            found[d.source or "", line][text] = min(ids) if ids else None
        failed = len(w) < 50 or 100 * sum(inside) > 50 * len(w)
        base = len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
        rows.append((d, own, (*base, sum(inside), failed)))
    out = []
    for d, own, base in rows:
        lost = 0
        for line, n in own.items():
            texts = found[d.source or "", line]
            if len(texts) >= least_docs and len(texts) > share * hosts[d.source or ""]:
                ids = [i for i in texts.values() if i is not None]
                lost += n * (not ids or d.doc_id is None or d.doc_id > min(ids))
        out.append((*base, not base[-1] and base[0] - lost >= 0.5 * base[0]))
    return out


def contamination(docs, items, window=10):
    """For each row: (n_words, n_hit, n_items, items_sha256, contaminated)."""
    wanted = defaultdict(set)
    for item in items:
        w = BENCH_WORD.findall((item.text or "").encode().translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[i : i + window])].add(item.item_id)
    out = []
    for d in docs:
        w = BENCH_WORD.findall((d.text or "").encode().translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in wanted}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[tuple(w[i : i + size])]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def cut(text, gone):
    """A text without the flagged words: kept runs as they were written, joined by line breaks; None if nothing is left."""
    spans = [m.span() for m in WORD.finditer((text or "").encode())]
    kept, data = [], (text or "").encode()
    for k, (a, b) in enumerate(spans):
        if not gone[k]:
            if kept and k and not gone[k - 1]:
                kept[-1] = (kept[-1][0], b)
            else:
                kept.append((a, b))
    if not kept:
        return None
    return text if not any(gone) else b"\n".join(data[a:b] for a, b in kept).decode()


def forest_components(docs, percent=85, size=5):
    """For each row: (shingles, component or None, kept)."""
    sets = [frozenset(tuple(x) for x in shingles((d.text or "").encode().translate(LOWER).decode(), size)) for d in docs]
    owner = {}
    for d, s in zip(docs, sets, strict=True):
        if s and d.doc_id is not None:
            owner[s] = min(owner.get(s, d.doc_id), d.doc_id)
    root = {s: s for s in owner}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    every = list(owner)
    for k, a in enumerate(every):
        for b in every[:k]:
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                x, y = find(a), find(b)
                if x is not y:
                    if owner[x] < owner[y]:
                        x, y = y, x
                    root[x] = y
    out = []
    for d, s in zip(docs, sets, strict=True):
        component = None if d.doc_id is None else owner[find(s)] if s else d.doc_id
        out.append((len(s), component, d.doc_id == component))
    return out


SPACES = " \t\n\x0b\x0c\r"


def repair(rows):
    """Figures of one conversation by trying every way of editing. rows: (turn, role, text)."""
    rows = sorted(
        ((turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows),
        key=lambda row: (row[0] is not None, row[0] or 0, row[1], row[2]),
    )
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {(0, "", ())}

    def inserted(ways):
        out = set(ways)
        for _ in range(2):
            ways = {(c + 5, a + "I", (*t, (role, ""))) for c, a, t in ways for role in ("user", "assistant")}
            out |= ways
        return {way for way in out if re.fullmatch("(s?(ua)*u?)", "".join(role[:1] for role, _ in way[2]))}

    ways = inserted(ways)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        further = set()
        for cost, audit, turns in ways:
            further.add((cost + 2, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if role[:1] in "sua" and role:
                    further.add((cost + extra, audit + "K", (*turns, (role, text))))
                for new in ("user", "assistant"):
                    further.add((cost + extra + 1, audit + "R", (*turns, (new, text))))
        ways = inserted(further)
    whole = [w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in w[2]))]
    cost, audit, turns = min(whole, key=lambda w: w[:2])
    numbers = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(kind) for kind in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in turns)))


def collocations(docs, least=10, most_words=3, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score). docs: rows with text and lang."""
    counts = defaultdict(Counter)
    for d in docs:
        text = (d.text or "").encode().translate(LOWER).decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, most_words + 1):
                for i in range(len(w) - size + 1):
                    counts["und" if d.lang is None else d.lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            cuts = [(1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = [
                b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            ]
            if not any(100 * b >= 50 * a for b in inside):
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


class _Reader(HTMLParser):
    """Words of a page in order, with nothing but a stack of open tags."""

    void = set("area base br col embed hr img input link meta param source track wbr".split())
    unseen = set("head title script style template noscript iframe noembed noframes object audio video canvas datalist area param rp".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        style = (attrs.get("style") or "").lower().replace(" ", "")
        hidden = tag in self.unseen or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style
        if tag not in ("b", "i", "a", "em", "strong", "span", "code"):
            self.out.append(" ")
        if tag not in self.void:
            self.stack.append((tag, hidden))

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span", "code"):
            self.out.append(" ")
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.stack):
            self.out.append(data)


def visible_words(source):
    reader = _Reader()
    reader.feed(source or "")
    reader.close()
    return "".join(reader.out).split()
