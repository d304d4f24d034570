"""Plain Python versions of the operators, for small tables."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- tokens ----------------------------------------------------------------

def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(str(public_tokenizers.path(name)))


def ids(tok, text, end=2):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def pieces(tok, text, capacity=1024):
    x = ids(tok, text)
    cuts = [0, *range((len(x) - 1) % capacity + 1, len(x) + 1, capacity)]
    return [(k, s, e - s, zlib.crc32(x[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]


def section_counts(spans, sections, rule):
    """Token by token, section by section."""
    out = [0] * len(sections)
    for s, e in spans:
        shared = [max(0, min(e, b) - max(s, a)) for a, b in sections]
        if sum(shared):
            own = shared.index(max(shared)) if rule == "largest" else next(i for i, x in enumerate(shared) if x)
            if rule == "split":
                out = [o + x / sum(shared) for o, x in zip(out, shared)]
            else:
                out[own] += 1
    return out


# -- quality ---------------------------------------------------------------

def quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_lines": len(lines), "base_failed": n < 10 or 100 * len(covered) > 20 * n,
            "words": w}


def kept(text, rules, stop_words, lang="en"):
    q = quality(text)
    q["n_stop_words"] = sum(w.lower() in stop_words for w in q["words"])
    if q["base_failed"]:
        return False
    for r in rules:
        under = q[r.denominator] if r.denominator else 1
        if q["n_words"] < r.from_words or under == 0 or r.langs and lang not in r.langs:
            continue
        if r.low is not None and not q[r.numerator] >= r.low * under:
            return False
        if r.high is not None and not q[r.numerator] <= r.high * under:
            return False
    return True


# -- personal data ---------------------------------------------------------

BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True,
                  "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 14 <= len(digits) <= 19 and luhn(digits),
                  "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


# -- SimHash ---------------------------------------------------------------

def simhash(text):
    from xxhash import xxh64_intdigest
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not w:
        return 0
    hashes = [xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fingerprints, radius=4):
    """Smallest index reachable for every fingerprint."""
    f = np.array(fingerprints, dtype=np.uint64)
    parent = list(range(len(f)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ f[i]) <= radius):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(f))]


# -- mixing ----------------------------------------------------------------

def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Source -> target, resharing the excess step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free = {}, share * sum(sizes.values())
    rest = set(names)
    while rest:
        total = sum(weight[s] for s in rest)
        over = {s for s in rest if free * weight[s] / total >= cap * sizes[s]}
        if not over:
            out |= {s: free * weight[s] / total for s in rest}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            free -= out[s]
        rest -= over
    return out


def mixture(docs, short=64, seed="mix:", cap=2):
    """(doc_id, text, source) rows -> per row (size, source size, target, copies)."""
    rows = [(i, len(WORD.findall(t or "")), s) for i, t, s in docs]
    sizes = {s: 0 for _, _, s in rows}
    for _, n, s in rows:
        sizes[s] += n
    target = targets(sizes)
    copies = [0] * len(rows)
    for s in sizes:
        mine = [(k, i, n, 1 if n < short else 2) for k, (i, n, x) in enumerate(rows) if x == s and n > 0]
        if not mine:
            continue
        low, high = 0.0, 4.0 * cap
        for _ in range(200):  # the rate that meets the target, by bisection
            rate = (low + high) / 2
            if sum(min(cap, rate * lv) * n for _, _, n, lv in mine) < target[s]:
                low = rate
            else:
                high = rate
        near = round(high, 9)
        ranked, need = [], target[s]
        for k, i, n, lv in mine:
            e = min(cap, near * lv)
            whole = int(e + 1e-9)
            copies[k] = whole
            need -= whole * n
            key = "null" if i is None else str(i)
            u = (int(hashlib.md5((seed + key).encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            p = max(0.0, e - whole)
            above = u * (1 - p)
            ranked.append((above / (above + (1 - u) * p), "" if i is None else key, n, k))
        ranked.sort(key=lambda x: x[:2])
        at = 0
        units = {}
        for r, key, n, k in ranked:
            units.setdefault((r, key), []).append((n, k))
        for members in units.values():
            n = sum(x for x, _ in members)
            if need <= 1e-6 * max(1, target[s]) or at + n / 2 > need:
                break
            at += n
            for _, k in members:
                copies[k] = min(cap, copies[k] + 1)
    return [(n, sizes[s], target[s], c) for (_, n, s), c in zip(rows, copies)]


# -- pages -----------------------------------------------------------------

def article_text(page):
    """The article element's blocks, for pages of the test tables' make."""
    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not found:
        return ""
    parts = re.sub("<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\x00", found.group(1))).split("\x00")
    lines = (" ".join(html.unescape(x).split()) for x in parts)
    return "\n".join(x for x in lines if x)
