"""Plain-Python versions of the operators, written from the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def decontamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by comparing every window."""
    windows = defaultdict(set)
    for item_id, text in items:
        ws = tuple(WORDS.findall((text or "").translate(LOWER)))
        for k in range(max(1, len(ws) - 9) if ws else 0):
            windows[ws[k: k + 10]].add(item_id)
    out = []
    for doc_id, text in docs:
        ws = tuple(WORDS.findall((text or "").translate(LOWER)))
        hit, named = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if ws[k: k + size] in windows:
                    hit.update(range(k, k + size))
                    named |= windows[ws[k: k + size]]
        names = sorted(str(x) for x in named if x is not None)
        out.append((doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def line_dedup(docs: list[tuple], size: int = 3) -> dict[tuple, tuple]:
    """{(doc_id, text): (text left, n_lines, n_removed)}."""
    seen, gone = set(), defaultdict(set)
    distinct = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    for doc in distinct:
        solid = [x.strip(" \t\n\x0b\x0c\r") for x in doc[1].split("\n")]
        solid = [x for x in solid if x]
        for k in range(len(solid) - size + 1):
            window = tuple(solid[k: k + size])
            if window in seen:
                gone[doc].update(range(k, k + size))
            seen.add(window)
    out = {}
    for doc in set(docs):
        if doc[1] is None:
            out[doc] = None, 0, 0
            continue
        at, kept, keeping, n = -1, [], True, 0
        for line in doc[1].split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                at, n = at + 1, n + 1
                keeping = at not in gone[doc]
            if keeping:
                kept.append(line)
        out[doc] = "\n".join(kept), n, len(gone[doc])
    return out


def fingerprint(text: str | None, shingle: int = 4) -> int:
    ws = BLANK_WORDS.findall((text or "").translate(LOWER))
    if not ws:
        return 0
    parts = [" ".join(ws[k: k + shingle]) for k in range(max(1, len(ws) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs: list[tuple], radius: int = 4) -> list[list[int]]:
    """Groups of row numbers, from all pairs of fingerprints."""
    fps = [fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for k in range(len(docs)):
        groups[root(k)].append(k)
    return list(groups.values())


def simhash(docs: list[tuple], radius: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, component_id)."""
    out = []
    for group in components(docs, radius):
        least = min((docs[k][0] for k in group if docs[k][0] is not None), default=None)
        out += [(docs[k][0], f"{fingerprint(docs[k][1]):016x}", least) for k in group]
    return out


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    ws = BLANK_WORDS.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    times = defaultdict(list)
    for k in range(len(ws) - 7):
        times[tuple(ws[k: k + 8])].append(k)
    repeated = {p for at in times.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    failed = len(ws) < 20 or 100 * len(repeated) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None, kinds: list[tuple]) -> tuple[list[tuple], str]:
    """Sorted (start, kind rank, end, kind) of each kind's holding matches, and their digest."""
    spans = []
    for rank, (kind, pattern, holds) in enumerate(kinds):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if holds(m):
                spans.append((m.start(), rank, m.end(), kind))
    spans.sort()
    return spans, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def _digits(m) -> str:
    return re.sub("[^0-9]", "", m[0])


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(url: str | None, rules: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    host, path = host_path(url)
    fits = []
    for name, verdict in rules:
        at, _, rest = name.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + rest):
            fits.append((len(name), name, verdict))
    return max(fits)[1:] if fits else (None, None)


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*fields) -> str:
    return _digest(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_digest(*last[k: k + 2]) for k in range(0, len(last), 2)])
    return levels


def manifest(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row, _leaf(*row)))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        levels[name] = _levels([h for _, h in trees[name]])
    top = _levels([levels[t][-1][0] for t in names])
    out = []
    for place, name in enumerate(names):
        for k, (row, own) in enumerate(trees[name]):
            doc_id, source, lang, n_chars, text = row
            node = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                node = _leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text)
            proof = []
            for at, layers in ((k, levels[name]), (place, top)):
                for level in layers[:-1]:
                    run = level[at // 2 * 2: at // 2 * 2 + 2]
                    other = [h for j, h in enumerate(run) if j != at % 2]
                    proof += other
                    node = _digest(*(other + [node] if at % 2 else [node] + other))
                    at //= 2
            out.append((doc_id, own, levels[name][-1][0], top[-1][0], _digest(*proof), node, node == top[-1][0]))
    return out


def search(docs: list[tuple], items: list[tuple], top: int = 20) -> list[tuple]:
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, pattern.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    total = sum(len(ws) for _, ws in held)
    sets = [set(ws) for _, ws in held]
    out = []
    for item_id, text in set(items):
        scores = []
        terms = pattern.findall((text or "").translate(LOWER))
        weights = {t: math.floor(1000 * math.log((2 * len(held) + 2) / (2 * sum(t in s for s in sets) + 1))) for t in set(terms)}
        for doc_id, ws in held:
            m = 100 - 25 + (25 * len(ws) * len(held)) // total
            score = sum(weights[t] * ((1000000000 * ws.count(t)) // (1000 * ws.count(t) + 12 * m)) for t in terms)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:top], 1)]
    return out


def term_spans(texts: list[str], context: int = 60, least: float = 0.5, share: float = 0.5, evidence: float = 0.75, place=hash) -> list[list[tuple[int, int]]]:
    """Spans of disclosing terms in each of the distinct ``texts``; ``place``: a text's number, whose last six bits are its place."""
    held = []
    for text in texts:
        base = [(s[0], s[2], s[3], text[s[0]: s[2]].lower()) for s in base_spans(text, PERSONAL)[0]]
        own = []
        for a, b, kind, value in base:
            each = {(kind, value)}
            if kind == "email":
                each |= {("domain", value.split("@")[-1])} | {("local", w) for w in _letters(value.split("@")[0])}
            if kind == "ip":
                each |= {("network", ".".join(value.split(".")[:3]))}
            own.append((a, b, each))
        held.append((own, [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W\d_]+", text)]))
    n_entity, n_texts, n_both, near, capital, places = (defaultdict(set) for _ in range(6))
    letters, beside = 0, defaultdict(set)
    for k, (own, words) in enumerate(held):
        for _, _, each in own:
            for e in each:
                n_entity[e].add(k)
        for c, d, word in words:
            term = word.lower()
            letters += d - c
            n_texts[term].add(k)
            places[term].add(place(texts[k]) & 63)
            capital[term].add(word[0] != word[0].lower())
            for a, b, each in own:
                if a - context <= c <= b + context and (d <= a or c >= b):
                    near[term].add(k)
                    beside[k].add((c, d))
                    if len(word) > 3 or word[0] == word[0].upper():
                        for e in each:
                            n_both[term, e].add(k)
    kinds = {t: (len(places[t]), all(capital[t])) for t in n_texts}
    pairs, close = defaultdict(float), defaultdict(int)
    for t, (n, _) in kinds.items():
        pairs[kinds[t]] += 1.0 if n == 1 else -64 * math.log(1 - n / 64) if n < 64 else math.inf
        close[kinds[t]] += len(near[t])
    b = min(1.0, sum(d - c for s in beside.values() for c, d in s) / max(letters, 1))
    telling = set()
    for (t, e), both in n_both.items():
        common = len(n_entity[e]) / len(texts)
        chance = (len(both) + common) / (len(n_texts[t]) + 1)
        if common < 1 and round(chance, 9) >= least and round(1 - math.log(chance) / math.log(common), 9) >= share:
            q = min(1.0, b * pairs[kinds[t]] / close[kinds[t]])
            if round(1 - q * b ** (len(both) - 1), 9) >= evidence:
                telling.add((t, e))
    out = []
    for own, words in held:
        mine = set().union(*(each for _, _, each in own))
        out.append([(c, d) for c, d, w in words if any((w.lower(), e) in telling for e in mine)
                    and not any(a < d and c < b for a, b, _ in own)])
    return out


def _letters(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text)
