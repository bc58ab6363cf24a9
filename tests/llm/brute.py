"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items, n=13):
    """docs: [(id, text)]; items: [(id, text)] -> {(id, n_words, n_hit, n_items, digest, flag)}."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    windows = {}
    for item, text in items:
        words = split(text)
        for k in range(max(1, len(words) - n + 1)) if words else ():
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item))
    sizes, found = {len(w) for w in windows}, []
    for doc, text in docs:
        words = split(text)
        hit, seen = [False] * len(words), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                which = windows.get(tuple(words[k : k + size]))
                if which:
                    seen |= which
                    hit[k : k + size] = [True] * size
        digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        found.append((doc, len(words), sum(hit), len(seen), digest, sum(hit) > 0 and 20 * sum(hit) >= len(words)))
    return found


def fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs):
    """[(id, text)] -> [(id, hex fingerprint, smallest id reached)], by comparing all pairs."""
    prints = [(doc, fingerprint(text)) for doc, text in docs]
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return [(doc, f"{f:016x}", least.get(root(k))) for k, (doc, f) in enumerate(prints)]


def removed(docs, window=50):
    """[(id, text)] -> [(id, n_words, n_removed, digest of the kept words)]."""
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", text or "") for k, (_, text) in enumerate(docs)}
    first = {}
    for k, (doc, _) in enumerate(docs):
        for at in range(len(split[k]) - window + 1) if doc is not None else ():
            key = tuple(split[k][at : at + window])
            first[key] = min(doc, first.get(key, doc))
    found = []
    for k, (doc, _) in enumerate(docs):
        gone = [False] * len(split[k])
        for at in range(len(split[k]) - window + 1) if doc is not None else ():
            if first[tuple(split[k][at : at + window])] < doc:
                gone[at : at + window] = [True] * window
        kept = " ".join(w for w, g in zip(split[k], gone, strict=True) if not g)
        found.append((doc, len(split[k]), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return found


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def spans(text):
    """The base spans by the patterns as given."""
    text, found = text or "", []
    digits = lambda m: re.sub(r"[^0-9]", "", m)

    def luhn(d):
        return sum(int(x) if k % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for k, x in enumerate(d[::-1])) % 10 == 0

    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p[-4000:]) <= 255 and not p[:-4000].strip("0") for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return found


def crc_fold(doc):
    return zlib.crc32(str(doc).encode()) % 5
