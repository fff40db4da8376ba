"""Plain-Python versions of what the registered queries must return, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    out, counts = [], {}
    for kind, pattern in BASE.items():
        kept = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                kept.append(f"{kind}:{m.start()}:{m.end()}")
        counts[kind] = len(kept)
        out += kept
    return (*counts.values(), sha(",".join(out)), out)


def quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    again = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def url(u):
    if u is None or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule


def repeats(texts, width=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shared_words(texts, width):
    """Of each text, the words in windows that another text has too."""
    rows = [plain_words(t) for t in texts]
    held = {}
    for i, words in enumerate(rows):
        for j in range(len(words) - width + 1):
            held.setdefault(tuple(words[j : j + width]), set()).add(i)
    return [len({x for j in range(len(words) - width + 1) if len(held[tuple(words[j : j + width])]) > 1 for x in range(j, j + width)}) for words in rows]


def contamination(texts, items, width=10):
    """items: (id, text) pairs."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(item)
    lengths = sorted({len(w) for w in windows})
    out = []
    for text in texts:
        words, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out.append((len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def pieces(ids, size=1024):
    """(start, length, crc) of each piece of a document's ids."""
    if len(ids) <= size:
        cuts = [0, len(ids)]
    else:
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
    return [(a, b - a, zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[a:b]))) for a, b in zip(cuts, cuts[1:])]
