"""Brute-force helpers shared by the tests."""

import xxhash


def fingerprint(text, shingle=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes_of(texts: dict, tau: int = 2) -> set:
    """The smallest id of each class of texts."""
    ids = sorted(texts)
    fps = {i: fingerprint(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}
