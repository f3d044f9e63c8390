"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def repeats(docs: list[tuple[int, str | None]]) -> dict:
    """doc_id to (n_bytes, n_removed, n_spans, sha256 of what stays); documents in order."""
    seen, out = set(), {}
    for key, text in docs:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(data[p : p + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def simhash(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps: dict[int, int], budget: int = 3) -> dict[int, int]:
    """Key to the smallest key reachable over links of at most ``budget`` bits."""
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in fps}


def repeat_words(words: list[str], window: int = 8) -> int:
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)})


def mixed_text(rng, words: int, lexicon: list[str]) -> str:
    return " ".join(rng.choice(lexicon) for _ in range(words))


def lexicon(rng, n: int = 300) -> list[str]:
    return ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(1, 9))) for _ in range(n)]


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "xx", "a", 4),
    (None, "no id here", "en", None, 10),
    (4, "été à la plage, don't 's're 123 <|endoftext|> tail", "fr", "b", 1),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "same text", "en", "c", 9),
    (7, "same text", "en", "c", 9),
    (7, "same text", "en", "c", 9),
    (8, "日本語 🙂 x y", "ja", None, 9),
]
