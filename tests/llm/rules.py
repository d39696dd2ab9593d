"""Plain versions of what the operators compute, for comparison."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fingerprint(text: str | None) -> int:
    own = words(lower(text))
    if not own:
        return 0
    counts, shingles = [0] * 64, [" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def groups(prints: list[int], bits: int = 4) -> list[int]:
    """For each print the index of the first one reachable."""
    parent = list(range(len(prints)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


def boilerplate(rows: list[tuple], ratio: float, least: int) -> dict[str, set[str]]:
    """Lines to drop per host, of rows (host, text)."""
    found: dict[str, set[str]] = {}
    for host in {h for h, t in rows if h is not None and t is not None}:
        pages = {t for h, t in rows if h == host and t is not None}
        counts = Counter(line for p in pages for line in {x.strip(" \t\r") for x in p.split("\n")} if line)
        found[host] = {line for line, n in counts.items() if n >= least and n > ratio * len(pages)}
    return found


def without(text: str | None, lines: set[str]) -> str | None:
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in lines)


def shingles(text: str | None, n: int = 5) -> set[tuple]:
    own = words((text or "").lower())
    return {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    own = words(text)
    windows = Counter(zip(own, own[1:], own[2:]))
    covered = {i + k for i, w in enumerate(zip(own, own[1:], own[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(own), sum(map(len, own)), symbols, dup, len(covered)


def fold(id, of: int) -> int:
    return zlib.crc32(str(id).encode()) % of


def shingle_counts(text: str | None, size: int = 5) -> Counter:
    own = words(lower(text))
    return Counter(" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))) if own else Counter()


def jaccard(a: Counter, b: Counter) -> float:
    """Of shingles with their repeats."""
    return sum((a & b).values()) / max(sum((a | b).values()), 1) if a or b else 1.0
