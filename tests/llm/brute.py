"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

U64 = (1 << 64) - 1


def signed(x: int) -> int:
    x &= U64
    return x - (1 << 64) if x >> 63 else x


def spark_xxhash64(*values) -> int:
    """Spark's xxhash64 of strings and 64-bit (``("int", n)``: 32-bit) numbers: each hash seeds the next; nulls pass."""
    seed = 42
    for value in values:
        if value is None:
            continue
        if isinstance(value, str):
            data = value.encode()
        elif isinstance(value, tuple):
            data = (value[1] & 0xFFFFFFFF).to_bytes(4, "little")
        else:
            data = (value & U64).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return signed(seed)


def fingerprint(text: str | None, k: int = 5, bins: int = 32, picked: int = 2) -> list[int]:
    """Order MinHash of a text: elements sorted as signed numbers."""
    words = re.findall(r"[^\t-\r ]+", text or "")
    if not words:
        return []
    hashes = [spark_xxhash64(w) for w in words]
    high = U64 ^ 0xFFFFFF
    runs = []
    for i in range(max(1, len(words) - k + 1)):
        whole = spark_xxhash64(*hashes[i : i + k])
        runs.append((signed(whole & high), i))
    seen: Counter = Counter()
    own = []
    for value, place in sorted(runs):
        times = seen[value]
        seen[value] += 1
        own.append((signed(spark_xxhash64(value, ("int", times)) & high) if times else value, place))
    by_bin = defaultdict(list)
    for value, place in sorted(own):
        by_bin[(value & U64) >> (64 - (bins.bit_length() - 1))].append((value, place))
    found = []
    for number, members in by_bin.items():
        acc = number
        for value, _ in sorted(members[:picked], key=lambda m: m[1]):
            acc = spark_xxhash64(acc, signed(value))
        found.append(signed((number << 56) | ((acc & U64) >> 8)))
    return sorted(found)


def removed_bytes(texts: list[bytes], length: int = 400) -> list[np.ndarray]:
    """Per text, which bytes are covered by a string that also starts elsewhere."""
    seen = defaultdict(list)
    for number, text in enumerate(texts):
        for at in range(len(text) - length + 1):
            seen[text[at : at + length]].append((number, at))
    masks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for number, at in places:
                masks[number][at : at + length] = True
    return masks


def edit_distance(a: list, b: list) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def words(text: str | None) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def components(count: int, links) -> list[int]:
    parent = list(range(count))

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(count)]


def near_duplicate_classes(docs: list[tuple]) -> list:
    """The class of each (doc_id, text), from all pairs."""
    texts = [words(t) for _, t in docs]
    links = [
        (i, j)
        for i in range(len(docs))
        for j in range(i)
        if (docs[i][1] or "") == (docs[j][1] or "")
        or (texts[i] and texts[j] and edit_distance(texts[i], texts[j]) <= math.floor(0.2 * max(len(texts[i]), len(texts[j])) + 1e-9))
    ]
    found = components(len(docs), links)
    least = {}
    for (doc_id, _), c in zip(docs, found, strict=True):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return [least.get(c) for c in found]


class KneserNey:
    """Interpolated modified Kneser-Ney over characters, by the textbook's sums."""

    def __init__(self, texts: list[str], order: int = 4):
        self.order = order
        counts: Counter = Counter()
        for text in texts:
            counts.update(self.grams(text))
        self.counts = {order: counts}
        for size in range(order - 1, 0, -1):
            self.counts[size] = Counter(gram[1:] for gram in self.counts[size + 1])
        self.discounts, self.contexts = {}, {}
        for size, table in self.counts.items():
            n = Counter(table.values())
            ns = [n[i] for i in (1, 2, 3, 4)]
            y = ns[0] / (ns[0] + 2 * ns[1]) if ns[0] else 0
            ds = []
            for i in (1, 2, 3):
                value = i - (i + 1) * y * ns[i] / ns[i - 1] if min(ns) > 0 else 0
                ds.append(value if 0 < value <= i else i / 2)
            self.discounts[size] = ds
            contexts = defaultdict(lambda: [0, 0.0])
            for gram, c in table.items():
                contexts[gram[:-1]][0] += c
                contexts[gram[:-1]][1] += ds[min(c, 3) - 1]
            self.contexts[size] = contexts

    def grams(self, text: str):
        symbols = [0] * (self.order - 1)
        for char in text.replace("\0", "�"):
            point = ord(char)
            high, low = divmod(point - 0x780, 1024)
            # The two parts of a wide character differ from each other and from characters.
            for symbol in [point] if point < 0x780 else [("high", high), ("low", low)]:
                symbols.append(symbol)
                yield tuple(symbols[-self.order :])

    def p(self, gram: tuple) -> float:
        size = len(gram)
        below = self.p(gram[1:]) if size > 1 else 1 / 4096
        if gram[:-1] not in self.contexts[size]:
            return below
        total, taken = self.contexts[size][gram[:-1]]
        c = self.counts[size].get(gram, 0)
        kept = c - self.discounts[size][min(c, 3) - 1] if c else 0.0
        return (kept + taken * below) / total

    def nll(self, text: str) -> float:
        return -sum(math.log(self.p(gram)) for gram in self.grams(text))


def quality(docs: list[tuple], labels: dict[int, tuple]) -> list[tuple]:
    """(perplexity, rejected) per (doc_id, text, lang); labels: doc_id -> (quality, toxic)."""
    result: list = [(None, False)] * len(docs)
    for lang in {d[2] for d in docs}:
        rows = [i for i, d in enumerate(docs) if d[2] == lang]
        trusted = [i for i in rows if labels.get(docs[i][0]) == (1, 0)]
        bad = [i for i in rows if labels.get(docs[i][0], (None,))[0] == 0]
        chars = {i: len(docs[i][1] or "") for i in rows}
        if not sum(chars[i] for i in trusted):
            continue
        model = KneserNey([docs[i][1] or "" for i in trusted])
        nll = {i: model.nll(docs[i][1] or "") for i in rows}
        mean = sum(nll[i] for i in trusted) / sum(chars[i] for i in trusted)
        score = {i: (nll[i] + 50 * mean) / (chars[i] + 50) for i in rows}

        def quantile(of: list[int], q: float, score=score) -> float:
            values = sorted(score[i] for i in of)
            return values[max(0, math.ceil(q * len(values)) - 1)]

        limit = quantile(trusted, 0.995)
        if bad:
            limit += 0.5 * max(0.0, quantile(bad, 0.05) - limit)
        for i in rows:
            if chars[i]:
                result[i] = (math.exp(nll[i] / chars[i]), score[i] > limit)
    return result


def mix(docs: list[tuple]) -> list[int]:
    """How often each (doc_id, text, source) is taken; rows are expected to differ."""
    import hashlib

    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    sources = sorted({s for _, _, s in docs if s is not None}) + ([None] if any(s is None for _, _, s in docs) else [])
    own = {s: sum(n for n, d in zip(sizes, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(sizes))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * own[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= over
    taken = [0] * len(docs)
    for s in sources:
        rows = sorted(
            (i for i, d in enumerate(docs) if d[2] == s),
            key=lambda i: (hashlib.md5(("" if docs[i][0] is None else str(docs[i][0])).encode()).hexdigest(), sizes[i]),
        )
        before = 0
        for i in rows:
            taken[i] = sum(copy * own[s] + before + sizes[i] / 2 <= target[s] for copy in range(3))
            before += sizes[i]
    return taken
