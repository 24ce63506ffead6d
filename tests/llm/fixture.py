"""Small tables with the cases every operator must stand: nulls, empty and long texts, copies, clashing names."""

from __future__ import annotations

import random

import numpy as np

SYLLABLES = ["the", "an", "on", "re", "st", "ing", "ou", "ti", "en", "ha", "le", "ver"]


def prose(rng: random.Random, count: int) -> str:
    made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(count)]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in made)


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) and two columns whose names operators use themselves."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(30, 160)) for _ in range(24)]
    passage = prose(rng, 120)
    edited = texts[3].split()
    edited[5], edited[17] = "changed", "words"
    junk = [" | ".join(prose(rng, 1).upper() + "!!%" for _ in range(60)) for _ in range(5)]
    texts += [texts[0], texts[0], " ".join(edited), passage + " " + prose(rng, 40), prose(rng, 30) + " " + passage]
    texts += [None, "", " \n\t ", "é" * 500 + " 日本語 🙂", "a" * 900, "x", "<|endoftext|> y", prose(rng, 4000), *junk]
    rows = [
        (i, t, "en" if i % 3 else "de", ["a", "b", None, "c"][i % 4], len(t or ""), "clash", i) for i, t in enumerate(texts)
    ]
    return [*rows, rows[2], (None, texts[5], None, None, None, None, None), (None, None, None, None, None, None, None)]


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, size int"


def labels() -> list[tuple]:
    rows = []
    for i, row in enumerate(documents()[:-3]):
        if row[1] and "!!%" in row[1]:
            rows.append((i, 0, 0))
        elif i % 2 == 0 and i < 24:
            rows.append((i, 1, 0))
    return [*rows, (1, 1, 1), (2, 1, 0), (None, 1, 0), (5, None, None)]


def pages() -> list[tuple]:
    body = "<html><body><nav><a href=/>Menu</a></nav><article><h1>T</h1><p>A text, of some length, with commas &amp; more.</p></article></body></html>"
    return [
        (3, "http://a", body, 1), (1, "http://b", body, 1), (7, "http://c\r\nd%", "<p>short", 1), (8, None, None, 1),
        (9, "u", "", 1), (4, "u", body, 1), (None, None, body, 1), (7, "http://c\r\nd%", "<p>short", 1),
        (10, "v", "ü" * 70_000, 1), (11, "w", "<p>" + "x, " * 40 + "</p>", 1),
    ]


PAGES = "page_id bigint, url string, html string, digest int"


def embeddings() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows, base = [], rng.standard_normal((40, 16))
    for i, vector in enumerate(base):
        rows.append((i, vector.tolist(), i % 3))
    for i in range(30):  # a group larger than a list
        rows.append((100 + i, (base[0] + 0.05 * rng.standard_normal(16)).tolist(), 0))
    rows += [(200, base[1].tolist(), 1), (201, base[1].tolist(), 1), (202, base[1].tolist(), 2), (203, base[1].tolist(), None)]
    rows += [(204, None, 1), (205, [0.0] * 16, 1), (206, [float("nan")] * 16, 1), (207, [1.0, None], 1), (208, [], 1)]
    rows += [(209, (base[1] * 3e30).tolist(), 1), (210, [float("inf")] * 16, 1), (211, base[2][:8].tolist(), 2), (5, base[5].tolist(), 2)]
    return rows


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def conversations() -> list[tuple]:
    """(conv_id, turn, role, text) and a clashing column: shared heads, gaps in the hundreds, ties, nulls, negative ids."""
    rng = random.Random(3)
    firsts = [prose(rng, 8) for _ in range(4)]
    rows: list[tuple] = []
    for c in [*range(0, 40), *range(100, 130), *range(230, 250), -7, -3, 0 - 200, 5_000_000_000]:
        for turn in range(rng.randint(1, 9)):
            text = firsts[rng.randrange(2)] if turn < 2 and rng.random() < 0.8 else prose(rng, 5)
            rows.append((c, turn, ["user", "assistant"][turn % 2], text, "clash"))
    rows += [(300 + c, turn, "user", f"same {turn}", "x") for c in range(50) for turn in range(4)]
    rows += [(405, turn, "user", f"turn {turn % 7} 日本", "x") for turn in range(700)]
    rows += [(500, None, None, None, None), (500, 1, "user", None, None), (500, 1, None, "tie", None), (500, 1, "user", "tie", None)]
    rows += [(501, 3, "user", "tie", None), (501, 3, "user", "tie", None), (None, 1, "user", "nobody", None), (502, None, "u", "", None)]
    return rows


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, path string"


def write(spark, folder: str, empty: bool = False) -> str:
    for name, rows, schema in (
        ("documents", documents(), DOCUMENTS),
        ("labels", labels(), "doc_id bigint, quality int, toxic int"),
        ("pages", pages(), PAGES),
        ("embeddings", embeddings(), EMBEDDINGS),
        ("conversations", conversations(), CONVERSATIONS),
    ):
        spark.createDataFrame([] if empty else rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder
