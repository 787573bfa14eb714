"""Small tables with what real ones hold: nulls, empty and long texts, copies, ties, clashing column names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n", "one", "one two", "A b C d E", "a B c D e", "naïve Ünïcode 日本語 😀 <|endoftext|>", "x" * 5000, "word " * 4000]
    base = [prose(rng, rng.randint(5, 80)) for _ in range(n)]
    texts += base + base[:6] + base[:2] * 3
    for text in base[:12]:  # near copies
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 4)}\n{passage}\n{prose(rng, 9)}" for _ in range(8)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "hot", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[13]]  # repeated rows
    rows += [(None, "a row without an id", "en", "a", 19), (None, None, None, None, None)]
    return rows
