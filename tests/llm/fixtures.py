"""Small documents with every awkward case: nulls, empty and long texts, copies, near copies, repeated rows."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return SPLIT.findall(text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    own = random.Random(7)
    stock = ["".join(own.choice(["tha", "re", "on", "ié", "sch", "o", "le"]) for _ in range(own.randint(1, 4))) for _ in range(vocabulary)]
    out = []
    for k in range(n):
        w = rng.choice(stock)
        out.append(w.capitalize() if k % 11 == 0 else w)
        if k % 11 == 10:
            out[-1] += ".\n" if k % 33 == 32 else "."
    return " ".join(out) + "."


def documents() -> list[tuple]:
    base = [prose(k, 80 + 13 * k) for k in range(12)]
    texts: list[str | None] = [*base, base[3], base[3], base[5] + " extra words here", "x " + base[5], None, None, "", " \n\t ", "word", "two words", prose(99, 6000)]
    texts += ["same line of words, again and again.\n" * 30, "UP!! AND!! DOWN!! " * 30, "café naïve 你好 \U0001f600 zero\x00nul " * 5, "a b c " * 20]
    texts += [" ".join(base[1].split()[10:40]) + " and then " + " ".join(base[2].split()[5:30])]
    rows = [(k, t, ("en", "fr")[k % 2], "s", 1) for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, base[3], "en", "s", 1), (None, None, None, None, None), (1000, base[0].upper(), "en", None, None)]
