"""Small tables with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, uid string, packed int, cls double, rest string, kept string"


def documents(spark, rows):
    """Rows of (doc_id, text), with the other columns of documents and some whose names operators use inside."""
    full = [(i, t, "en" if (i or 0) % 2 else None, None, None if t is None else len(t), "u", 1, 0.5, None, "no") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empty and blank texts, one very long, repeated rows, ids that share texts, accents."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "straße", "中文", "O'Neil", "x***"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, " ".join(words * 3000))]
    for i in range(6, 90):
        text = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            parts = text.split(" ")
            parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        rows.append((i, text + rng.choice(["", "\n" + rng.choice(base)])))
    return [*rows, (None, base[0]), (None, base[0]), (None, None), rows[20], rows[20]]


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
