"""Small documents with every case that operators have to define: nulls, empties, copies, near copies, junk, long texts."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, class_id string, start string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def documents() -> list[tuple]:
    rng = random.Random(7)
    passage = " ".join(words(rng, 60))
    base = words(rng, 220)
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "a b c d", passage, passage]
    texts += [" ".join(base), " ".join(base), " ".join(base[:110] + ["changed"] + base[111:]), " ".join(base[:40] + ["other", "text"] + base[42:])]
    for _ in range(14):
        near = list(base)
        for _ in range(rng.randrange(1, 4)):
            near[rng.randrange(len(near))] = "x" + str(rng.randrange(1000))
        texts.append(" ".join(near))
    for _ in range(12):
        texts.append(" ".join(words(rng, rng.randrange(60, 150))))
    texts.append(" ".join(words(rng, 30)) + "\n" + passage + "\n" + " ".join(words(rng, 40)))
    texts.append(" ".join(words(rng, 10)) + " " + passage + " " + " ".join(words(rng, 30)) + " " + passage)
    texts += ["the " * 300, "!!! ### $$$ " * 40, "line one here\nline two here\n" * 30, "Ümläut ß é Σ ΑΣ 中文 😀 <|endoftext|> \x1c x " * 12]
    texts.append(" ".join(words(rng, 9000)))
    rows = [(i, t, "en", "src0", len(t or ""), "yes", "c", "s") for i, t in enumerate(texts)]
    rows.append((None, " ".join(base), None, None, None, None, None, None))
    rows.append(rows[9])  # a whole row again
    return rows


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(parts)
