"""Documents with the odd cases that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT,"
    " row BIGINT, word STRING, hash STRING, key STRING, prefix STRING, `odd name` STRING, owner STRING, component_id STRING"
)


def make(seed: int = 7, documents: int = 60) -> list[tuple]:
    """Rows of SCHEMA; about a third of the documents share a host and passages."""
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghil") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(known) for _ in range(70))
    line = " ".join(rng.choice(known) for _ in range(6))
    texts: list[tuple[int | None, str | None]] = []
    for number in range(documents):
        words = [rng.choice(known) for _ in range(rng.randint(5, 160))]
        for place in range(0, len(words), 11):
            words[place] = words[place].capitalize() + rng.choice([",", ".", "\n", "é", "#"])
        if number % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        text = " ".join(words)
        if number % 4 == 0:
            text += "\n" + line + "\nend of it"
        texts.append((number, text))
    # Copies, near copies, repeated rows, equal ids with other texts, nulls and odd texts.
    texts += [(100 + k, texts[k][1]) for k in (0, 1, 1, 2)]
    texts += [(110 + k, texts[k][1].replace(" ", "  ", 1)) for k in (0, 3)]
    texts += [(120 + k, texts[k][1] + " " + known[k]) for k in range(5)]
    texts += [texts[5], texts[5], (6, texts[7][1]), (None, texts[0][1]), (None, None), (None, passage), (200, None), (201, ""), (202, " \n\t "), (203, "\n"), (204, "x")]
    texts += [(205, passage), (206, passage), (207, "same same same same " * 40), (208, "  éß 中文 \U0001f600!"), (209, "a" * 5000 + " " + passage)]
    texts += [(210, " ".join(rng.choice(known) for _ in range(30_000))), (211, "<|endoftext|> <|startoftext|>a I'll o'clock 12,5 İstanbul été.")]
    hosts = ["hot", "hot", "b", None]
    langs = ["aa", "bb", None]
    return [
        (i, t, langs[n % 3], hosts[n % 4], len(t) if t else None, n, "w", None, "k", "p", "o", None, "c")
        for n, (i, t) in enumerate(texts)
    ]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(make() if rows is None else rows, SCHEMA)


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
