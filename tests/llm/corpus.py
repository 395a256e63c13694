"""Small corpora with the cases that operators have to stand: nulls, empty and long texts, ties, repeated rows, copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, score double, n long"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice(["th", "er", "an", "in", "on", "re", "ou", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    base = [words(r, r.randint(40, 160)) for _ in range(12)]
    passage = words(r, 50)
    out: list[tuple[int | None, str | None]] = []
    for i, b in enumerate(base):
        out.append((i, " ".join(b)))
        near = list(b)
        near[len(near) // 2] = "changed"
        out.append((100 + i, " ".join(near)))
        out.append((200 + i, " ".join(b[:20] + passage + b[20:])))
    out += [(300, " ".join(base[0])), (301, " ".join(base[0]).upper().replace("É", "é")), (302, " ".join(base[1]) + "\n" + " ".join(base[2]))]
    out += [(400, None), (401, ""), (402, "  \n\t "), (403, "one two"), (404, "One  two"), (405, "x " * 300), (None, "a null id with some words in it"), (None, None)]
    out += [(500, "The same row"), (500, "The same row"), (501, "long " + " ".join(words(r, 3000)))]
    return out


def frame(spark, rows, extra: bool = True):
    full = [(d, t, "en", "s", len(t or ""), 7, "k", 0.5, 3) for d, t in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    return df if extra else df.select("doc_id", "text")
