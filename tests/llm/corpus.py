"""A small corpus with copies, near copies, benchmark passages, personal data, boilerplate and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, row string, n long, h string, node string, group string"
SYLLABLES = "an be ca do er fi ga ho in ju ka lo mi no or pa qu ro su ti".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def paragraph(rng, n):
    return " ".join(words(rng, n)).capitalize() + "."


def make(seed=1, size=60):
    """(doc_id, text) and (item_id, text)."""
    rng = random.Random(seed)
    passage = paragraph(rng, 90)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((30, 12, 10, 7, 4, 0))] + [(99, None), (0, " ".join(words(rng, 15)))]
    docs = []
    for i in range(size):
        lines = [paragraph(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"Printed by example press in {1900 + i} all rights kept.")
        if i % 5 == 0:
            lines.insert(0, passage)
        if i % 7 == 0:
            w = items[i % 5][1].split(" ")
            lines.append(" ".join([*words(rng, 3), *w, *words(rng, 3)]).upper())
        if i % 6 == 0:
            lines.append(f"mail ab.{i}@mail.example.com call +1 (212) 555-{1000 + i} from 10.2.{i}.255 or 10.2.300.1 card 4111 1111 1111 1111 x 4111111111111112")
        docs.append((i, "\n".join(lines)))
    base = docs[2][1].split(" ")
    for k in range(8):  # near copies
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        docs.append((100 + k, " ".join(w)))
    docs += [(200 + k, docs[4][1]) for k in range(5)]  # exact copies
    odd = [None, "", " ", "\n\n", "word", "Ünïcödé ünïcödé ünïcödé", "5 6 7", "a" * 3000, "x " * 2500, "日本語 テキスト 😀", "one two three four", "é" * 500 + " " + "é" * 500]
    docs += [(300 + k, t) for k, t in enumerate(odd)]
    docs.append(docs[3])  # a repeated row
    docs += [(None, docs[5][1]), (None, paragraph(rng, 70)), (None, None)]
    docs.append((500, " ".join(paragraph(rng, 30) for _ in range(100)) + "\n" + passage))
    return docs, items


def frame(spark, docs, lang="en"):
    rows = [(d, t, lang, f"src{(d or 0) % 4}" if (d or 0) % 9 else None, len(t or ""), "k", "t", "r", 1, "h", "n", "g") for d, t in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 5, "w") for i, t in items], "item_id long, text string, n long, win string")
