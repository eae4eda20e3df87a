"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, count long"


def rows(seed: int = 7, n: int = 60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdéñß") for _ in range(r.randint(1, 6))) for _ in range(80)] + ["The", "of", "AND"]
    sent = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passages = [sent(40) for _ in range(3)]
    out = []
    for i in range(n):
        lines = [sent(r.randint(1, 30)) for _ in range(r.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(passages))
        out.append("\n".join(lines))
    for i in range(5):
        out.append(out[i])  # exact copies
        w = out[i + 10].split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [None, "", " \t\n ", "...", "|||", "word", "a " * 300, sent(6000), "x" * 5000, "\n\n\n", passages[0], passages[0] + "\n" + passages[0]]
    table = [(i, t, "ab"[i % 2] if i % 7 else None, f"s{i % 3}" if i % 5 else None, None if t is None else len(t), i, 1) for i, t in enumerate(out)]
    return table


def documents(spark, extra=True):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
