"""Small frames with the awkward cases that every operator must take."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, n int, a string, size int, rep string, _sl_x int"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward(seed=0):
    """Null ids, texts and sources, empty and blank texts, repeated rows, long texts, columns with clashing names."""
    r = random.Random(seed)
    base = [prose(r, n) for n in (3, 5, 12, 60, 60, 120, 300)]
    texts = [None, "", " \n\t ", "One", *base]
    texts += [base[3], base[3].upper(), base[5] + " tail", "head " + base[5], base[5].replace("w1", "x1", 1), prose(r, 4000, 50), "be " * 300, base[6] + " " + base[6], "x" * 5000, "é ñ ß 日本   x"]
    rows = [(i, t, "en", [None, "s1", "s2", "s3"][i % 4]) for i, t in enumerate(texts)]
    rows += [(None, base[4], "de", "s1"), (None, None, None, None), rows[7], rows[7]]
    r.shuffle(rows)
    return [(*x, len(x[1] or ""), 1, 2, "a", 3, "r", 4) for x in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, texts, start=0):
    return frame(spark, [(start + i, t, "en", f"s{i % 3}", 0, 1, 2, "a", 3, "r", 4) for i, t in enumerate(texts)])


def near_texts(seed=1, groups=6, copies=5, words_each=150):
    """Groups of texts with a few words changed, and shared passages."""
    r, out = random.Random(seed), []
    passage = prose(r, 70, 10_000)
    for g in range(groups):
        base = prose(r, words_each, 10_000).split()
        for c in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"new{r.randrange(10_000)}"
            if c % 3 == 0:
                w[40:40] = passage.split()
            out.append(" ".join(w))
    return out
