"""Small documents with every awkward case."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("id", T.StringType()), T.StructField("t", T.StringType()), T.StructField("node", T.StringType()),
    T.StructField("band", T.LongType()), T.StructField("v", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("bucket", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("key", T.LongType()),
    T.StructField("target", T.LongType()), T.StructField("root", T.LongType()), T.StructField("shard", T.StringType()),
])


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ab", "el", "or", "un", "it", "ß", "é"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def sentences(rng: random.Random, n: int) -> list[str]:
    return [words(rng, rng.randint(3, 14)).capitalize() + rng.choice([".", ".", "!", "?"]) for _ in range(n)]


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    base = [" ".join(sentences(rng, rng.randint(1, 12))) for _ in range(30)]
    passage = " ".join(sentences(rng, 6))
    out = [*base, None, None, "", "", " \n\t ", "one", "one two", "a b c d", "x" * 3000, "\u0000 nul \u0000", "z " * 4000,
           words(rng, 6000), base[0], base[0], base[3].upper(), base[4].replace(" ", "  "), "…" * 70]
    for i in range(8):
        mine = sentences(rng, 8)
        out.append(" ".join([*mine[:4], passage, *mine[4:]]))
    for i in range(8):  # near copies
        w = base[7].split() + words(rng, 60).split()
        w = (base[7] + " " + base[8] + " " + base[9]).split()
        for _ in range(2):
            w[rng.randrange(len(w))] = "changed" + str(i)
        out.append(" ".join(w))
    return out


def rows(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    body = texts(seed)
    ids: list = list(range(len(body)))
    rng.shuffle(ids)
    out = [(i, t, "en", rng.choice(["b", "a", "c", None, "Z"]), len(t or "")) for i, t in zip(ids, body, strict=True)]
    out += [(None, body[1], None, None, None), (None, None, None, None, None), out[2], out[2], out[-1]]
    return [(*r, "x", "y", "z", 1, 2, 3, 4, 5, 6, 7, 8, "s") for r in out]
