"""Documents with what operators must stand: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ("n", "node", "uid", "hash", "key", "spans", "row", "bucket", "size", "state", "kind", "place", "label", "cluster", "_place")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [text(rng, rng.randint(60, 160)) for _ in range(8)]
    texts = list(base)
    for b in base[:5]:
        ws = b.split()
        ws[rng.randrange(len(ws))] = "Changed"
        texts += [b, " ".join(ws), " ".join(ws[:70] + text(rng, 40).split())]
    passage = text(rng, 60)
    texts += [text(rng, 20) + " " + passage + "\n" + text(rng, 15) for _ in range(6)]
    texts += [None, "", " \t\n", "one", "two Words", "a b c", "ça été là", "same " * 200, "same " * 130, text(rng, 6000), "x" * 200_000, "a@b.c +1 (706) 555-3138 1.2.3.4"]
    rng.shuffle(texts)
    out = [(i * 3 % 101, t, "en", rng.choice(["s0", "s0", "s0", "s1", "s2", None]), len(t or ""), *["z"] * len(CLASHING)) for i, t in enumerate(texts)]
    return out + [out[3], out[3]] + [(None, base[0], None, None, None, *[None] * len(CLASHING)), (None, None, None, None, None, *[None] * len(CLASHING))]


def documents(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
