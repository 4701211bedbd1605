"""Small corpora for the operators' tests, made by rule."""

import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = "x" + str(rng.randint(0, 10**6))
    return " ".join(w)


def corpus(seed=5, groups=12):
    """(id, text): bases, exact and near copies, empty, null, short, very long and tied texts."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = prose(rng, rng.choice([4, 30, 120, 400]))
        texts += [base] * rng.choice([1, 2, 4])
        texts += [edited(rng, base, rng.choice([0.005, 0.02, 0.05, 0.2])) for _ in range(rng.choice([0, 2, 6]))]
    texts += [None, "", " \n\t ", "one", "One", "two words", "Two Words", prose(rng, 30_000), "same " * 500]
    rng.shuffle(texts)
    return list(enumerate(texts))
