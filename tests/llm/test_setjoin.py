"""The set join against all pairs."""

import random

import numpy as np
import pytest

from mailquarry.llm import setjoin
from mailquarry.llm.arrays import word_hash


def plain(docs, a=4, b=5):
    """Component of every row by comparing all pairs of sets."""
    sets = []
    for _, t in docs:
        w = [x for x in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and b * len(x & sets[j]) >= a * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), 1 << 60), 1 << 60 if d is None else d)
    return [(d, len(s), None if least[find(i)] == 1 << 60 else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(spark, docs, similarity=(4, 5)):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, node int, element string").repartition(3)
    got = setjoin.classes(df, similarity)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, *similarity), key=key)


EDGES = [(200, "A b"), (201, "a B"), (202, ""), (203, None), (204, " \n\t"), (None, "no id here at all"), (None, ""), (205, "\x0b é È\x0c é"), (206, "one two three four five"), (207, "ONE two\nthree four five"),
         (208, "a a a a a a a a a a a a"), (209, "a a a a a a"), (210, "word " * 5000), (211, "x" * 100_000)]


@pytest.mark.parametrize("seed, edits, similarity", [(1, 4, (4, 5)), (2, 10, (4, 5)), (3, 12, (1, 2)), (4, 1, (9, 10))])
def test_groups_of_near_copies(spark, seed, edits, similarity):
    """Copies with edits all over, some just linked and some just not, of different lengths, with shared passages."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 130))] for _ in range(6)]
    docs = []
    for i in range(140):
        t = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, edits)):
            k = rnd.randrange(len(t))
            t[k:k + rnd.randint(0, 2)] = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 2))]
        if rnd.random() < 0.3:
            k = rnd.randint(0, len(t))
            t[k:k] = passage[:rnd.choice([10, 40])]
        docs.append((i, " ".join(t)))
    docs += [(3, docs[3][1]), (300, docs[5][1]), (None, docs[7][1])]
    check(spark, docs + EDGES, similarity)


def test_large_group_of_one_chain(spark):
    """Every text differs a little from the one before: far ends share nothing and are still one component."""
    rnd = random.Random(5)
    words, docs = [f"v{i}" for i in range(60)], []
    for i in range(80):
        docs.append((1000 - i, " ".join(words)))
        words = words[1:] + [f"n{i}"]
    rnd.shuffle(docs)
    check(spark, docs)


def test_common_passage_links_nothing_but_copies(spark):
    """Most of every text is one passage; own words keep the texts just below the threshold, or just above it."""
    passage = [f"p{i}" for i in range(60)]
    docs = [(i, " ".join(passage + [f"o{i}x{j}" for j in range(9 if i % 2 else 4)])) for i in range(60)]
    check(spark, docs)


def test_no_rows(spark):
    assert setjoin.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "")])
    check(spark, [(1, "only one text with some words"), (2, "and another text of other words")])


def test_elements_by_hash_of_words():
    """Words are told apart by all their bytes and their order, also those that defeat polynomial hashes."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    words = [a, a.translate({97: 98, 98: 97}), "a", "aa", "ab", "ba", "a" * 8, "a" * 9, "b" + "a" * 8, "a" * 16, "\0", "\0\0"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    stop = np.cumsum([len(w) for w in words])
    got = word_hash(data, stop - [len(w) for w in words], stop)
    assert len(set(got.tolist())) == len(words)
    again = np.frombuffer("".join(reversed(words)).encode(), np.uint8)
    stop = np.cumsum([len(w) for w in reversed(words)])
    assert word_hash(again, stop - [len(w) for w in reversed(words)], stop).tolist() == got.tolist()[::-1]
    assert len(word_hash(data[:0], stop[:0], stop[:0])) == 0
