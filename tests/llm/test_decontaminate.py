"""Leaks against a comparison of every item with every place of every text, without seeds."""

import random
from itertools import combinations

from arterial.llm import decontaminate

from . import brute


def all_leaks(docs, items, window=16, percent=80):
    """doc -> [(item, first token, per mille)] of the best windows"""
    tok = lambda t: [x.decode().lower() for x in brute.TOKEN.findall((t or "").encode())]
    out = {}
    for d, t in docs:
        text, found = tok(t), []
        for i, item in ((i, tok(x)) for i, x in items):
            size = min(window, len(item))
            best = (0, 0, 0)
            for g in range(-len(item), len(text)) if size else ():
                for p in range(max(g, 0), min(g + len(item), len(text)) - size + 1):
                    most = sum(text[p + j] == item[p - g + j] for j in range(size))
                    best = max(best, (most, -g, -p))
            if best[0] * 100 >= percent * size > 0:
                found.append((i, -best[2], best[0] * 1000 // size))
        out[d] = sorted(found)
    return out


def found_leaks(spark, docs, items, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(df, bench, **how).collect()
    return {r.doc_id: sorted((x.item_id, x.first_token, x.per_mille) for x in r.leaks) for r in rows}


def replaced(words, places):
    return " ".join(f"new{j}" if j in places else w for j, w in enumerate(words))


def test_short_items_match_brute_force(spark):
    rng = random.Random(5)
    words = lambda n, most=40: [f"w{rng.randrange(most)}" for _ in range(n)]
    known = [words(n) for n in (1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 20)]
    items = [(i, " ".join(w)) for i, w in enumerate(known)]
    items += [(50, items[4][1].upper()), (51, items[4][1] + "!"), (52, "?!"), (53, ""), (54, None), (55, "w1 w1 w1 w1 w1")]
    docs = [(0, None), (1, ""), (2, "w1"), (3, "w1 w1 w1 w1 w1 w1"), (4, "w1 w2"), (5, "w1 w1 w1 w1")]
    for i, w in enumerate(known):
        for g in ((), (0,), (len(w) // 2,), (len(w) - 1,), (0, len(w) - 1)):
            docs.append((len(docs), " ".join(words(6, 400)) + "\n" + replaced(w, g)))
            docs.append((len(docs), replaced(w, g)))
    docs += [(len(docs) + k, " ".join(words(60, 12))) for k in range(5)]
    got = found_leaks(spark, docs, items)
    assert got == all_leaks(docs, items)
    assert {i for x in got.values() for i, *_ in x} == {*range(12), 50, 51, 55}
    assert found_leaks(spark, docs, items, window=6, percent=66) == all_leaks(docs, items, 6, 66)


def test_masks_are_lossless_for_every_size():
    for size in range(1, 17):
        masks = decontaminate.MASKS if size >= decontaminate.LEAST else decontaminate.whole_masks(size, 80)
        for gone in combinations(range(size), size * 20 // 100):
            assert any(
                all(m[j] == "0" or p + j not in gone for j in range(len(m))) for m in masks for p in range(size - len(m) + 1)
            ), (size, gone)


def test_items_below_a_window_match_brute_force(spark):
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(8, 16)] + [(30, " ".join(f"long{j}" for j in range(30)))]
    docs = []
    for _, t in items[:3]:
        w = t.split()
        docs += [(len(docs) + k, "a b c " + replaced(w, g) + " d") for k, g in enumerate(combinations(range(len(w)), 2))]
    rng = random.Random(3)
    for _, t in items[3:] * 4:
        w = t.split()
        docs.append((len(docs), "a b " + replaced(w, rng.sample(range(len(w)), len(w) // 5))))
        docs.append((len(docs), replaced(w, rng.sample(range(len(w)), len(w) // 5 + 1))))
    got = found_leaks(spark, docs, items)
    assert got == all_leaks(docs, items)
    assert sum(bool(x) and x[0][0] == 10 for x in got.values()) == 45
