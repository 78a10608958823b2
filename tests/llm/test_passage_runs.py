"""Passages are verified for many pairs of texts at once: as one pair at a time, word by word."""

import random

import numpy as np
import xxhash

from sluice.llm import passages
from sluice.llm.passage_runs import EDITS, SHINGLE, PairedTexts
from sluice.llm.word_hashes import chunks, hashes_of, split_words


def blocks_of(a, b, seeds):
    """Maximal blocks that hold a seed and, in turn, what edits part from them."""

    def run(i, j):
        before = after = 0
        while i + after < len(a) and j + after < len(b) and a[i + after] == b[j + after]:
            after += 1
        while before < min(i, j) and a[i - before - 1] == b[j - before - 1]:
            before += 1
        return before, after

    found, todo = set(), []
    for i, j in seeds:
        before, after = run(i, j)
        if after and before + after >= SHINGLE:
            todo += [(i - before, j - before, before + after, way) for way in (1, -1)]
    while todo:
        i, j, n, way = todo.pop()
        found.add((i, j, n))
        for x, y in EDITS:
            if way > 0:
                s, t = i + n + x, j + n + y
                if len(a[s : s + SHINGLE]) == SHINGLE and a[s : s + SHINGLE] == b[t : t + SHINGLE]:
                    todo.append((s, t, run(s, t)[1], way))
                    break
            elif i - x >= SHINGLE and j - y >= SHINGLE and a[i - x - SHINGLE : i - x] == b[j - y - SHINGLE : j - y]:
                n = run(i - x, j - y)[0]
                todo.append((i - x - n, j - y - n, n, way))
                break
    return sorted(found)


def stretches(a, b, blocks, similarity, least):
    shingles = lambda words: {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}
    out, reach = [], 0
    for k in range(len(blocks)):
        for m in range(len(blocks) - 1, max(k, reach) - 1, -1):
            part = blocks[k : m + 1]
            s, e, t, f = blocks[k][0], max(i + n for i, _, n in blocks[: m + 1]), min(j for _, j, _ in part), max(j + n for _, j, n in part)
            shared = sum(n - SHINGLE + 1 for _, _, n in part)
            if min(e - s, f - t) < least or shared / max(e - s + f - t - 2 * (SHINGLE - 1) - shared, 1) < similarity:
                continue
            p, q = shingles(a[s:e]), shingles(b[t:f])
            alike = 1.0 if k == m else len(p & q) / len(p | q)
            if alike >= similarity:
                out.append((s, e, t, f, alike))
                reach = m + 1
                break
    return out


def test_pairs_at_once_equal_one_by_one():
    draw, texts, pairs = random.Random(5), [], []
    for k in range(300):
        some = [f"w{draw.randrange(4 if k % 7 == 0 else 900)}" for _ in range(draw.randrange(5, 260))]
        other = list(some)
        for _ in range(draw.randrange(12)):
            at = draw.randrange(len(other) + 1)
            other[at : at + draw.randrange(3)] = [f"x{draw.randrange(50)}" for _ in range(draw.randrange(40 if draw.random() < 0.2 else 3))]
        other = ["y"] * draw.randrange(5) + other
        grams = {tuple(some[i : i + 8]): i for i in range(len(some) - 7)}
        seeds = [(grams[key], j) for j in range(len(other) - 7) if (key := tuple(other[j : j + 8])) in grams and draw.random() < 0.4]
        texts += [some, other]
        pairs.append(seeds)
    n = len(pairs)
    both = PairedTexts([" ".join(t).encode() for t in texts], np.arange(n) * 2, np.arange(n) * 2 + 1)
    row, i, j = (np.array(x, np.int64) for x in zip(*[(k, *seed) for k in range(n) for seed in pairs[k]], strict=True))
    blocks = both.bridged(both.blocks(row, i, j))
    want = [(k, *x) for k in range(n) for x in blocks_of(texts[2 * k], texts[2 * k + 1], pairs[k])]
    assert list(zip(*(x.tolist() for x in blocks), strict=True)) == [(k, i + int(both.a[k]), j + int(both.b[k]), m) for k, i, j, m in want]
    for similarity, least in ((0.8, 50), (0.6, 20)):
        got = sorted(zip(*(x.tolist() for x in both.matched(blocks, similarity, least)), strict=True))
        by_pair = [[x[1:] for x in want if x[0] == k] for k in range(n)]
        assert got == sorted((k, *x) for k in range(n) for x in stretches(texts[2 * k], texts[2 * k + 1], by_pair[k], similarity, least))
        assert len(got) > 100


def test_words_and_hashes_of_many_texts():
    draw = random.Random(3)
    texts = ["", " ", "\x1cone\x85two\xa0three　four ​five six", "x" * 31 + " " + "y" * 32 + " " + "\xe9" * 40, "ΣΑΣ Σ"]
    texts += ["".join(draw.choice("ab\xc2ࠀ   ᠎\xe9 \n") for _ in range(draw.randrange(70))) for _ in range(500)]
    raw = [t.lower().encode() for t in texts]
    assert list(chunks(raw)) == [(0, len(raw))]
    data, start, end, bound = split_words(raw)
    hashes = hashes_of(data, start, end)
    assert [hashes[a:b].tolist() for a, b in zip(bound[:-1], bound[1:], strict=True)] == [[xxhash.xxh64_intdigest(w.lower().encode()) for w in t.split()] for t in texts]
    # Anchors of many texts are those of each.
    h, size = np.array([draw.randrange(30) for _ in range(4000)], np.uint64), [0, 7, 24, 25, 26, 900, 0, 18, 2000]
    bound = np.append(0, np.cumsum([*size, 4000 - sum(size)]))
    at, key = passages.anchored(h, bound, 25)
    each = [(a + x, y) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True) for x, y in zip(*(v.tolist() for v in passages.anchored(h[a:b], np.array([0, b - a]), 25)), strict=True)]
    assert list(zip(at.tolist(), key.tolist(), strict=True)) == each and len(each) > 100


def test_only_units_that_another_text_has_go_on(spark):
    rows = [(1, 10, 0, 5), (1, 10, 9, 5), (2, 20, 3, 6), (3, 30, 4, 6), (3, 30, 8, 7), (4, 20, 3, 8), (5, 50, 1, 6), (6, 60, 0, 9), (6, 61, 0, 9)]
    units = spark.createDataFrame(rows, "id long, h long, at int, key long")
    left = passages.shared_units(units)
    assert sorted(map(tuple, left.collect())) == [r for r in rows if r[3] in (6, 9)]
    assert sorted(map(tuple, passages.with_firsts(left).select("id", "h", "at", "rid", "rh", "rat").collect())) == [(3, 30, 4, 2, 20, 3), (5, 50, 1, 2, 20, 3), (6, 61, 0, 6, 60, 0)]
