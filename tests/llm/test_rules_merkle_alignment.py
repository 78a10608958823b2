"""Quality rules, Merkle manifests and token alignment against brute force, and edges of the queries."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sluice.llm import alignment, avi, byte_bpe, merkle, queries, rules, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "a  b", "  x", "x  ", "\n\na b\n", "a\tb \t c", "a b c　d", "x\x0by\x0cz\x1cw", "é ü ñ", "😀 😀😀 x", "<s> hi </s> <|endoftext|> x", "▁a ▁b", "a▁b c", "it's don't 's 'll", "x\x00y z", "ﬁ ½ ①", "12 345 6,7 - -- x", "﻿x y", "#*$%&|<> a|b", "same line\nsame line\n\n \nsame line\nother"]


@pytest.fixture(scope="module")
def documents():
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- quality rules


def counts_of(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(inside)


def test_statistics_equal_brute_force(spark, documents):
    rng = random.Random(3)
    words = lambda n, of: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    texts = [t for _, t, *_ in documents] + ODD + [words(rng.randrange(1, 60), k) for k in (1, 2, 3, 5) for _ in range(10)]
    passage = words(9, 50)
    texts += [f"{words(40, 90)} {passage} {words(3, 90)} {passage}\n{passage}", "ab " * 7, "ab " * 8, "ab " * 9, words(60_000, 40_000), "x" * 200_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in rules.COUNTS) for r in rules.statistics(df.select("doc_id", "text"), "doc_id").collect()}
    assert got == {i: counts_of(t) for i, t in enumerate(texts)}


def test_rules_keep_clean_documents_and_reject_junk(spark):
    """On labels that were held out; the labels themselves and other columns are not looked at."""
    found = {r.doc_id: r for r in rules.op11_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    held = [i for i in labels if i in found and zlib.crc32(str(i).encode()) % 4 == 2]
    right = [found[i].kept == (labels[i] == 1) for i in held if not found[i].base_failed]
    assert len(right) > 50 and sum(right) >= 0.97 * len(right)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in found.values())


def test_the_list_covers_in_turn_and_is_pruned():
    """Two kinds of bad rows, each behind a threshold of its own, and a condition that only the growing rows ask for."""
    cuts = [[] for _ in rules.SHARES]
    cuts[0], cuts[1], cuts[2] = [10.0], [0.5], [0.1, 0.2]
    cell = lambda a, b, c: [a, b, c, *[0] * (len(rules.SHARES) - 3)]
    cells = np.array([cell(0, 0, 0), cell(1, 0, 0), cell(0, 1, 0), cell(0, 1, 2), cell(1, 0, 2)])
    counts = np.array([[90, 0, 40, 0], [0, 30, 0, 12], [0, 20, 0, 9], [1, 0, 0, 9], [0, 5, 0, 2]], float)
    found = rules.learn(cells, counts, cuts)
    names = list(rules.SHARES)
    assert [[(names.index(c.share), c.threshold, c.above) for c in r.conditions] for r in found] == [[(0, 10.0, True)], [(1, 0.5, True)]]
    assert [(r.rejected, r.wrongly) for r in found] == [(49, 0), (38, 1)]
    assert rules.learn(cells, counts * [1, 0, 1, 0], cuts) == []


def test_edges_of_rules(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b " * 30, 3), (2, " ".join(f"w{i}" for i in range(40)), 4), (2, " ".join(f"w{i}" for i in range(40)), 4)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (None, 1), (9, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = rows_of(rules.judged(docs, known), "doc_id", "n_words", "base_failed", "kept")
        assert got == {(1, 0, True, False): 2, (None, 60, True, False): 1, (2, 40, False, True): 2}
    assert rules.judged(docs.limit(0), labels).count() == 0
    # A filter on a result does not compute the statistics again.
    assert rules.judged(docs, labels).where("kept").count() == 2


# ---------------------------------------------------------------- Merkle manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(hashes):
    """Root and, for each leaf, its steps (left siblings, right siblings)."""
    steps, places, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, at in enumerate(places):
            first = at - at % 16
            steps[k].append((level[first:at], level[at + 1 : first + 16]))
        level, places = [sha(*level[i : i + 16]) for i in range(0, len(level), 16)], [at // 16 for at in places]
    return level[0], steps


def manifest_of(found):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n in found:
        low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = leaf_of((doc_id, source, lang, n, text))
        by_source[source].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, leaf_of((doc_id, source, lang, n, low)) if chosen else leaf))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s], key=lambda x: x[0]), *tree([x[2] for x in sorted(by_source[s], key=lambda x: x[0])])) for s in order}
    root, above = tree([trees[s][1] for s in order])
    out = Counter()
    for s, up in zip(order, above, strict=True):
        leaves, subroot, steps = trees[s]
        for (_, doc_id, leaf, now), own in zip(leaves, steps, strict=True):
            path, h = [*own, *up], now
            for left, right in path:
                h = sha(*left, h, *right)
            out[(doc_id, leaf, subroot, root, sha(*[x for left, right in path for x in (*left, *right)]), h, h == root)] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("kind", ["dense", "sparse", "many sources", "one row", "sixteen", "seventeen"])
def test_manifest_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    texts = [None, "", "Abc", "é ÀB c", "lower", "X" * 5000]
    ids = {"dense": lambda i: i, "sparse": lambda i: rng.choice([None, rng.randrange(-(2**63), 2**63), rng.randrange(-9, 9)])}.get(kind, lambda i: i * 7)
    n, sources = {"dense": (700, [None, "", "a", "b"]), "sparse": (400, [None, "s", "é", "z"]), "many sources": (60, [f"s{k}" for k in range(40)]), "one row": (1, ["s"]), "sixteen": (16, ["s"]), "seventeen": (17, [None])}[kind]
    found = [(ids(i), rng.choice(texts), rng.choice([None, "en"]), sources[0] if i % 3 == 0 else rng.choice(sources), rng.choice([None, 3])) for i in range(n)]
    found += found[: n // 5] + found[:3] * (n > 100) * 30  # repeated rows
    if n > 100:
        found += [(5, f"text {k}", "en", sources[-1], k) for k in range(60)]  # one id with many texts
    docs = spark.createDataFrame([(*r, 1, "x") for r in found], f"{DOCS}, leaf int, tree string").repartition(5)
    assert rows_of(merkle.manifest(docs, merkle.tampered_text(), merkle.chosen_rows()), *COLUMNS) == manifest_of(found)


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty, merkle.tampered_text(), merkle.chosen_rows()).count() == 0
    docs = spark.createDataFrame([(1, "A", "en", "s", 1), (2, "B", None, None, None)], DOCS)
    assert all(r.verified for r in merkle.manifest(docs).collect())
    assert merkle.digit_shifts(0, 255) == [0] and merkle.digit_shifts(0, 2**18 - 1) == [8, 0] and merkle.digit_shifts(-1, 0) == [54, 44, 34, 24, 14, 4, 0] and merkle.digit_shifts(5, 5) == [0]


# ---------------------------------------------------------------- alignment


def alignment_of(found):
    a_side, b_side = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a_side.encode_special_tokens = True
    values = alignment.byte_values()
    a_bytes = {i: bytes(values[c] for c in e) for e, i in a_side.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        p = b_side.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    rows, counts = [], Counter()
    for doc_id, text in found:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = a_side.encode(f" {text}", add_special_tokens=False).ids, b_side.encode(text)
            if not b"".join(a_bytes[i] for i in a) == f" {text}".encode() == b"".join(map(b_bytes, b)):
                a, b = [], []
        ends = []
        for ids, size in ((a, lambda i: len(a_bytes[i])), (b, lambda i: len(b_bytes(i)))):
            ends.append({int(e): k for k, e in enumerate(np.cumsum([size(i) for i in ids]))})
        i = j = 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0][e] + 1, ends[1][e] + 1
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        counts.update(links)
        rows.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((d, na, nb, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in rows)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, documents):
    rng = random.Random(4)
    letters = "ab éßЖ中 \t\n'.,12▁😀"
    texts = [t for _, t, *_ in documents[:80]] + ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["x" * 3000, "long word " * 3000]
    found = [(i % 200 or None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in found], "doc_id long, text string, n_a int").repartition(3)
    assert rows_of(alignment.alignment(docs, A_PATH, B_PATH), *ALIGNED) == alignment_of(found)
    assert alignment.alignment(docs.limit(0), A_PATH, B_PATH).count() == 0


def test_frequent_and_rare_pairs_sum_alike(spark):
    rng = random.Random(5)
    rows = [(k, sorted(rng.sample(range(30), 5)) if k % 7 else [3], None) for k in range(300)]
    frame = spark.createDataFrame([(k, x, [rng.randrange(1, 4) for _ in x]) for k, x, _ in rows], "row long, links array<bigint>, times array<int>")
    counts = alignment.link_counts(frame, 10)
    sums = [rows_of(alignment.link_sums(frame, counts, most), "row", "n_best", "count_sum") for most in (1, 20, 100_000)]
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) == 300
    total = Counter()
    for r in frame.collect():
        total.update(dict(zip(r.links, r.times, strict=True)))
    best = {b: max(n for p, n in total.items() if p % 10 == b) for b in range(10)}
    expected = {r.row: (sum(n for p, n in zip(r.links, r.times, strict=True) if total[p] == best[p % 10]), sum(n * total[p] for p, n in zip(r.links, r.times, strict=True))) for r in frame.collect()}
    assert {k[0]: k[1:] for k in sums[0]} == expected


def test_tokens_of_a_piece_do_not_depend_on_what_is_known(documents):
    one, other = alignment.Aligner(A_PATH, B_PATH), alignment.Aligner(A_PATH, B_PATH)
    other.known = alignment.Recent(other.known.make, 50)
    texts = [t for _, t, *_ in documents[:30]]
    assert one.texts(texts) == other.texts(texts) == one.texts(texts)
    assert one.texts(["a\ud800b", None, ""]) == [None, None, None]


# ---------------------------------------------------------------- further edges of earlier operators


def test_round_trip_equals_the_library(spark, documents):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    found = [(d, t) for d, t, *_ in documents] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "x"), (1000, "again"), (1000, "again")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in found], "doc_id long, text string, ids string")
    got = rows_of(byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, "doc_id"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    expected = Counter()
    for i, t in found:
        ids = enc.encode_ordinary(t or "")
        expected[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest())] += 1
    assert got == expected


@pytest.fixture(scope="module")
def no_rows(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(home / f"{t}.parquet"))
    return str(home)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if not n.startswith(("op4_", "op8_"))])
def test_queries_on_empty_tables(spark, no_rows, name):
    assert queries.QUERIES[name](spark, no_rows).count() == 0


def test_a_very_long_text_among_components(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    docs = spark.createDataFrame([(3, long), (1, long.upper()), (2, "short one here"), (4, f"{long} more")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert got == {3: 1, 1: 1, 2: 2, 4: 1}


def test_media_of_nulls(spark):
    media = avi.to_media(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), "doc_id")
    assert rows_of(avi.digest_media(media), "doc_id", "n_bytes", "payload_bytes") == {(1, 0, 576): 1, (2, 0, 576): 2}
    assert media.where(F.length("media") == 0).count() == 0
