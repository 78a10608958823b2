"""The operators against brute force, round trips and held-out labels, with the edges: nulls, empty texts, repeats, ties, empty tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import avi, byte_bpe, hnsw, mixing, passages, quality, simhash, token_files, trie_counts, warc
from sluice.llm.common import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    rows = [(1, None, None), (2, "", "a"), (3, " \n ", "b"), (4, "one", "a"), (4, "one", "a"), (None, prose(rng, 30), "b"), (5, prose(rng, 20000), "c")]
    return made(spark, rows + [(10 + i, prose(rng, 80), rng.choice("abc")) for i in range(40)])


def test_components(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_mix_meets_targets(spark, edges):
    out = mixing.mix(edges).collect()
    assert len(out) == edges.count() and all(r.taken <= 3 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    assert abs(sum({r.source: r.target for r in out}.values()) - total) < 1e-6
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.05 * own[0].target + 64
    assert mixing.mix(edges.limit(0)).count() == 0
    assert mixing.repeated(edges).columns == edges.columns


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(20)]
    rows = [(i, t, "a") for i, t in enumerate(base + [t + " extra" for t in base] + base + [None, "", "A b", "a B"])]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(made(spark, rows), 3, 2).collect()}
    prints = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    comp = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    comp[i] = min(comp[i], comp[j])
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i in prints}


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "a") for i in range(150)]
    copies = [(1000 + i, " ".join([*t.split()[:60], "changed", *t.split()[61:]]), "a") for i, t, _ in rows[:50]]
    docs = made(spark, rows + copies + [(2000, rows[0][1], "a"), (None, rows[0][1], "a")])
    kept = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert {i for i, _, _ in rows} | {None} <= kept
    assert len(kept & {i for i, _, _ in copies}) <= 1 and 2000 not in kept


def test_near_copies_by_exact_similarity(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = prose(rng, 400).split()
        changed = list(words)
        for k in range(8 + i % 2):  # 8 replaced words leave 0.817, 9 leave 0.796
            changed[20 + 40 * k] = "changed"
        rows += [(i, " ".join(words), "a"), (1000 + i, " ".join(changed), "a")]
    kept = {r.doc_id for r in simhash.drop_near_copies(made(spark, rows)).collect()}
    assert {1000 + i for i in range(60) if i % 2} | set(range(60)) <= kept
    assert len(kept & {1000 + i for i in range(0, 60, 2)}) <= 2


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x y", "same"), (2, None, "same"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\r\nb é")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w")))
    assert captures.where("request is not null and metadata is not null").count() == 5
    got = {r.page_id: r for r in warc.resolve(captures).collect()}
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes, got[1].payload_digest) == ("revisit", 2, 4, digest(b"same"))
    assert (got[3].record_type, got[3].refers_to, got[4].record_type, got[4].refers_to) == ("revisit", 4, "response", None)
    assert got[5].payload_digest == digest("a\r\n\r\nWARC/1.1\r\nb é".encode())


def test_passages_equal_brute_force(spark):
    rng = random.Random(11)
    shared = [prose(rng, 60) for _ in range(5)]
    texts = [" ".join([prose(rng, rng.randrange(20, 90)), shared[i % 5], prose(rng, 30)]) if i % 3 == 0 else prose(rng, 150) for i in range(60)]
    docs = made(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(90, None, "a"), (91, "", "a"), (None, texts[0], "a")])
    found = passages.repeated_passages(docs.select("doc_id", "text")).collect()
    assert {r.doc_id for r in found} == {i for i in range(60) if i % 3 == 0}
    assert len({r.component_id for r in found}) == 5
    kept = {r.doc_id: r.text for r in passages.drop_repeats(docs).collect()}
    assert len(kept) == 63 and all(kept[i] == texts[i] for i in range(60) if i % 3)
    assert all(sum(s in (kept[i] or "") for i in range(60)) == 1 for s in shared)


def test_passages_with_differing_words_between(spark):
    rng = random.Random(12)
    rows, pairs = [], []
    for i in range(30):
        one, two = prose(rng, 70), prose(rng, 70)
        between = [prose(rng, 20) for _ in range(2)]
        rows += [(1000 + 2 * i + k, " ".join([prose(rng, 30), one, between[k], two, prose(rng, 30)]), "a") for k in range(2)]
        pairs.append((one, two))
    kept = {r.doc_id: r.text for r in passages.drop_repeats(made(spark, rows)).collect()}
    left = sum(s in kept.get(1001 + 2 * i, "") for i, pair in enumerate(pairs) for s in pair)
    assert left <= 2


def test_every_run_of_equal_words_has_an_anchor():
    rng = random.Random(13)
    run = passages.equal_words()
    assert run == 25
    for k in range(300):
        shared = (prose(rng, run) if k % 3 else " ".join([prose(rng, k % 7 + 1)] * run)).split()[:run]
        texts = [[*prose(rng, 40).split(), *shared, *prose(rng, 40).split()] for _ in range(2)]
        keys = [{key for at, key in zip(*passages.anchors_of(w, run), strict=True) if 40 <= at <= 40 + run - passages.WINDOW} for w in texts]
        assert keys[0] & keys[1]


def test_passages_with_an_edit_and_in_short_periods(spark):
    rng = random.Random(14)
    rows, edited = [], {}
    for i in range(40):
        words = prose(rng, 60 if i % 2 else 50).split()
        changed = [*words[:25], "changed", *words[26:]]
        rows += [(1000 + 2 * i + k, " ".join([prose(rng, 40), " ".join(w), prose(rng, 40)]), "a") for k, w in enumerate((words, changed))]
        edited[1001 + 2 * i] = " ".join(changed)
    line = prose(rng, 4)
    rows += [(2000 + k, " ".join([prose(rng, 40), *[line] * 30, prose(rng, 40)]), "a") for k in range(2)]
    kept = {r.doc_id: r.text for r in passages.drop_repeats(made(spark, rows)).collect()}
    assert not [i for i, s in edited.items() if "changed" in kept[i].split()]
    assert line in kept[2000] and line not in kept[2001]


def test_passages_behind_an_earlier_quote(spark):
    rng = random.Random(15)
    rows, pairs = [], {}
    for i in range(30):
        shared = prose(rng, 60).split()
        quotes = [shared[:40], shared[20:], shared[10:50]]
        rows += [(100 * i + k, " ".join([prose(rng, 40), *q, prose(rng, 40)]), "a") for k, q in enumerate(quotes)]
        rows += [(100 * i + k, " ".join([prose(rng, 40), *shared, prose(rng, 40)]), "a") for k in (50, 51)]
        pairs[100 * i + 51] = " ".join(shared)
    line = prose(rng, 30).split()
    rows += [(10000 + i, " ".join([prose(rng, 40), *line, prose(rng, 40)]), "a") for i in range(100)]
    long = " ".join([*line, prose(rng, 25)])
    rows += [(11000 + k, " ".join([prose(rng, 40), long, prose(rng, 40)]), "a") for k in range(2)]
    kept = {r.doc_id: r.text for r in passages.drop_repeats(made(spark, rows)).collect()}
    assert not [i for i, s in pairs.items() if s in kept[i]]
    assert long in kept[11000] and " ".join(line) not in kept[11001]
    texts = {i: t for i, t, _ in rows}
    assert all(kept[i] == texts[i] for i in texts if i not in pairs and i != 11001)


def test_passages_that_runs_with_other_texts_cover(spark):
    """Two texts share 60 words of which earlier ones quote 40, and what lies in either, left and right, repeats in later texts of their own."""
    rng = random.Random(16)
    rows, pairs = [], {}
    for i in range(10):
        shared = prose(rng, 60).split()
        rows += [(100 * i + k, " ".join([prose(rng, 40), *q, prose(rng, 40)]), "a") for k, q in enumerate((shared[10:50], shared[:40], shared[20:]))]
        for k in (50, 51):
            left, right = prose(rng, 40).split(), prose(rng, 40).split()
            rows.append((100 * i + k, " ".join([*left, *shared, *right]), "a"))
            rows += [(100 * i + k + 10, " ".join([prose(rng, 30), *left, *shared[:35], prose(rng, 30)]), "a"), (100 * i + k + 20, " ".join([prose(rng, 30), *shared[25:], *right, prose(rng, 30)]), "a")]
        pairs[100 * i + 51] = " ".join(shared)
    kept = {r.doc_id: r.text for r in passages.drop_repeats(made(spark, rows)).collect()}
    assert not [i for i, s in pairs.items() if s in kept[i]]
    texts = {i: t for i, t, _ in rows}
    assert all(kept[i] == texts[i] for i in texts if i % 100 < 51)


def test_passages_of_which_many_quote_either_half(spark):
    """60 words, one of them replaced in the second text, and each half quoted by 80 earlier texts, which have under 50 words in common with any."""
    rng = random.Random(17)
    rows, pairs = [], {}
    for i in range(10):
        shared = prose(rng, 60).split()
        rows += [(1000 * i + k, " ".join([prose(rng, 30), *(shared[:30] if k % 2 else shared[30:]), prose(rng, 30)]), "a") for k in range(160)]
        changed = [*shared[:30], "changed", *shared[31:]]
        rows += [(1000 * i + 500 + k, " ".join([prose(rng, 30), *w, prose(rng, 30)]), "a") for k, w in enumerate((shared, changed))]
        pairs[1000 * i + 501] = "changed"
    kept = {r.doc_id: r.text for r in passages.drop_repeats(made(spark, rows)).collect()}
    assert not [i for i, s in pairs.items() if s in kept[i].split()]
    texts = {i: t for i, t, _ in rows}
    assert all(kept[i] == texts[i] for i in texts if i not in pairs)


def test_places_with_a_further_anchor_in_common_all_meet(spark):
    """80 texts share 30 words on either side of a word of their own: every two of them are paired."""
    rng = random.Random(23)
    left, right = prose(rng, 30), prose(rng, 30)
    docs = made(spark, [(i, f"{left} x{i} {right}", "a") for i in range(80)])
    docs = docs.select(F.struct("doc_id", F.lit(0).cast("long")).cast("struct<id:long,h:long>").alias("doc"), "text")
    crowded = docs.select("doc.id", "doc.h", F.lit(0).alias("at"), F.lit(1).cast("long").alias("key"), F.col("doc.id").alias("label"))
    got = passages.together(docs, crowded, 25, 66).select("id", "rid").distinct().collect()
    assert sorted(map(tuple, got)) == [(i, k) for i in range(80) for k in range(i)]


def test_hub_keys_give_the_same_pairs(spark, monkeypatch):
    """Units of frequent keys, with one label, one text or several, meet the same others whether their firsts are broadcast or joined."""
    rng = random.Random(5)
    rows = [(rng.randrange(9), 0, at, 1 if at % 3 else rng.randrange(12), rng.randrange(2)) for at in range(90)]
    rows += [(i, 0, 200, 50, 7) for i in range(20)] + [(1, 0, at, 51, at % 2) for at in range(300, 320)]
    units = spark.createDataFrame(rows, "id long, h long, at int, key long, label long").cache()
    got = []
    for least in (2, 10**9):
        monkeypatch.setattr(passages, "LEAST_HUB", least)
        got.append([sorted(map(tuple, passages.grouped_pairs(units, bucket).collect())) for bucket in (2, 8)] + [sorted(map(tuple, passages.unlinked_first_pairs(units).collect()))])
    assert got[0] == got[1] and all(got[0])


def test_trie_counts_equal_brute_force():
    rng = random.Random(2)
    scores = trie_counts.zipf_scores([bytes([b]) for b in b"abc"] + [bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 5))) for _ in range(30)])
    trie = trie_counts.PrefixTrie(scores)
    for _ in range(200):
        raw = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        best = [(0.0, 0)]
        for end in range(1, len(raw) + 1):
            best.append(max((best[s][0] + scores[raw[s:end]], best[s][1] - 1) for s in range(end) if raw[s:end] in scores))
        n, score = trie.insert(raw)
        assert abs(score - best[-1][0]) < 1e-9 and n == -best[-1][1]


def test_byte_bpe_equals_the_library(spark, edges):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    for r in byte_bpe.encode(edges, path, public_tokenizers.PATTERN, "doc_id", "text").collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
    bpe = byte_bpe.encoder(path, public_tokenizers.PATTERN).bpe
    raw, more = "ununbelievable".encode(), b"ness  x"
    last = bpe.prefixes(raw)
    assert bpe.append(raw, last, more)[1] == bpe.prefixes(raw + more)
    edited, again = bpe.replace(raw * 9, bpe.prefixes(raw * 9), 3, 5, b"zz")
    assert again == bpe.prefixes(edited)


def test_avi_round_trip_and_shots(spark, edges):
    for text in (None, "", "é" * 999, "x" * 576):
        payload = avi.payload_of(text)
        fps, frames = avi.read_avi(avi.write_avi(avi.encode_frames(payload)))
        assert avi.decode_frames(frames).tobytes() == payload and fps == 25
    still = np.concatenate([np.full((20, 24, 24), 10, np.uint8), np.full((20, 24, 24), 200, np.uint8)])
    assert [s[2:] for s in avi.shots(avi.histograms(still), 25)] == [(0, 20), (20, 20)]
    with pytest.raises(ValueError, match="histogram"):
        avi.shots(still, 25)
    assert avi.clips(avi.to_media(edges, "doc_id"), "doc_id").count() >= edges.count()


def test_shots_by_hand():
    """Cuts where a scene's grey level jumps, none in a slow fade; times by the frames' number."""
    rng = np.random.default_rng(6)
    scenes = [(12, 30), (9, 120), (25, 220)]
    frames = np.concatenate([np.clip(rng.normal(level, 2, (n, 24, 24)), 0, 255).astype(np.uint8) for n, level in scenes])
    assert avi.shots(avi.histograms(frames), 10) == [(0.0, 1.2, 0, 12), (1.2, 2.1, 12, 9), (2.1, 4.6, 21, 25)]
    fade = np.stack([np.full((24, 24), 3 * k, np.uint8) for k in range(60)])
    noisy = np.clip(fade.astype(int) + rng.integers(-24, 25, fade.shape), 0, 255).astype(np.uint8)
    assert [s[2:] for s in avi.shots(avi.histograms(noisy), 10)] == [(0, 60)]


def test_quality_on_held_out_labels(spark):
    out = quality.op8_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert out.count() == 200 and all(0 <= r.score <= 1 for r in out.collect())
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    assert quality.quality_scores(out.limit(1).select("doc_id", F.lit(None).cast("string").alias("text")), labels.limit(0)).first().score == 0.5


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_hnsw_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[100:400] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).toPandas()
    exact = v.astype(float) @ v.astype(float).T
    hits = 0
    for q, part in got.groupby("query_id"):
        order = [i for i in np.lexsort((np.arange(1500), -exact[q])) if i != q][:20]
        hits += len(set(order) & set(part.vec_id))
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, 21))
    assert hits >= 0.9 * 20 * got.query_id.nunique() and got.query_id.nunique() == 75
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(101, 121))


def test_token_files(spark, edges, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(edges.select("doc_id", "text"), str(tmp_path / "t"), path, files=3)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    known, start = Tokenizer.from_file(path), 0
    rows = sorted(edges.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*known.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    ids = np.random.default_rng(0).integers(0, 2**32, 70001, dtype=np.uint32)
    assert all((token_files.unpack_block(token_files.pack_block(ids, bits)) == ids).all() for bits in (True, False))
    assert token_files.joined_crc(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_pipeline_stages_keep_columns(spark, edges):
    docs = edges
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == edges.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, SF).count() == docs.count() > 0
