"""Whole queries against brute force or their SQL, and the edges that every operator has: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import base64
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sluice.llm import avi, byte_bpe, common, hnsw, mixing, passages, quality, queries, simhash, token_files, trie_counts, warc

from ..test_catalog import rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def made(spark, found):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in found], DOCS)


def same_words(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    with duckdb.connect() as c:
        for t in ("documents", "pages"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        theirs = c.execute(queries.ORACLES[name])
        expected = rows([d[0] for d in theirs.description], theirs.fetchall())
    assert rows(df.columns, map(tuple, df.collect())) == expected and sum(expected[1].values()) > 0


# ---------------------------------------------------------------- op1


def targets_of(found, weights=(5, 2, 1), cap=3.0):
    """source -> (size, target), by filling up source after source."""
    size = defaultdict(int)
    for _, text, source in found:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(size.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > cap * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: cap * size[s] for s in full}
        left -= sum(cap * size[s] for s in full)
        open_ -= full
    return {s: (size[s], target[s]) for s in order}


def checked_mix(spark, found):
    got = mixing.mix(made(spark, found)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(WORD.findall(t or ""))) for i, t, _ in found)
    for source, (size, target) in targets_of(found).items():
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size} and all(math.isclose(r.target, target, rel_tol=1e-9) for r in own)
        # To a block: of 16 words in corpora this small, and of a sixty-fourth of a small source.
        assert abs(sum(r.taken for r in own) - target) <= max(1, min(16, size / 64)) + 1e-6, (source, size, target)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    return got


def test_mix_of_the_documents(spark):
    checked_mix(spark, [(d["doc_id"], d["text"], d["source"]) for d in documents()])


def test_small_sources_and_missing_ids_meet_their_targets(spark):
    rng = random.Random(1)
    found = [(i, same_words(rng, 300), "b big") for i in range(60)]
    for k, n in enumerate((1, 2, 17, 20, 33, 70, 150)):
        found.append((1000 + k, same_words(rng, n), f"a {n:03}"))
    found += [(None, same_words(rng, 40), None) for _ in range(50)] + [(2000, "", "c"), (2001, None, "c")]
    one = checked_mix(spark, found)
    again = mixing.mix(made(spark, found).repartition(7)).collect()
    key = lambda r: (r.doc_id, r.source, r.text_hash, r.taken)
    assert Counter(map(key, one)) == Counter(map(key, again))


# ---------------------------------------------------------------- components


def test_hubs_of_components(spark, monkeypatch):
    rng = random.Random(2)
    pairs = [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(5001, 5400)] + [(299, 700), (rng.randrange(300), 701)] + [(i, i + 1) for i in range(8000, 8040)]
    monkeypatch.setattr(common, "LEAST_HUB", 50)
    monkeypatch.setattr(common, "MOST_HUBS", 10)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: 0 if n < 5000 else 5000 if n < 8000 else 8000 for pair in pairs for n in pair}


def test_settled_results_stand_alone(spark):
    paths = []

    @common.settled("outer")
    def outer():
        first = common.written(spark.range(5), "first")
        paths.extend(first.inputFiles())
        return first.join(inner(), "id")

    @common.settled("inner")
    def inner():
        return common.written(spark.range(3), "second")

    assert outer().count() == 3 and paths and not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths)


# ---------------------------------------------------------------- near copies


def test_group_of_near_copies_is_linked_by_few_pairs(spark, monkeypatch):
    rng, pairs = random.Random(4), []
    kept_alike = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda p, *a: (pairs.append(p.count()), kept_alike(p, *a))[1])
    words = [f"w{i}" for i in range(3000)]
    base, found = [rng.choice(words) for _ in range(150)], []
    for _ in range(900):
        copy = list(base)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(150)] = rng.choice(words)
        found.append(" ".join(copy))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in found]
    place = {g: i for i, g in enumerate(set().union(*sets))}
    grid = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        grid[i, [place[g] for g in s]] = 1
    both, size = grid @ grid.T, grid.sum(1)
    near = both / (size[:, None] + size - both) >= 0.8 - 1e-6
    label = np.arange(len(sets))
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    kept = simhash.drop_near_copies(made(spark, [(i, t, "a") for i, t in enumerate(found)])).count()
    true = len(set(label.tolist()))
    assert true <= kept <= true + 0.03 * len(found)
    assert sum(pairs) < 40 * len(found)


@pytest.mark.parametrize("n", [600, 1200])
def test_copies_among_texts_of_one_form_are_found(spark, n):
    """All texts share 200 words (0.7 to each other), and each has one copy at 0.85: found however many there are."""
    rng = random.Random(9)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    form, found = words(200), []
    for i in range(n // 2):
        one = form + words(43)
        two = list(one)
        for at in rng.sample(range(0, 243, 5), 4):
            two[at] = f"x{rng.randrange(10**6)}"
        found += [(2 * i, " ".join(one), "a"), (2 * i + 1, " ".join(two), "a")]
    kept = {r.doc_id for r in simhash.drop_near_copies(made(spark, found)).collect()}
    assert all(2 * i in kept for i in range(n // 2))
    assert sum(2 * i + 1 not in kept for i in range(n // 2)) >= 0.99 * (n // 2)


def test_groups_in_one_crowded_bucket_are_found(spark):
    """Ten groups of three near copies stand in one bucket that has room for two: more groups than pivots, and what a group shares, more than two of it have."""
    rng = random.Random(19)
    found = []
    for i in range(10):
        one = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        found += [(3 * i + k, " ".join([*one[: 99 - k], f"x{i}-{k}", *one[100 - k :]])) for k in range(3)]
    texts = spark.createDataFrame(found, "id long, text string")
    nodes = texts.select("id", F.lit(0).cast("long").alias("f0"))
    links = simhash.near_links(nodes, 1, [simhash.Partition(tuple(range(16)), 0)], 0, texts, 5, 0.8, bucket=2)
    got = common.connected_components(links).collect()
    assert sorted((r.node, r.component) for r in got) == [(i, i // 3 * 3) for i in range(30)]


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(5)
    text, other, third = (same_words(rng, 80) for _ in range(3))
    docs = made(spark, [(1, text, "a"), (5, text, "a"), (5, other, "a"), (6, third, "b"), (6, third, "a"), (None, text, "a")]).withColumns({"id": F.lit(1), "h": F.lit(2), "__id": F.lit(3), "__h": F.lit(4), "__no": F.lit(5)})
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text == other, r.source) for r in kept.collect()) == [(0, False, "a"), (1, False, "a"), (5, True, "a"), (6, False, "a")]


# ---------------------------------------------------------------- passages


def test_link_behind_scattered_pieces(spark):
    for seed in range(3):
        rng = random.Random(seed)
        shared = [f"s{rng.randrange(5000)}" for _ in range(70)]
        pieces = " ".join(" ".join([same_words(rng, 20, 5000), *shared[a : a + 25]]) for a in (0, 15, 30, 45))
        docs = made(spark, [(1, pieces, "a")] + [(k, f"{same_words(rng, 30, 5000)} {' '.join(shared)} {same_words(rng, 30, 5000)}", "a") for k in (2, 3)])
        found = passages.repeated_passages(docs).collect()
        assert {2, 3} <= {r.doc_id for r in found if r.component_id == 2}


def test_second_copy_inside_a_text_goes_too(spark):
    rng = random.Random(6)
    shared = same_words(rng, 60, 5000)
    docs = made(spark, [(1, f"{same_words(rng, 40)} {shared}", "a"), (2, f"{shared} {same_words(rng, 40)} {shared} {same_words(rng, 20)}", "a")])
    assert shared not in {r.doc_id: r.text for r in passages.drop_repeats(docs).collect()}[2]


def test_whole_copies_and_a_very_long_text(spark):
    rng = random.Random(7)
    long, short = same_words(rng, 30_000, 9000), same_words(rng, 30, 9000)
    docs = made(spark, [(1, long, "a"), (2, long, "a"), (3, short, "a"), (4, short, "a"), (5, f"{same_words(rng, 30, 9000)} {' '.join(long.split()[10_000:10_060])}", "a")]).withColumn("__h", F.lit(1))
    kept = {r.doc_id: r.text for r in passages.drop_repeats(docs).collect()}
    assert set(kept) == {1, 3, 4, 5} and kept[1] == long and len(kept[5].split()) == 30
    assert passages.repeated_passages(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- warc


def test_archives_of_edge_pages(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://a/", "x"), (7, "http://a/", "x"), (3, "http://b/", "x"), (None, "http://c/", "x"), (9, None, "y" * 300_000), (10, "http://d/", "WARC/1.1\r\n\r\n")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=1000)
    assert len(list((tmp_path / "w").glob("*.gz"))) > 1
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w")))
    assert captures.count() == 6 and captures.where("request.url is null or metadata.octets is null").count() == 0
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolve(captures).collect()), key=str)
    assert got == sorted([(0, "revisit", 7, 1), (3, "revisit", 7, 1), (7, "response", None, 1), (7, "response", None, 1), (9, "response", None, 300_000), (10, "response", None, 12)], key=str)
    small = warc.plan_records(pages, least_revisit_bytes=2)
    assert small.where("refers_to is not null").count() == 0
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.resolve(warc.assemble(warc.read_archives(spark, str(tmp_path / "none")))).count() == 0


# ---------------------------------------------------------------- token counts


def test_token_counts_equal_a_plain_dynamic_program(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    scores, longest = trie_counts.zipf_scores([t for _, t in ranked]), max(len(t) for _, t in ranked)
    pattern, known = regex.compile(public_tokenizers.PATTERN), {}

    def best(raw):
        if raw not in known:
            at = [(0.0, 0)]
            for end in range(1, len(raw) + 1):
                at.append(max((at[s][0] + scores[raw[s:end]], at[s][1] - 1) for s in range(max(0, end - longest), end) if raw[s:end] in scores))
            known[raw] = at[-1]
        return known[raw]

    docs = {d["doc_id"]: d["text"] for d in documents()[:60]}
    got = trie_counts.op5_token_counts(spark, SF).where(F.col("doc_id").isin(*docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        found = [best(p.encode()) for p in pattern.findall(docs[r.doc_id] or "")]
        assert (r.n_bytes, r.n_pretokens, r.n_tokens) == (len((docs[r.doc_id] or "").encode()), len(found), -sum(n for _, n in found))
        assert abs(r.log_probability - math.fsum(s for s, _ in found)) < 1e-4


# ---------------------------------------------------------------- byte-level BPE


def test_long_pieces_take_time_in_proportion():
    bpe = byte_bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng, took = random.Random(3), {}
    for n in (20_000, 80_000):
        text = "".join(rng.choice("abcdefghij") for _ in range(n))
        began = time.process_time()
        count, joined = bpe.encode(text)
        took[n] = time.process_time() - began
        assert bpe.decode([int(i) for i in joined.split(",")]) == text.encode()
    assert took[80_000] < 10 * took[20_000] + 0.5


# ---------------------------------------------------------------- media


def test_media_digests_of_the_documents(spark):
    docs = {d["doc_id"]: d["text"] for d in documents()}
    got = avi.op7_avi_media(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        media = avi.write_avi(avi.encode_frames(payload))
        _, frames = avi.read_avi(media)
        cut = avi.shots(avi.histograms(np.frombuffer(payload, np.uint8).reshape(-1, 24, 24)), 25)
        assert avi.decode_frames(frames).tobytes() == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.startswith(f"{len(frames)} frames, {len(cut)} shots")


def test_blocks_of_frames_join(monkeypatch):
    payload = avi.payload_of("".join(chr(33 + i * i % 90) for i in range(9000)))
    _, frames = avi.read_avi(avi.write_avi(avi.encode_frames(payload)))
    monkeypatch.setattr(avi, "FRAMES_AT_ONCE", 5)
    blocks = list(avi.decoded(frames))
    assert len(blocks) == -(-len(frames) // 5) and b"".join(b.tobytes() for b in blocks) == payload


# ---------------------------------------------------------------- quality


def test_summed_equations_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, quality.N_STATISTICS))
    y = (x[:, 0] + 0.3 * rng.standard_normal(400) > 0).astype(float)
    frame = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "stats array<double>, y double").repartition(5)
    model = quality.fit(frame, F.lit(False))
    z = quality.fourier(x, model.mean, model.scale, model.omega, model.phase)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3)
    ridge = quality.RIDGE * len(x) / z.shape[1] * np.eye(z.shape[1])
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)
    assert (np.diff(model.levels) >= 0).all()
    # Fourier features stand for a Gaussian kernel.
    a = (x - model.mean) / model.scale
    kernel = np.exp(-((a[:50, None] - a[None, :50]) ** 2).sum(2) / (2 * quality.N_STATISTICS))
    assert np.abs(z[:50, :-1] @ z[:50, :-1].T - kernel).max() < 0.35


def test_quality_sees_the_text_alone(spark):
    docs = made(spark, [(1, None, "a"), (2, "", "b"), (3, "x " * 50_000, "c"), (None, "a b c", "a"), (3, "other", "d")])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (99, 1), (2, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.accepted(docs.withColumn("score", F.lit(1)), labels).columns == [*docs.columns, "score"]
    assert quality.accepted(docs.limit(0), labels).count() == 0 and quality.accepted(docs, labels.limit(0)).count() == 5


# ---------------------------------------------------------------- nearest neighbours


def test_rows_of_one_id_take_nobodys_place(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((230, 8))
    v[:30] *= 3
    ids = [20] * 30 + list(range(1001, 1201))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    for most in (512, 2):
        monkeypatch.setattr(hnsw, "MOST_NAMESAKES", most)
        got = hnsw.nearest(df, F.col("id") == 20).collect()
        assert len(got) == 30 * 20 and all(r.vec_id != 20 for r in got)
        exact = Counter()
        for q in v[:30]:
            exact.update(sorted(range(30, 230), key=lambda i: -(v[i] @ q))[:20])
        found = Counter(ids.index(r.vec_id) for r in got)
        assert sum((exact & found).values()) >= 0.95 * 600
    assert hnsw.nearest(df.limit(0), F.col("id") == 20).count() == 0


# ---------------------------------------------------------------- token files


def test_tokens_equal_the_library_on_hostile_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    known, own, rng = Tokenizer.from_file(path), token_files.CachedTokenizer(path), random.Random(1)
    parts = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", "\x1f", "\x01", "\x00", "'s", "'S", "'re", "'", "1", "²", "½", "ª", "ß", "İ", "ǅ", "ſ", "<|endoftext|>", "<|EndOfText|>", "<|", "|>", "!", "’", "中文", "é", "ﬁ", "​", "😀", "١", ",", ".", " . ", "word", "\x0b", "\x0c", "\r", "µ", "\xad"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["".join(chr(rng.randrange(1, 0x260)) for _ in range(30)) for _ in range(2000)]
    for text in texts:
        assert own.encode(text) == np.array(known.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


# ---------------------------------------------------------------- the pipeline


def test_pipeline_runs_from_end_to_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    told = kept.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() and told > 0.9
    out = corpus_pipeline.run(spark, SF)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0
    assert out.where("n_tokens != size(ids)").count() == 0 and byte_bpe.load_ranks(path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_extra_columns_and_edge_rows(spark):
    rng = random.Random(9)
    edge = [(1, None, None), (2, "", "a"), (3, " \n ", "b"), (4, "one", "a"), (4, "one", "a"), (None, same_words(rng, 30), "b"), (5, same_words(rng, 20_000), "c")] + [(10 + i, same_words(rng, 80), "abc"[i % 3]) for i in range(20)]
    docs = made(spark, edge).withColumns({c: F.lit(1) for c in ("__id", "__h", "__spans", "__hash", "__source", "__times", "__rows", "__copy", "id", "h", "key", "score", "n", "group")})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()


def test_outliers_of_a_group_make_few_rows(spark, monkeypatch):
    """Texts that differ from one text in 7 to 10 of 150 words are mostly no near copies of one another: what stays is what all pairs would leave, and few pairs become rows."""
    rng = random.Random(47)
    base = [f"v{rng.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(7, 11)):
            words[k] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "a"))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t, _ in rows]
    group = list(range(250))
    for _ in range(3):
        for i in range(250):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    seen, plain = [], simhash.possible

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(simhash, "possible", counted)
    kept = {r.doc_id for r in simhash.drop_near_copies(made(spark, rows)).collect()}
    assert kept == {i for i in range(250) if group[i] == i} and len(kept) > 200
    assert seen[0] < 1000


def test_places_that_cannot_repeat_make_no_rows(spark):
    """Each with each of 80 places under one key: those pairs alone are left out that no passage can hold, and what is equal over 50 words or with one edit is kept, once."""
    rng = random.Random(48)
    base = [f"v{rng.randrange(3000)}" for _ in range(300)]
    texts = []
    for i in range(80):
        words = list(base)
        for k in range(i % 7, 300, 12 + i % 5):  # no 50 words of two texts with one edit at most
            words[k] = f"new{i}-{k}"
        texts.append(words)
    texts[7], texts[60] = list(base), [*base[:140], "more", *base[140:]]
    texts[61][100:200] = texts[62][100:200] = [f"own{k}" for k in range(45)] + base[145:165] + ["some", "thing"] + [f"own{k}" for k in range(67, 100)]
    texts[62][170] = "edited"

    def around(words):
        grams = passages._grams(np.array([passages._hashes[w] for w in words], np.uint64), 5)
        padded = np.concatenate([np.zeros(104, np.uint8), (grams % 255 + 1).astype(np.uint8), np.zeros(109, np.uint8)])
        return padded[150:358].view(np.int64).tolist()

    rows = [(i, 0, 150, key, i, around(t), [5, 9]) for i, t in enumerate(texts) for key in (5, 9)]
    units = spark.createDataFrame(rows, "id long, h long, at int, key long, label long, around array<long>, others array<long>")
    got = [(r.id, r.rid) for r in passages.pairs_in_blocks(units, 0.8, 50).collect()]
    assert {(60, 7), (62, 61)} <= set(got) and len(got) == len(set(got)) < 300


def test_blocks_take_counts_that_are_there(spark, monkeypatch):
    """Rows that come with the size of their group are not joined with it again, and meet as they do without it."""
    plans, plain = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, name))[1])
    rows = spark.createDataFrame([(k, i, 10 * i, 40) for k in (1, 2) for i in range(40)], "key long, id long, label long, n long")
    got = [sorted((r.key, min(i, j), max(i, j)) for r in common.block_pairs(df, 8, "id", "label").collect() for i in r.aid for j in r.bid) for df in (rows, rows.drop("n"))]
    assert got[0] == got[1] and {x for x in got[0] if x[1] < x[2]} == {(k, i, j) for k in (1, 2) for j in range(40) for i in range(j)}
    assert "Join" not in plans[0]


def test_groups_are_sized_once(spark, monkeypatch):
    """Pairs of groups read a written table: what puts a size beside each unit does not run again for every use."""
    units = spark.createDataFrame([(i, 0, 5, i % 7, i) for i in range(70)], "id long, h long, at int, key long, label long")
    got = passages.grouped_pairs(units, 8)
    assert got.count() == 63 and got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4


def test_what_was_shuffled_for_a_written_table_goes_at_once(spark):
    """No shuffle file is left when a table is written, and the session's setting is as it was."""
    local = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: {os.path.join(d, x) for d, _, found in os.walk(local) for x in found if x.startswith("shuffle_")}
    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    table = common.written(spark.range(10_000).repartition(5, "id"), "dealt")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common.CLEANUP, None) == setting
    assert table.count() == 10_000
