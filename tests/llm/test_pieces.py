"""Parts of the operators by themselves, on edge cases."""

import glob
import gzip
import random
import uuid
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tsprobe.llm import imatch, mixing, ngram_join
from tsprobe.llm.common import saved
from tsprobe.llm.components import components
from tsprobe.llm.imatch import fingerprints, likeness
from tsprobe.llm.mixing import mix, shards, share_out, split_quotas, whole_documents
from tsprobe.llm.ngram_join import bands_for, linked, near_duplicates
from tsprobe.llm.packing import best_fit_pack, best_fit_runs
from tsprobe.llm.pretokens import Cache, Encoder, pieces
from tsprobe.llm.quality_model import classify, fit, fit_votes
from tsprobe.llm.quality_rules import clean
from tsprobe.llm.queries import QUERIES
from tsprobe.llm.suffix_dedup import dedup
from tsprobe.llm.suffix_tree import score
from tsprobe.llm.token_counts import count_tokens, frequent_pretokens
from tsprobe.llm.two_stage import common_prefixes, least_owners, suffix_array
from tsprobe.llm.warc import RESPONSE, derive, digest, parse_records, plain_text, responses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, id long, bands string, size string, quality int"
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "a"), (4, " \n\t "), (5, "one two three four five six seven eight"), (6, "one two three four five six seven eight"), (7, LONG), (8, LONG + " end"),
    (9, "  two  spaces\n\n \n x "), (10, "ünï çødé 中文 текст ² ½     end"), (11, "<|endoftext|> in a <|endoftext|>text"), (12, "x" * 5000), (None, "no id here"), (None, None), (5, "one two three four five six seven eight"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{(i or 0) % 2}", None, 1, 2, "b", "s", 0) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bpe():
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXT = st.lists(st.sampled_from([*" \n\t\r\x0b\x1c\xa0\u2028ab'.,!19²é中", "'s", "  ", "<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_give_the_ids_of_the_text(text):
    tokenizer = test_pieces_give_the_ids_of_the_text.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    encoder = test_pieces_give_the_ids_of_the_text.__dict__.setdefault("e", Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    cache = Cache(encoder, list)
    assert [i for x in cache.all(text) for i in x] == tokenizer.encode(text, add_special_tokens=False).ids
    assert " ".join(pieces(text)) == text


def test_every_token_is_what_its_bytes_encode_to(tokenizer, bpe):
    encoder = Encoder(**bpe)
    words = [tokenizer.decode([i]) for i in range(50_256)]
    fast = [w for w in words if w and "�" not in w and max(w) < "ɐ" and "<|" not in w]
    assert [e.ids for e in tokenizer.encode_batch(fast, add_special_tokens=False)] == [encoder.fast.encode_ordinary(w) for w in fast]


def test_worker_cache_forgets(bpe):
    cache = Cache(Encoder(**bpe), len, {"the": 1}, limit=5)
    for i in range(50):
        cache.all(f"a the w{i} z{i}")
    assert len(cache) < 12
    assert cache["the"] == 1


def test_token_counts_of_odd_texts(odd, none, bpe, tokenizer):
    rows = count_tokens(odd, **bpe).collect()
    expected = sorted(((i is None, i or 0), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_tokens) for r in rows) == expected
    assert count_tokens(none, **bpe).collect() == []


def test_best_fit_runs_equal_piecewise_best_fit():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.choice([1, 2, 3, 5, 7, 11, 16, 20, 33, 64]) for _ in range(rng.randrange(1, 200))]
        room: list[int] = []
        for n in sorted(sizes, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= n
            else:
                room.append(64 - n)
        used: dict[int, list] = {}
        histogram = {n: sizes.count(n) for n in set(sizes)}
        for length, first, after, sequence, each, offset in best_fit_runs(histogram, 64):
            for i in range(after - first):
                used.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
        assert len(used) == len(room)
        assert sum(len(x) for x in used.values()) == len(sizes)
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= 64


def test_packing_odd_texts(odd, none, bpe):
    a = best_fit_pack(odd, **bpe).toPandas()
    assert a.length.sum() == sum(r.n_tokens + 1 for r in count_tokens(odd, **bpe).collect())
    assert best_fit_pack(none, **bpe).collect() == []


def test_suffix_array_and_prefixes():
    for seed in range(200):
        rng = random.Random(seed)
        b = bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(1, 300)))
        t = np.frombuffer(b, np.uint8)
        order = suffix_array(t)
        assert sorted(order) == list(range(len(b)))
        keys = [b[i : i + 56].ljust(56, b"\0") for i in order]
        assert keys == sorted(keys)
        for k, (i, j) in zip(common_prefixes(t, order)[1:], zip(order, order[1:])):
            x, y = b[i : i + 56].ljust(56, b"\0"), b[j : j + 56].ljust(56, b"\0")
            assert k == next((m for m in range(56) if x[m] != y[m]), 56)


def test_least_owners():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(120))
    contexts = [base[:60], base[5:70], base[60:120], base[10:70]]
    found = least_owners(contexts, np.array([9, 4, 7, 1]), 50)
    for c, f in zip(contexts, found):
        assert f.tolist() == [min(o for d, o in zip(contexts, [9, 4, 7, 1]) if c[i : i + 50] in d) for i in range(len(c) - 49)]


def dedup_by_hand(rows):
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, int] = {}
    for i, b in data:
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(i, first.get(b[s : s + 50], i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        out.append((len(b), int(gone.sum())))
    return sorted(out)


def test_dedup_odd_texts(spark, odd, none):
    passage = "This passage of more than fifty bytes is found in many documents, ünï. "
    rows = [*ODD, (20, passage), (21, "before " + passage + "after"), (22, passage * 3), (None, passage), (23, "ab" * 400), (24, "ab" * 30)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, _id int")
    a = dedup(docs, ["doc_id", "_id", "text"], block_bytes=1 << 12, with_text=True)
    assert a.columns == ["doc_id", "_id", "text", "repeats"]
    got = a.select("repeats.*").collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == dedup_by_hand(rows)
    assert dedup(none).collect() == []


def test_dedup_with_many_slices(spark, sf_dir):
    """Slices end inside contexts; rows come in any order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r.repeats for r in dedup(docs).collect()}
    small = dedup(docs.repartition(13), block_bytes=1 << 16, slice_bytes=700)
    assert {r.doc_id: r.repeats for r in small.collect()} == whole


def test_near_duplicates_odd_texts(odd, none):
    a = near_duplicates(odd).toPandas()
    assert len(a) == len(ODD)
    five = a[a.doc_id.isin([5, 6])]
    assert (five.class_id == 5).all() and (five.n_links == 2).all()
    assert (a[a.doc_id.isin([7, 8])].class_id == 7).all()
    assert a[a.doc_id == 2].class_id.tolist() == [1]  # null and empty texts are copies
    assert near_duplicates(none).collect() == []


def test_hot_bucket_is_cut_into_tiles(spark):
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(i, base if i % 3 == 0 else base.replace(f"t{i % 55} ", f"u{i} ", 1)) for i in range(700)]
    a = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for _, t in rows]
    for i in (0, 1, 2, 50, 349):
        links = sum(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for j, s in enumerate(sets) if j != i)
        assert a.n_links[i] == links
    assert (a.class_id == 0).all()


def test_empty_chunks_count_no_pair_again(spark, monkeypatch):
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(10 * g + i, f"g{g} " + base.replace("t", f"t{g}x") + f" e{i}") for g in range(6) for i in range(2 + g)]
    monkeypatch.setattr(ngram_join, "links", partial(ngram_join.links, chunk_bytes=200))
    a = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (a.class_id == a.doc_id // 10 * 10).all()
    assert (a.n_links == a.doc_id // 10 + 1).all()


def test_linked_matrix():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(20)]
    m = linked(sets, np.arange(20), 0.5, width=8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert m[i, j] == (len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.5)


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        b, r = bands_for(s, recall)
        assert 1 - (1 - s**r) ** b >= recall and b * r <= 128


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2100)]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_vote_model_finds_labellers():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.6]
    votes = [np.where(rng.random(20_000) < 0.3, "-", np.where((rng.random(20_000) < p) == truth, "1", "0")) for p in right]
    patterns: dict[str, int] = {}
    for v in zip(*votes):
        patterns["".join(v)] = patterns.get("".join(v), 0) + 1
    posterior, rates, share = fit_votes(patterns)
    assert share == pytest.approx(0.7, abs=0.05)
    assert rates[1, :, 0] == pytest.approx(right, abs=0.06)
    guess = np.array([posterior["".join(v)] > 0.5 for v in zip(*votes)])
    assert (guess == truth).mean() > 0.85


def test_quality_model_odd_texts(odd, none):
    docs = odd.drop("quality")
    rows = classify(docs, fit(docs)).collect()
    assert len(rows) == len(ODD)
    assert not any(r.quality.kept for r in rows if not (r.text or "").split())
    assert classify(none.drop("quality"), fit(none.drop("quality"))).collect() == []


def test_quality_rules_by_line(spark, odd, none):
    prose = "This is a sentence of ten words that ends with punctuation. " * 8
    rows = [(1, prose), (2, prose + "\nHome | About | Contact\nPrivacy policy"), (3, "\n".join(["menu item"] * 60)), (4, "a b c d. " * 60)]
    a = {r.doc_id: r for r in clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert a[2].rules.n_navigation == 1 and a[2].rules.n_boilerplate == 1 and a[2].clean_text == prose
    assert a[3].rules.base_failed and a[4].rules.base_failed
    assert len(clean(odd).collect()) == len(ODD) and clean(none).collect() == []


def test_scores_of_odd_texts(odd, none):
    a = score(odd).toPandas()
    assert len(a) == len(ODD) and (a.n_tokens[a.doc_id == 2] == 1).all()
    assert not a.held_out[a.doc_id.isna()].any() and (a.score <= 0).all()
    assert score(none).collect() == []


def test_states_are_distributions():
    from tsprobe.llm.suffix_tree import SHIFT, grow, score_tokens

    rng = np.random.default_rng(2)
    flat = rng.integers(0, 6, 4000)
    flat[1::2] = (flat[::2] + 1) % 6
    ids = flat.astype(np.uint64)
    words = np.arange(10, 16, dtype=np.uint64)
    n_words = np.bincount(flat, minlength=6)
    pairs, n_pairs = np.unique((ids[:-1] << SHIFT) | ids[1:], return_counts=True)
    triples, n_triples = np.unique((ids[:-2] << (SHIFT * np.uint64(2))) | (ids[1:-1] << SHIFT) | ids[2:], return_counts=True)
    tree = grow(words, n_words, pairs, n_pairs, triples, n_triples, len(flat), 6)
    assert len(tree.contexts) and (~np.isnan(tree.back1)).any()
    root = np.log10((n_words + 1) / (len(flat) + 6 + 1))
    unknown = np.log10(1 / (len(flat) + 6 + 1))
    for context in ([0, 1], [3, 4], [2, 2]):
        total = 0.0
        for w in range(7):  # 6 stands for every word not seen
            seq = np.array([*context, w], np.uint64)
            total += 10 ** score_tokens(tree, seq, np.zeros(3, np.int32), np.append(root, unknown)[seq.astype(int)])[-1]
        assert total == pytest.approx(1)


def test_scores_are_those_of_the_whole_tree(spark):
    """Counts, gains and kept contexts of many blocks against a tree of all words, pairs and triples, however rare."""
    import zlib

    from tsprobe.llm.suffix_tree import SHIFT, grow, possible, score_tokens

    rng = random.Random(8)
    phrases = [" ".join(f"w{rng.randrange(40)}" for _ in range(5)) for _ in range(400)]
    texts = [" ".join(phrases[int(400 * rng.random() ** 3)] if rng.random() < 0.7 else f"r{rng.randrange(900)}" for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["Rare twins stand here"] * 2 + ["rare twins " * 30] * 3 + ["", None]
    tokens = [[*(t or "").lower().split(), " "] for t in texts]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    kept = [ws for ws, t in zip(tokens, train) if t]
    c1 = Counter(w for ws in kept for w in ws)
    names = {w: i for i, w in enumerate(sorted(c1))}
    ids = [np.array([names.get(w, len(names)) for w in ws], np.uint64) for ws in tokens]
    c2, c3 = Counter(), Counter()
    for x in (x for x, t in zip(ids, train) if t):
        c2.update(((x[:-1] << SHIFT) | x[1:]).tolist())
        c3.update(((x[:-2] << (SHIFT * np.uint64(2))) | (x[1:-1] << SHIFT) | x[2:]).tolist())
    n_words = np.array([c1[w] for w in sorted(c1)])
    total = sum(c1.values())
    (k2, n2), (k3, n3) = ((np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (c2, c3))
    last = n_words[(k2 & np.uint64((1 << 21) - 1)).astype(int)]
    asked = dict(zip(k2.tolist(), possible(n2, last, 0.5 * np.log(total)).tolist(), strict=True))
    k2, n2, k3, n3 = k2[n2 > 1], n2[n2 > 1], k3[n3 > 1], n3[n3 > 1]  # singletons go to the shorter state
    tree = grow(np.arange(len(names), dtype=np.uint64), n_words, k2, n2, k3, n3, total, len(names))
    assert len(tree.contexts) > 20 and min(c2[p] for p in tree.contexts.tolist()) < 20
    assert all(asked[p] for p in tree.contexts.tolist()) and not all(asked.values())
    root = np.log10((np.append(n_words, 0) + 1) / (total + len(names) + 1))
    want = [score_tokens(tree, x, np.zeros(len(x), np.int32), root[x.astype(int)]).sum() for x in ids]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block_bytes in (4_000, 16 << 20):
        a = score(df, block_bytes=block_bytes).toPandas().sort_values("doc_id")
        assert a.n_tokens.tolist() == list(map(len, tokens)) and (a.train_tokens == total).all()
        assert a.score.to_numpy() == pytest.approx(want, rel=1e-9)
        assert a.base_score.to_numpy() == pytest.approx([root[x.astype(int)].sum() for x in ids], rel=1e-9)


def test_rare_contexts_of_a_larger_table_are_kept(spark):
    """Two sights are enough for a context, whatever the number of tokens (here over 4 million)."""
    filler = spark.range(0, 300, 1, 8).select("id", F.repeat(F.lit("a b c d e f g h i j "), 1600).alias("text"))
    a = score(filler.unionByName(spark.createDataFrame([(1000 + i, "Qq zz") for i in (1, 2)], "id long, text string")).withColumnRenamed("id", "doc_id")).where("doc_id >= 1000").toPandas()
    assert not a.held_out.any() and (a.train_tokens > 4_000_000).all()
    assert (a.score - a.base_score > 5).all()


def test_workers_give_freed_memory_back():
    from tsprobe.llm.common import lean

    pins = []

    def busy(key, rows):
        many = [bytes(1000) for _ in range(100_000)]
        pins.append(bytes(1000))  # above the others, so that the heap does not shrink by itself
        return len(many)

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    busy(1, 2)
    before = resident()
    assert lean(busy)(1, 2) == 100_000 and resident() < before - (50 << 20)
    assert lean(lambda a: a)(1) == 1 and lean(lambda a, b, c: c)(1, 2, 3) == 3


def test_fingerprints_of_odd_texts(spark, odd, none):
    a = fingerprints(odd).toPandas()
    assert len(a) == len(ODD) and a.near_edited.between(0, 1).all() and a.near_next.between(0, 1).all()
    assert fingerprints(none).collect() == []
    assert len(fingerprints(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).collect()) == 1


def test_near_copies_are_alike(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.sample(words, 200))) for i in range(300)]
    rows += [(1000, rows[7][1]), (1001, rows[8][1].replace(rows[8][1].split()[50], "changed"))]
    a = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), most_share=0.5).toPandas().set_index("doc_id")
    assert a.fingerprint[1000] == a.fingerprint[7]
    assert likeness(a.fingerprint[1001], a.fingerprint[8]) > 0.6
    assert likeness(a.fingerprint[1001], a.fingerprint[9]) < 0.2


def test_links_of_dense_groups(spark):
    """Near copies in a group larger than a chunk: exact counts and classes, with strays and copies among them."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base, other = rng.sample(words, 160), rng.sample(words, 120)
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3, 4])):
            copy[rng.randrange(160)] = rng.choice(words)
        texts.append(" ".join(copy))
    for i in range(25):
        copy = list(other)
        copy[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.sample(words, 100)) for _ in range(10)] + texts[:5] + [texts[70]] * 3
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = [[j for j in range(len(texts)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = ngram_join.signed(df, *ngram_join.bands_for())
    classes = saved(own.groupBy("mark").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")).withColumn("id", F.xxhash64("mark")))
    id_of = {r["copy_id"]: r["id"] for r in classes.collect()}
    for chunk_rows in (4, 16, 128):
        rows = ngram_join.links(df, classes, chunk_rows=chunk_rows).collect()
        n, root = Counter(), {i: i for i in id_of.values()}

        def find(x):
            return x if root[x] == x else find(root[x])

        for r in rows:
            if r["other"] is None:
                n[r["id"]] += r["n"]
            else:
                root[find(r["id"])] = find(r["other"])
        copies = Counter(texts)
        for c, i in id_of.items():
            assert n[i] == len(near[c]) - (copies[texts[c]] - 1)
            assert all((find(i) == find(id_of[j])) for j in near[c] if j in id_of)
        assert len({find(i) for i in id_of.values()}) >= 11
    dense = ngram_join.dense(saved(ngram_join.buckets(classes)), saved(ngram_join.full_sets(df, classes.select("id", "mark", "copy_id"))), 0.8, 16).collect()
    assert len(dense) > 40 and len({r["core"] for r in dense}) <= 4
    met = saved(ngram_join.buckets(classes))
    held = saved(ngram_join.full_sets(df, classes.select("id", "mark", "copy_id")))
    meeting, spots = ngram_join.places_of(met, saved(ngram_join.agreed_on(met, held, 16)))
    rows = meeting.toPandas()
    joint, spots = rows[rows.band == -1], spots.toPandas()
    assert len(joint) >= 50 and not rows.duplicated().any() and len(rows) < met.count()
    assert sorted((r.id, x) for r in spots.itertuples() for x in r.spots) == sorted(zip(joint.id, joint.bucket, strict=True))


def test_buckets_of_a_shared_passage_stay_apart(spark):
    """One consensus over buckets that share few members: joining them would make more rows, so each is a place of its own."""
    met = spark.createDataFrame([(100 * b + i, b, 7, 20) for b in range(4) for i in range(20)] + [(900 + i, b, 8, 20) for b in range(4) for i in range(20)], "id long, band int, bucket long, members long")
    agreed = spark.createDataFrame([(b, 7, 20, 1, b"a") for b in range(4)] + [(b, 8, 20, 2, b"b") for b in range(4)], "band int, bucket long, members long, core long, grams binary")
    meeting, spots = ngram_join.places_of(met, agreed)
    rows = meeting.toPandas()
    assert sorted(rows[rows.band == -1].id) == [900 + i for i in range(20)] and (rows[rows.band == -1].bucket == 2).all()
    assert len(rows) == 100 and spots.count() == 20


def test_near_copies_of_a_hot_group_are_alike(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(20_000)]
    base = rng.sample(words, 300)
    rows = [(i, " ".join(rng.sample(words, 300))) for i in range(600)]
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(300)] = rng.choice(words)
        rows.append((1000 + i, " ".join(copy)))
    a = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    inside = a.near_next[a.index > 1000]
    assert inside.mean() > 0.85 and (inside > 0.5).all()
    assert a.near_next[(a.index < 600) & (a.index > 0)].max() < 0.3


def test_places_are_those_of_the_ranks():
    terms = np.random.default_rng(0).integers(0, 1 << 63, 400).astype(np.uint64)
    got = imatch.places(terms).reshape(imatch.RATES, imatch.EACH)
    for e in range(imatch.EACH):
        hashes = imatch.mixed(terms ^ imatch.SEEDS[e])
        for r in range(imatch.RATES):
            members = terms[[int(h).bit_length() <= 64 - r for h in hashes]]
            assert (got[r, e] == 0) == (len(members) == 0)
            alone = imatch.places(members).reshape(imatch.RATES, imatch.EACH)[r, e]
            assert got[r, e] == alone  # terms outside the lexicon change nothing
    assert (imatch.places(terms[::-1]) == got.ravel()).all() and not imatch.places(terms[:0]).any()


def test_share_out():
    assert share_out([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    assert share_out([10, 1000, 10], [1, 1, 4], 3) == pytest.approx([30, 960, 30])


def test_splitting_tree_keeps_quotas():
    for n in (1, 2, 7, 32):
        m = split_quotas([1000, 0, 37, 5], n, 3)
        assert m.sum(0).tolist() == [1000, 0, 37, 5]
        assert np.ptp(m.sum(1)) <= 11


def test_mix_and_shards_of_odd_texts(odd, none):
    mixed, sources = mix(odd)
    a = mixed.toPandas()
    assert len(a) == len(ODD) and (a.taken <= 3 * a["size"]).all()
    assert [s.name for s in sources] == ["s0", "s1", None]
    s = shards(mixed, sources, 3).toPandas()
    assert s.n.sum() == a.taken.sum()
    block = {x.name: x.block for x in sources}
    assert all(n <= block[name] for (name, _), n in s.assign(source=s.source.astype(object).where(s.source.notna(), None)).groupby(["source", "number"], dropna=False).n.sum().items() if isinstance(name, str))
    assert mix(none)[0].collect() == []
    assert whole_documents(odd).columns == odd.columns
    assert whole_documents(none).collect() == []


def test_query_deals_its_draws_to_shards(spark, sf_dir, monkeypatch):
    made = []
    write = mixing.write_mix
    monkeypatch.setattr(mixing, "write_mix", lambda mixed, sources, n, path, seed: (write(mixed, sources, n, path, seed), made.append((sources, n, path, seed))))
    a = QUERIES["op10_mix_sources"](spark, sf_dir).toPandas()
    ((sources, n, path, seed),) = made
    assert n > 1
    s = spark.read.parquet(path).toPandas()
    quotas = split_quotas([x.quota for x in sources], n, seed)
    for i, x in enumerate(sources):
        mine = s[s.source == x.name]
        assert mine.number.nunique() == x.quota and (mine.groupby("number").shard.nunique() == 1).all()
        assert mine.groupby("shard").number.nunique().reindex(range(n), fill_value=0).tolist() == quotas[:, i].tolist()
    assert s.groupby("source").n.sum().equals(a[a.taken > 0].groupby("source").taken.sum().rename("n"))
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/shard=*/*.parquet"))
    assert len(files) == n and all(pd.read_parquet(f).key.is_monotonic_increasing for f in files)


def test_whole_documents_meet_their_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(20_000 if i % 200 < 4 else rng.randrange(20, 200))), f"s{i % 4}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, sources = mix(docs)
    taken = mixed.toPandas().set_index("doc_id")
    whole = whole_documents(docs).toPandas()
    copies = whole.doc_id.value_counts().reindex(taken.index, fill_value=0)
    share = taken.target / taken.source_size
    assert (copies >= np.floor(share)).all() and (copies <= np.ceil(share)).all()
    words = (copies * taken["size"]).groupby(taken.source).sum()
    for s in sources:
        assert words[s.name] == pytest.approx(taken.taken[taken.source == s.name].sum(), abs=200)
        assert words[s.name] == pytest.approx(s.target, rel=0.01)


def test_frequent_pretokens_are_added_up_in_a_tree(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["x" * 63, "y" * 64, "\u00e9t\u00e9", "\u2028z"]
    texts = ["a " + " ".join(rng.choices(words, weights=range(1, 65), k=400)) for _ in range(90)] + ["", "one", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(37)
    count = Counter(w for t in texts for w in (t or "").split(" ")[1:])
    got = frequent_pretokens(df, fan_in=3)
    assert "y" * 64 not in got and "x" * 63 in got and {"\u00e9t\u00e9", "\u2028z"} <= set(got)
    assert len(got) == len(set(got)) and set(got) >= {w for w, n in count.items() if n > 90 and w != "y" * 64}
    assert set(frequent_pretokens(df, table_size=10)) <= {w for w, _ in count.most_common(30)}
    assert frequent_pretokens(df.limit(0)) == []


def test_warc_round_trip(spark):
    page = "<html lang='de'><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><p>One<br>two</p><a href='/x'>three</a><!-- gone --></body></html>"
    pages = [(1, "http://a.example/x", page), (2, None, None), (None, "http://b.example/", ""), (3, "http://a.example/\nX-Bad: 1", "plain & <b>bold</b>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_id string")
    archive = responses(df)
    assert derive(responses(df.limit(0))).collect() == []
    source = {r.record_id: r for r in archive.collect()}
    rows = derive(archive).collect()
    assert len(rows) == 2 * len(pages)
    names = {r.record_type: r for r in rows if r.page_id == 1}
    for r in rows:
        ((headers, block),) = parse_records(bytes(r.record_bytes))
        assert headers["WARC-Refers-To"] == r.refers_to and r.refers_to in source
        assert headers["WARC-Source-Payload-Digest"] == source[r.refers_to].payload_digest
        assert headers.get("WARC-Date") == source[r.refers_to].date and "X-Bad" not in headers
        assert len(block) == r.content_length
        uuid.UUID(r.record_id[len("<urn:uuid:") : -1])
    ((headers, block),) = parse_records(bytes(names["conversion"].record_bytes))
    assert headers["WARC-Concurrent-To"] == names["metadata"].record_id
    assert block.decode() == "A & B\nOne\ntwo\nthree" == plain_text(page)
    assert b"title: A & B\r\n" in bytes(names["metadata"].record_bytes)


def test_warc_keeps_status_and_headers_and_decodes_entities(spark):
    """Responses as servers send them: statuses, charsets, chunks and content codings, whole, cut and broken."""
    page = "<title>caf\u00e9</title><p>one &amp; caf\u00e9</p>"
    want, utf8 = "caf\u00e9\none & caf\u00e9", page.encode()
    flat = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = flat.compress(utf8) + flat.flush()
    chunked = b"5;x=y\r\n" + utf8[:5] + b"\r\n" + b"%X\r\n" % len(utf8[5:]) + utf8[5:] + b"\r\n0\r\nTrailer: t\r\n\r\n"
    zipped = gzip.compress(utf8)
    cases = [
        (b"404 Not Found", b"Content-Type: text/html; charset=ISO-8859-1\r\nServer: s/1", page.encode("latin-1"), want, "true"),
        (b"200 OK", b"Content-Type: text/html\r\nContent-Encoding: gzip", zipped[:], want, "true"),
        (b"200 OK", b"content-encoding: GZIP\r\ntransfer-encoding: chunked", b"%x\r\n" % len(zipped) + zipped + b"\r\n0\r\n\r\n", want, "true"),
        (b"200 OK", b"Content-Encoding: x-gzip", gzip.compress(utf8[:9]) + gzip.compress(utf8[9:]), want, "true"),
        (b"200 OK", b"Transfer-Encoding: chunked", chunked, want, "true"),
        (b"200 OK", b"Transfer-Encoding: chunked", chunked[: chunked.index(b"0\r\nTrailer")], want, "false"),
        (b"200 OK", b"Content-Encoding: deflate", zlib.compress(utf8), want, "true"),
        (b"200 OK", b"Content-Encoding: deflate", raw, want, "true"),
        (b"200 OK", b"Content-Encoding: deflate, gzip", gzip.compress(raw), want, "true"),
        (b"200 OK", b"Content-Encoding: zstd", zstandard.compress(utf8), want, "true"),
        (b"200 OK", b"Content-Encoding: br", b"\x8b\x02\x80ab\x03", "", "false"),
        (b"200 OK", b"Content-Encoding: gzip", b"no gzip", "", "false"),
        (b"200 OK", b"Content-Type: text/html", b"<meta charset='windows-1252'>" + page.encode("cp1252"), want, "true"),
        (b"200 OK", b"Content-Type: text/html; charset=no-such", b"\xff\xfe" + page.encode("utf-16-le"), want, "true"),
        (b"200 OK", b"Content-Type: text/html; charset=no-such", utf8, want, "true"),
        (b"200 OK", b"Content-Type: text/plain", b"a <b>\r\nc", "a <b>\nc", "true"),
        (b"200 OK", b"Content-Type: image/png", b"\x89PNG", "", "true"),
        (b"204 No Content", b"X-Long: a\r\n b\r\nX-Long: c", b"", "", "true"),
    ]
    rows = []
    for i, (status, head, payload, _, _) in enumerate(cases):
        block = b"HTTP/1.1 " + status + b"\r\n" + head + b"\r\n\r\n" + payload
        rows.append((i, f"<urn:{i}>", None, None, None, bytearray(block), digest(block), digest(payload), [("WARC-IP-Address", "192.0.2.1"), (None, "x")]))
    rows += [(98, "<urn:98>", None, None, None, bytearray(b"<p>bare</p>"), None, None, None), (99, None, None, None, None, None, None, None, None)]
    archive = spark.createDataFrame(rows, RESPONSE + ", source_headers array<struct<name: string, value: string>>")
    got = {(r.page_id, r.record_type): next(parse_records(bytes(r.record_bytes)))[1].decode() for r in derive(archive).collect()}
    assert len(got) == 2 * len(rows)
    for i, (status, head, _, text, whole) in enumerate(cases):
        about = got[i, "metadata"].splitlines()
        assert got[i, "conversion"] == text, i
        assert f"httpStatus: {status.decode()}" in about and f"entityDecoded: {whole}" in about
        assert [x for x in about if x.startswith("httpHeader: ")] == [f"httpHeader: {x}" for x in head.decode().replace("\r\n ", " ").split("\r\n")]
        assert "payloadMatchesDigest: true" in about and "sourceRecordHeader: WARC-IP-Address: 192.0.2.1" in about
    assert got[98, "conversion"] == "bare" and "httpStatus" not in got[98, "metadata"]
    assert got[99, "conversion"] == ""
