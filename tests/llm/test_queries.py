"""Contract queries on a small table against plain Python."""

import base64
import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tsprobe.llm.queries import QUERIES
from tsprobe.llm.warc import parse_records

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")


@pytest.fixture(scope="module")
def got(spark, sf_dir):
    """got(name): the query's rows in order of doc_id."""
    return lambda name: QUERIES[name](spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def ids(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in tokenizer.encode_batch(docs.text.tolist(), add_special_tokens=False)]


def test_quality_classifier_finds_labelled_quality(got, sf_dir):
    a = got("op1_quality_classifier").merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert (a.kept == (a.quality == 1)).mean() > 0.95
    assert a.kept[a.quality == 1].mean() > 0.98


def test_suffix_tree_base_scores(got, docs):
    a = got("op2_suffix_tree_score")
    tokens = {i: [*t.encode().lower().split(), b" "] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in a.itertuples():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    assert a.score[~a.held_out].sum() > 0.95 * a.base_score[~a.held_out].sum()
    assert a.score[a.held_out].sum() > a.base_score[a.held_out].sum()


def grams(text):
    ws = text.split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_ngram_join(got, docs):
    a = got("op3_ngram_join")
    sets, texts, ids = [grams(t) for t in docs.text], docs.text.tolist(), docs.doc_id.tolist()
    where, root, n = defaultdict(list), list(range(len(ids))), [0] * len(ids)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in where[g] if j < i).items():
            if k / (len(s) + len(sets[j]) - k) >= 0.8:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert a.n_links.tolist() == n
    assert a.class_id.tolist() == [ids[find(i)] for i in range(len(ids))]
    first = {t: i for i, t in reversed(list(zip(ids, texts)))}
    assert a.copy_id.tolist() == [first[t] for t in texts]


def test_token_counts(got, docs, ids):
    a = got("op4_token_counts")
    assert a.n_tokens.tolist() == [len(x) for x in ids]
    assert a.n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    assert (a.over_limit == (a.n_tokens > 1024)).all()


def test_suffix_array_dedup(got, docs):
    a, first = got("op5_suffix_array_dedup"), {}
    data = {i: t.encode() for i, t in zip(docs.doc_id, docs.text)}
    for i, b in data.items():
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    for r in a.itertuples():
        b = data[r.doc_id]
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < r.doc_id:
                gone[s : s + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    assert a.n_removed.sum() > 0


def test_quality_rules(got, docs):
    a = got("op6_quality_rules")
    for r, t in zip(a.itertuples(), docs.text):
        ws = WORDS.findall(t)
        triples = list(zip(ws, ws[1:], ws[2:]))
        count = Counter(triples)
        repeated = {i + k for i, g in enumerate(triples) if count[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(ws) < 50 or 100 * len(repeated) > 50 * len(ws))
        assert not (r.base_failed and r.kept)


def test_quality_rules_keep_clean_documents(got, sf_dir):
    a = got("op6_quality_rules").merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    fine = a[~a.base_failed]
    assert fine.kept[fine.quality == 1].all()
    assert not fine.kept[fine.quality == 0].any()


def test_packing(got, docs, ids):
    a = got("op8_best_fit_packing")
    whole = {d: [*x, 0] for d, x in zip(docs.doc_id, ids)}
    for d, g in a.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g)))
        assert g.start.tolist() == [0, *g.length.cumsum()[:-1]]
        assert g.length.sum() == len(whole[d])
        assert (g.length[1:] == 2048).all()
        for r in g.itertuples():
            assert zlib.crc32(np.array(whole[d][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in a.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
        assert g.length.sum() <= 2048
    room: list[int] = []
    for n in sorted(a.length, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(2048 - n)
    assert a.sequence_id.nunique() == len(room)


def test_fingerprints(got, docs):
    a = got("op9_imatch_fingerprints")
    texts = docs.text.tolist()
    follow = [texts[-1], *texts[:-1]]  # descending ids
    for r, t, f in zip(a.itertuples(), texts, follow):
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + f[:half]).encode()).hexdigest()
    assert docs.assign(f=a.fingerprint.values).groupby("text").f.nunique().max() == 1
    assert a.near_edited.mean() > 10 * a.near_next.mean()


def test_mix(got, docs):
    a = got("op10_mix_sources")
    assert a["size"].tolist() == [len(WORDS.findall(t)) for t in docs.text]
    sizes = a.groupby("source")["size"].sum()
    assert (a.source_size == a.source.map(sizes)).all()
    weights = dict(zip(sorted(sizes.index), [1, 2, 3] * len(sizes)))
    left, free, target = float(sizes.sum()), dict(weights), {}
    while free:
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if w * unit > 3 * sizes[s]]
        for s in full or list(free):
            target[s] = 3 * sizes[s] if full else free[s] * unit
            left -= target[s] if full else 0
            free.pop(s)
    for s, g in a.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(target[s])
        assert g.taken.sum() == pytest.approx(target[s], rel=0.01)
    assert (a.taken <= 3 * a["size"]).all()
    assert a.equals(got("op10_mix_sources"))


def test_warc_derivatives(spark, sf_dir):
    """Every page gives one metadata and one conversion record that refer to its response."""
    rows = QUERIES["op7_warc_derivatives"](spark, sf_dir).toPandas()
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id")
    assert sorted(zip(rows.page_id, rows.record_type)) == sorted((i, k) for i in pages.index for k in ("conversion", "metadata"))
    assert rows.record_id.is_unique and (rows.groupby("page_id").refers_to.nunique() == 1).all()
    tag, drop = re.compile(r"<[^>]*>"), re.compile(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", re.S)
    for r in rows.itertuples():
        page = pages.loc[r.page_id]
        ((headers, block),) = parse_records(bytes(r.record_bytes))
        sha = "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode()
        assert headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Target-URI"] == page.url and len(block) == r.content_length
        assert r.source_payload_digest == headers["WARC-Source-Payload-Digest"] == sha
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if r.record_type == "conversion":
            assert "".join(block.decode().split()) == "".join(html.unescape(tag.sub(" ", drop.sub(" ", page.html))).split())
        else:
            assert b"httpStatus: 200 OK\r\nhttpHeader: Content-Type: text/html; charset=utf-8\r\n" in block
            assert b"payloadMatchesDigest: true" in block and b"entityDecoded: true" in block
