"""Hard negatives, importance resampling and the tokenization automaton against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rarefy.llm import hard_negatives, importance_resampling, queries, tokenization_automaton
from rarefy.llm.common import public_vocabulary

from .test_operators import documents, none, odd, odd_rows  # noqa: F401

VECTORS = ("vec_id bigint, embedding array<double>, label int, _row bigint, vec bigint, x int, ab int, "
           "side int, positives string, `a.b` string")


# -- 11: hard negatives ----------------------------------------------------

def mined(rows, every, scale=256, positives=5, negatives=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) by integers of any size."""
    usable = [(i, [math.floor(scale * c) if abs(scale * c) < 2**53 else int(scale * c) for c in e], label)
              for i, e, label in rows
              if i is not None and label is not None and e is not None
              and all(c is not None and math.isfinite(c) for c in e)]
    cut = (1 << 63) - 1

    def score(a, b):
        return max(-cut, min(cut, sum(x * y for x, y in zip(a, b))))
    out = []
    for k, (i, e, label) in enumerate(usable):
        if i % every:
            continue
        others = [(-score(e, f), j, n, m == label) for n, (j, f, m) in enumerate(usable) if n != k]
        for s, j, _, _ in sorted(x for x in others if x[3])[:positives]:
            window = sorted(x for x in others if not x[3] and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, r, w[1], -s, -w[0]) for r, w in enumerate(window[:negatives], 1)]
    return Counter(out)


def test_hard_negatives_query(spark, small_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, small_dir).collect()
    assert Counter(map(tuple, got)) == mined(rows, 50) and len(got) > 20


@pytest.mark.parametrize("anchor_block,row_block", [(8192, 8192), (2, 5)])
def test_hard_negatives_odd_rows(spark, anchor_block, row_block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 6)], int(rng.integers(0, 3))) for i in range(60)]
    rows += [(0, rows[0][1], rows[0][2])] * 2 + [(7, rows[7][1], 1)]  # repeated rows and ids, many ties
    rows += [(80, None, 1), (81, [1.0, None], 1), (82, [float("nan")] * 6, 1), (83, [float("inf")] * 6, 0),
             (None, [1.0] * 6, 1), (84, [1.0] * 6, None), (85, [], 1), (90, [2.0, 1.0], 2),
             (100, [1e9] * 6, 1), (101, [3e8] * 6, 1), (102, [2e8] * 6, 2), (103, [1e15, -1e200], 1),
             (104, [-1e15, 1e300], 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "p", "q") for r in rows], VECTORS)
    got = hard_negatives.mine_hard_negatives(df, anchor="vec_id % 5 = 0", anchor_block=anchor_block,
                                             row_block=row_block)
    assert Counter(map(tuple, got.collect())) == mined(rows, 5)
    assert hard_negatives.mine_hard_negatives(df.limit(0), anchor="vec_id % 5 = 0").count() == 0
    assert hard_negatives.mine_hard_negatives(df, anchor="cast(null as boolean)").count() == 0


@pytest.mark.parametrize("size,width", [(10, 3), (1000, 700), (1 << 40, 5), (1 << 52, 9)])
def test_residue_scores_are_exact(size, width):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size + 1, (7, width)).astype(float) for _ in range(2))
    a[0], b[0] = size, -size
    limit = (1 << 63) - 1
    want = [[max(-limit, min(limit, sum(int(x) * int(y) for x, y in zip(r, c)))) for c in b] for r in a]
    got = np.concatenate([s for _, s in hard_negatives.residue_scores(a, b, at_once=3)])
    assert got.dtype == np.int64 and got.tolist() == want


# -- 12: importance resampling ---------------------------------------------

def resampled(docs, target, buckets=10000, percent=25, least=20):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(f.encode()) % buckets
                            for f in words + [" ".join(p) for p in zip(words, words[1:])]]
    found = [(i, *features(t)) for i, t in docs]
    raw, goal = Counter(), Counter()
    for _, _, f in found:
        raw.update(f)
    for t in target:
        goal.update(features(t)[1])
    s_all, t_all = sum(raw.values()), sum(goal.values())

    def gain(b):
        return math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    out = []
    for i, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return Counter([(*r, k) for k, r in enumerate(drawn, 1)]
                   + [(*r, None) for r in able[len(drawn):] + [r for r in out if r[1] < least]])


def digest(rows):
    return Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in rows)


def test_importance_resampling_query(spark, small_dir, documents):  # noqa: F811
    target = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    got = queries.op12_importance_resampling(spark, small_dir).collect()
    assert digest(got) == resampled([(i, t) for i, t, _ in documents], target)


def test_importance_resampling_odd_rows(spark, odd, none):  # noqa: F811
    docs = [(r[0], r[1]) for r in odd_rows()]
    for target in (odd, none):
        texts = [t for _, t in docs] if target is odd else []
        got = importance_resampling.resample(odd, target, percent=60, least_words=3).collect()
        assert digest(got) == resampled(docs, texts, percent=60, least=3)
    assert importance_resampling.resample(none, odd).count() == 0


@pytest.mark.parametrize("window", [1, 7, 60, 10**6])
def test_batch_features_by_windows(window):
    @settings(max_examples=60, deadline=None, derandomize=True)
    @given(st.lists(st.lists(st.sampled_from(["a", "Bb", "é", " ", "  ", ".", "\x00", "9", "x" * 70, "\n"]),
                             max_size=12).map("".join), min_size=1, max_size=5))
    def check(texts):
        got, n = Counter(), 0
        for doc, bucket, words in importance_resampling.batch_features([t.encode() for t in texts], 1000, window):
            got.update(zip(doc.tolist(), bucket.tolist()))
            n += words
        want = Counter()
        for k, t in enumerate(texts):
            words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
            n -= len(words)
            for f in words + [" ".join(p) for p in zip(words, words[1:])]:
                want[k, zlib.crc32(f.encode()) % 1000] += 1
        assert got == want and n == 0
    check()


# -- 13: tokenization automaton --------------------------------------------

PARTS = ["a", "the", "don't", " ", "  ", "\n", "\t", "é", "é", "ß", "日本", ".", "...", "'s", "12", "\xa0",
         "\x1c", "\x00", "<|endoftext|>", "<|startoftext|>", "<|end", "WORD", "Word.", "ÀÉß", "ÿµÞ", "Σ", "İ", "🙂",
         "aaaa", "inging", "<", "|>"]


def plain_tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))


def test_automaton_equals_the_library():
    codec, tok = tokenization_automaton.codec(public_vocabulary("word_bpe_49k.json")), plain_tokenizer()

    @settings(max_examples=500, deadline=None, derandomize=True)
    @given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=12))
    def check(text):
        want = tok.encode(text, add_special_tokens=False).ids
        ids = next(codec.encode([text]))
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert codec.decode(ids) == tok.decode(want, skip_special_tokens=False)
    check()


def merged(word, merges):
    """Merge by merge, left to right."""
    word = list(word)
    for u, v in merges:
        out, i = [], 0
        while i < len(word):
            if word[i:i + 2] == [u, v]:
                out.append(u + v)
                i += 2
            else:
                out.append(word[i])
                i += 1
        word = out
    return word


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.data())
def test_gadgets_equal_merging_in_order(data):
    merges, tokens = [], ["a", "b", "c"]
    for _ in range(data.draw(st.integers(0, 9))):
        u, v = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if u + v not in tokens:
            merges.append((u, v))
            tokens.append(u + v)
    automaton = tokenization_automaton.MergeAutomaton(["a", "b", "c"], merges)
    for word in data.draw(st.lists(st.text("abc", min_size=1, max_size=14), max_size=8)):
        assert [automaton.names[t] for t in automaton.path(word)] == merged(word, merges)


def test_automaton_refuses_unordered_merges():
    with pytest.raises(ValueError):
        tokenization_automaton.MergeAutomaton("abc", [("ab", "c"), ("a", "b")])
    with pytest.raises(ValueError):
        tokenization_automaton.MergeAutomaton("abc", [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")])


def round_trip(rows, tok):
    out = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


def test_automaton_query(spark, small_dir, documents):  # noqa: F811
    got = queries.op13_tokenization_automaton(spark, small_dir).collect()
    assert Counter(map(tuple, got)) == round_trip([(i, t) for i, t, _ in documents], plain_tokenizer())


def test_automaton_odd_rows(spark, odd, none):  # noqa: F811
    tok = plain_tokenizer()
    got = tokenization_automaton.round_trip_digest(odd).collect()
    assert Counter(map(tuple, got)) == round_trip([(r[0], r[1]) for r in odd_rows()], tok)
    assert tokenization_automaton.round_trip_digest(none).count() == 0
    ids = tokenization_automaton.encode_texts(odd)
    texts = tokenization_automaton.decode_ids(ids).collect()
    assert Counter((r.doc_id, r.decoded) for r in texts) == Counter(
        (r[0], tok.decode(tok.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False))
        for r in odd_rows())


def test_automaton_long_words_and_small_caches(monkeypatch):
    for name in ("TABLE_ARCS", "CACHE_ENTRIES"):
        monkeypatch.setattr(tokenization_automaton, name, 20)
    codec, tok = tokenization_automaton.Codec(public_vocabulary("word_bpe_49k.json")), plain_tokenizer()
    for text in ("a" * 50_000, "inga" * 5_000, "x1" * 3_000, "the quick brown fox " * 50):
        assert np.frombuffer(next(codec.encode([text])), dtype="<u4").tolist() == tok.encode(
            text, add_special_tokens=False).ids
    assert len(codec.automaton.table) <= 20 and len(codec.words) <= 20
