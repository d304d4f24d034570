"""The ten operators against plain Python, on the small tables and on odd rows."""

import hashlib
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rarefy.llm import (html_template, mixing, packing, pii, quality_rules, queries, sharding, simhash,
                        token_counts, token_files, voronoi_knn)
from rarefy.llm.common import public_vocabulary
from rarefy.llm.text_encoding import Encoder

from . import brute

DOCS = ("doc_id bigint, text string, source string, n_chars bigint, lang string, _row bigint, "
        "size bigint, shard int, fp bigint, component_id bigint, _copy int, kept boolean, _q string, "
        "sequence_id bigint, start bigint, target double, `a.b` string")
LONG = "lorem ipsum dolor sit amet " * 30_000


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    extra = (7, 7, 7, 7, 7, 7, True, "q", 7, 7, 7.0, "x")
    texts = [(1, "the cat and the dog are in a house of the old man by the sea", "s1"),
             (1, "the cat and the dog are in a house of the old man by the sea", "s1"),
             (2, None, "s1"), (3, "", None), (4, "   \n \t ", "s2"), (None, "no id but a text of the day", None),
             (None, None, None), (5, LONG, "s2"), (6, "mail a.b@c.de or +1 (555) 123-4567, 10.0.0.1", "é"),
             (7, "the cat and the dog are in a house of the old man by the sea", None),
             (8, "A  b\n\nc d \x1f e", "s1")]
    return [(i, t, s, len(t) if t else 0, "en", *extra) for i, t, s in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    return sorted((r.doc_id, r.text, r.source) for r in rows)


def key(x):
    return (x is None, x if x is not None else 0)


# -- 1: token counts -------------------------------------------------------

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_count_every_token(spark, rule):
    tok = brute.tokenizer("byte_bpe_50k.json")
    texts = ["alpha betagamma, delta\nepsilon", "größe übermäßig", "one two", "", None]
    cuts = [[(0, 8), (8, 20), (20, 30)], [(3, 9), (0, 3)], [(0, 3), (3, 3), (4, 7)], [(0, 0)], []]
    df = spark.createDataFrame([(i, t, [dict(start=s, end=e) for s, e in c])
                                for i, (t, c) in enumerate(zip(texts, cuts))],
                               "doc_id int, text string, sections array<struct<start:int,end:int>>")
    got = token_counts.section_token_counts(df, sections="sections", rule=rule).collect()
    want = {(i, k): n for i, (t, c) in enumerate(zip(texts, cuts))
            for k, n in enumerate(brute.section_counts(tok.encode(t or "", add_special_tokens=False).offsets, c, rule))}
    assert {(r.doc_id, r.section): pytest.approx(r.n_tokens) for r in got} == want


def test_token_counts_query(spark, small_dir, documents):
    tok = brute.tokenizer("byte_bpe_50k.json")
    rows = queries.op1_token_counts(spark, small_dir).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {i for i, _, _ in documents}
    for i, t, _ in documents[:80]:
        found = sorted(by_doc[i], key=lambda r: r.section)
        sections = token_counts.line_sections(t or "")
        assert [(r.start, r.end) for r in found] == sections
        spans = tok.encode(t or "", add_special_tokens=False).offsets
        assert [r.n_tokens for r in found] == brute.section_counts(spans, sections, "largest")


def test_token_counts_odd_rows(odd, none):
    rows = token_counts.section_token_counts(odd).collect()
    assert Counter(r.doc_id for r in rows if r.section == 0) == Counter(r[0] for r in odd_rows())
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [0, 0]
    assert token_counts.section_token_counts(none).count() == 0


# -- encoding --------------------------------------------------------------

PARTS = ["a", "the", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "é", "ß", "日本", ".", "...", "'s", "12", " ",
         " ", "\x1c", "\x00", "\x01", "<|endoftext|>", "WORD", "Word", "ÀÉß", "ÿµÞ", "\u0301", "Σ", "İ", "🙂"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_equals_whole_text(name):
    enc, tok = Encoder(public_vocabulary(name)), brute.tokenizer(name)
    spans = Encoder(public_vocabulary(name), offsets=True)

    @settings(max_examples=400, deadline=None, derandomize=True)
    @given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
    def check(text):
        whole = tok.encode(text, add_special_tokens=False)
        assert next(enc.ids([text])) == np.array(whole.ids, dtype="<u4").tobytes()
        assert next(spans.spans([text])).tolist() == [list(x) for x in whole.offsets]

    check()


def test_encoder_beyond_its_cache(documents, monkeypatch):
    from rarefy.llm import text_encoding
    monkeypatch.setattr(text_encoding, "CACHE_ENTRIES", 50)
    enc, tok = Encoder(public_vocabulary("byte_bpe_50k.json")), brute.tokenizer("byte_bpe_50k.json")
    texts = [t or "" for _, t, _ in documents[:60]]
    assert list(enc.ids(texts)) == [np.array(e.ids, dtype="<u4").tobytes()
                              for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert len(enc.cache) <= 52


# -- 2: packing ------------------------------------------------------------

def check_packing(rows, texts):
    tok = brute.tokenizer("byte_bpe_50k.json")
    want = Counter((i, *p) for i, t in texts for p in brute.pieces(tok, t))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins), sum(r.length for r in rows)


def test_packing_query(spark, small_dir, documents):
    n, total = check_packing(queries.op2_best_fit_packing(spark, small_dir).collect(),
                             [(i, t) for i, t, _ in documents])
    assert n <= -(-total // packing.CAPACITY) + 2


def test_packing_groups_odd_rows(odd, none):
    rows = packing.pack_documents(odd, group_pieces=3).collect()
    check_packing(rows, [(r[0], r[1]) for r in odd_rows()])
    assert packing.pack_documents(none).count() == 0


def test_local_search_goes_on_until_nothing_helps():
    # A fifth sweep saves a bin here.
    lengths = np.random.default_rng(607523).integers(12, 67, 90)
    bins = packing.local_search(lengths, packing.best_fit_decreasing(lengths, 100), 100)
    assert sorted(i for b in bins for i in b) == list(range(90)) and len(bins) == 35
    assert max(int(lengths[b].sum()) for b in bins) <= 100


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    better = 0
    for low, high in ((150, 520), (260, 500), (1, 1024), (340, 700)):
        lengths = rng.integers(low, high, 600)
        bins = packing.best_fit_decreasing(lengths, 1024)
        after = packing.local_search(lengths, bins, 1024)
        assert sorted(i for b in after for i in b) == list(range(600))
        assert max(int(lengths[b].sum()) for b in after) <= 1024
        assert len(after) <= len(bins)
        fills = [sum(int(lengths[b].sum()) ** 2 for b in x) for x in (bins, after)]
        assert fills[1] >= fills[0]
        better += len(bins) - len(after)
    assert better > 0


# -- 3: token files --------------------------------------------------------

def check_token_rows(rows, docs):
    tok = brute.tokenizer("word_bpe_49k.json")
    at, want = 0, []
    for i, t in docs:
        x = brute.ids(tok, t)
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_token_files_query(spark, small_dir, documents):
    check_token_rows(queries.op3_token_files(spark, small_dir).collect(), [(i, t) for i, t, _ in documents])


def test_token_files_layout_and_selective_read(spark, small_dir, tmp_path, documents):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, row_group_bytes=1 << 13, page_rows=10)
    files = sorted((tmp_path / "tokens").glob("part-*.parquet"))
    order, groups = [], 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_offset_index and col.has_column_index
                if col.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in col.encodings
                else:
                    assert "DELTA_BINARY_PACKED" in col.encodings
        order += pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()
    assert order == [i for i, _, _ in documents] and groups > len(files)
    tokens = token_files.read_token_files(spark, path)
    tok = brute.tokenizer("word_bpe_49k.json")
    i, text, _ = documents[17]
    assert tokens.where(F.col("doc_id") == i).first().ids == brute.ids(tok, text).tolist()
    plan = tokens.select("doc_id", "start")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("== Physical Plan ==")[1]


def test_token_files_odd_rows(spark, odd, none, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "t"))
    rows = token_files.token_file_digest(spark, str(tmp_path / "t")).collect()
    tok = brute.tokenizer("word_bpe_49k.json")
    want = Counter((r[0], zlib.crc32(brute.ids(tok, r[1]).tobytes())) for r in odd_rows())
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == [None, None] + sorted(i for i in ids if i is not None)
    assert token_files.token_round_trip(none).count() == 0


# -- 4: pages --------------------------------------------------------------

def test_html_query(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op4_html_extraction(spark, small_dir).collect()}
    assert set(got) == {p.page_id for p in pages}
    for p in pages:
        r = got[p.page_id]
        assert r.text == brute.article_text(p.html) and r.n_chars == len(r.text) and r.url == p.url


SITE = ("<html><body><div class='top-menu'><a href=/>Home</a></div><div id='wrap'><div class='post'>"
        "<h2>Title {i}</h2><p>First &eacute; text number {i} with <b>bold</b> words.<p>Second<br>paragraph {i} of it"
        "<div class='share'>Tell your friends</div></div><div class='comments'><p>Reader {i} says no</div></div>"
        "<aside>Other {i} pages, a long list of things nobody reads</aside>"
        "<div>Copyright notice by the owner of this site</div><form><p>Search here</form></body></html>")


def test_template_without_article_element(spark):
    pages = spark.createDataFrame([(i, f"http://Host.example/{i}", SITE.format(i=i)) for i in range(8)],
                                  "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract_main_text(pages).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\nFirst é text number {i} with bold words.\nSecond paragraph {i} of it"


def test_html_odd_rows(spark):
    same = "<body><article><p>Same text</p></article></body>"
    rows = [(1, "http://a.b/1", None), (2, "http://a.b/2", ""), (3, None, "<p>Loose &amp; free"),
            (3, None, "<p>Loose &amp; free"), (None, "x", "no markup at all"), (4, "http://c.d", same),
            (5, "http://c.d/2", same), (6, "http://e.f", "<div " + "a" * 100_000), (7, "http://e.f/2", "<p>" * 20_000 + "deep"),
            (8, "http://e.f/3", "<article><p>one<script>var a='</p>'</script><p>two &#8211; \n x</article><p>out")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr(
        "*", "1 as text", "2 as host", "3 as slot")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_template.extract_main_text(df).collect())
    want = {1: "", 2: "", None: "no markup at all", 4: "Same text", 5: "Same text", 6: "", 7: "deep", 8: "one\ntwo – x"}
    assert got == Counter([(3, "Loose & free", 12)] * 2 + [(i, t, len(t)) for i, t in want.items()])
    assert html_template.extract_main_text(df.limit(0)).count() == 0


def site_texts(spark, layout, n=8, **more):
    rows = [(i, f"http://host.example/{i}", layout.format(i=i)) for i in range(n)]
    rows += [(k, "http://host.example/" + k, v) for k, v in more.items()]
    pages = spark.createDataFrame([(str(i), u, h) for i, u, h in rows], "page_id string, url string, html string")
    return {r.page_id: r.text for r in html_template.extract_main_text(pages).collect()}


@pytest.mark.parametrize("post,want", [
    ("<div class=post><h2>Title {i}</h2><p>One paragraph {i} that holds far more than half of the text.</p></div>",
     "Title {i}\nOne paragraph {i} that holds far more than half of the text."),
    ("<div class=post><div class=head><h2><a href=/{i}>Title {i}</a></h2></div><div class=text>A long text {i} alone</div></div>",
     "Title {i}\nA long text {i} alone"),
    ("<div class=content><div class=body><p>Sixty percent {i} of the text, sixty percent</p></div>"
     "<div class=more><p>Forty percent {i} of the text</p></div></div>",
     "Sixty percent {i} of the text, sixty percent\nForty percent {i} of the text"),
])
def test_html_no_part_of_an_article_is_cut(spark, post, want):
    around = "<html><body><div class=top><a href=/>Home</a></div>" + post + "<div>Owned by the owner</div></body></html>"
    got = site_texts(spark, around)
    assert got == {str(i): want.format(i=i) for i in range(8)}
    assert html_template.page_text(post.format(i=1)) == want.format(i=1)


@pytest.mark.parametrize("start,end", [
    ("<div class='content has-sidebar'><div>", "</div></div>"), ("<div class=no-sidebar><p>", "</p></div>"),
    ("<article class='post category-social'>", "</article>"), ("<article class='post social'>", "</article>"),
    ("<div id=search><article>", "</article></div>"), ("<div class='page search'><div>", "</div></div>"),
])
def test_html_names_do_not_exclude_the_article(spark, start, end):
    page = start + "<h2>Title {i}</h2><p>The article's own text number {i}.</p>" + end
    got = site_texts(spark, "<body>" + page + "<div class=comments><p>Reader {i} says</p></div></body>")
    assert got == {str(i): f"Title {i}\nThe article's own text number {i}." for i in range(8)}
    assert html_template.page_text(page.format(i=1)) == got["1"]
    halves = "<div class=search><p>Same size</p></div><div class=social><p>Size same</p></div>"
    assert html_template.page_text(halves) == "Same size\nSize same"


def test_html_near_copies_keep_what_they_share(spark):
    layout = "<body><div class=post><p>Text {i} of the page</p></div><div>Owned by the owner</div></body>"
    copy = ("<body><div class=post><div class=gallery><span class=item></span><p>Shared by the copies</p><p>Copy %s</p>"
            "</div></div><div>Owned by the owner</div></body>")
    got = site_texts(spark, layout, a=copy % "a", b=copy % "b")
    assert got == {str(i): f"Text {i} of the page" for i in range(8)} | {
        x: f"Shared by the copies\nCopy {x}" for x in "ab"}


def test_html_many_groups_of_near_copies(spark):
    # Twenty groups of copies, each with paths of its own.
    rows = [(2 * k + j, "<body><div class=%s><p class=%s>Shared by group %d</p><p>Copy %d</p></div><div>Owner</div></body>"
             % (chr(97 + k), chr(97 + k), k, j)) for k in range(20) for j in range(2)]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows], "page_id int, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract_main_text(pages).collect()}
    assert got == {i: f"Shared by group {i // 2}\nCopy {i % 2}" for i, _ in rows}


# -- 5: top k --------------------------------------------------------------

def check_top_k(rows, vectors, is_query, k, scale):
    """``vectors``: (id, list) of the usable rows; repeated ids allowed."""
    width = max((len(v) for _, v in vectors), default=0)
    x = [[int(np.floor(scale * c)) for c in v] + [0] * (width - len(v)) for _, v in vectors]
    want = Counter()
    for a, (i, _) in enumerate(vectors):
        if is_query(i):
            found = sorted((-sum(p * q for p, q in zip(x[a], x[b])), j) for b, (j, _) in enumerate(vectors) if b != a)
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k]))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == want


def test_top_k_query(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    check_top_k(queries.op5_exact_top_k(spark, small_dir).collect(), [(r.vec_id, r.embedding) for r in rows],
                lambda i: i % 20 == 0, 20, 64)


def test_top_k_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=4).round(1).tolist()) for i in range(300)]
    good += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)] + [(7, [9.0, 9.0, 9.0, 9.0]), (20, [1.0]), (21, [])]
    bad = [(500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as x", "2 as cell")
    rows = voronoi_knn.top_k_inner_product(df, "vec_id % 10 = 0", k=5, pivots=6, query_block=7, data_block=50).collect()
    check_top_k(rows, good, lambda i: i % 10 == 0, 5, 64)
    assert voronoi_knn.top_k_inner_product(df.limit(0), "true").count() == 0
    two = spark.createDataFrame(good[:2], "vec_id bigint, embedding array<double>")
    assert voronoi_knn.top_k_inner_product(two, "vec_id = 0").count() == 1


def test_top_k_large_components_stay_exact(spark):
    good = [(i, [float(3 ** 17 + i), -float(2 ** 31 + 7 * i), 1.0]) for i in range(12)]
    df = spark.createDataFrame(good, "vec_id bigint, embedding array<double>")
    check_top_k(voronoi_knn.top_k_inner_product(df, "true", k=3, scale=1).collect(), good, lambda i: True, 3, 1)


# -- 6: quality ------------------------------------------------------------

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed")


def check_quality(rows, docs):
    want = Counter((i, *(brute.quality(t)[s] for s in STATS),
                    brute.kept(t, quality_rules.RULES, set(quality_rules.STOP_WORDS))) for i, t in docs)
    assert Counter((r.doc_id, *(r[s] for s in STATS), r.kept) for r in rows) == want


def test_quality_query(spark, small_dir, documents):
    check_quality(queries.op6_quality_rules(spark, small_dir).collect(), [(i, t) for i, t, _ in documents])


def test_quality_odd_rows(odd, none):
    check_quality(quality_rules.quality_verdicts(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert quality_rules.quality_verdicts(none).count() == 0
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        r[0] for r in odd_rows() if brute.kept(r[1], quality_rules.RULES, set(quality_rules.STOP_WORDS)))


def test_repeat_words_on_random_texts(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["a", "b", "c"][:1 + i % 3], size=int(rng.integers(0, 40))))) for i in range(300)]
    check_quality(quality_rules.quality_verdicts(spark.createDataFrame(docs, "doc_id int, text string")).collect(), docs)


def test_quality_has_no_python_in_its_plan(spark, small_dir):
    plan = queries.op6_quality_rules(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_stop_words_of_known_languages_only(spark):
    text = " ".join(f"слово{i}" for i in range(60))
    langs = ["ru", "zh", None, "", "xx", "en", "EN-gb", "deu", "fr_FR"]
    docs = spark.createDataFrame([(i, text, x) for i, x in enumerate(langs)], "doc_id int, text string, lang string")
    got = {r.doc_id: (r.kept, r.failed_rules) for r in quality_rules.quality_verdicts(docs).collect()}
    assert got == {i: (True, []) if i < 5 else (False, ["stop_words"]) for i in range(9)}
    assert {r.doc_id for r in quality_rules.keep_good(docs).collect()} == set(range(5))
    assert quality_rules.keep_good(docs.drop("lang")).count() == 9


# -- 7: personal data ------------------------------------------------------

def check_pii(rows, docs):
    want = Counter()
    for i, t in docs:
        base = brute.base_spans(t)
        n = Counter(s.split(":")[0] for s in base.split(",") if s)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(base.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want


def test_pii_query(spark, small_dir, documents):
    check_pii(queries.op7_pii(spark, small_dir).collect(), [(i, t) for i, t, _ in documents])


def test_pii_odd_rows(odd, none):
    check_pii(pii.personal_data(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert pii.personal_data(none).count() == 0
    out = pii.redact_documents(odd)
    assert out.schema == odd.schema
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[6].text == "mail <EMAIL> or <PHONE>, <IP>" and by_id[6].n_chars == len(by_id[6].text)
    assert by_id[2].text is None and by_id[5].text == LONG


@settings(max_examples=3000, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from(["1", "4", "12", "255", "256", ".", "..", "@", "a", "b-", "+", "+1", " ", "-", "(", ")",
                                 "x.", "4111111111111111", "4111 1111 1111 1111", "9", "é", "\n", "%"]), max_size=16).map("".join))
def test_pii_base_spans_equal_the_patterns(text):
    found = pii.find_spans(text)
    assert pii.spans_text([s for s in found if s[0] in pii.BASE_KINDS]) == brute.base_spans(text)


@pytest.mark.parametrize("text,want", [
    ("see https://user:pw@host.example/x and http://plain.example/a", "url:4:34"),
    ("IBAN: DE89 3704 0044 0532 0130 00 thanks", "iban:6:33"),
    ("iban DE89370400440532013001 is wrong", ""),
    ("Account no: 12-345678 9 ok", "account:12:23"),
    ("token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "secret:9:49"),
    ("the token is a word, the account was fine, secretary: abc12345678", ""),
    ("SSN 123-45-6789.", "ssn:4:15"),
    ("Social Security number: 123-45-6789", "ssn:24:35"),
    ("SOCIAL Security 123-45-6789", "ssn:16:27"),
    ("API key: abcdefgh1", "secret:9:18"),
    ("API Key = abcdefgh1", "secret:10:19"),
    ("Access Key: abcdefgh1", "secret:12:21"),
    ("apiKey=abcdefgh1", "secret:7:16"),
    ("Api_Key: 'abcdefgh1'", "secret:10:19"),
    ("\u0130\u212a API Key: abcdefgh1", "secret:12:21"),
    ("Https://user:pw@host.example/x", "url:0:30"),
])
def test_pii_added_spans(text, want):
    added = [s for s in pii.find_spans(text) if s[0] not in pii.BASE_KINDS]
    assert pii.spans_text(added) == want


@pytest.mark.parametrize("cue,value,kind", [
    ("token=", "a1" * 10_000, "secret"), ("token=", "a" * 5000 + "1", "secret"), ("account: ", "12" * 40, "account")])
def test_pii_long_values_are_whole(cue, value, kind):
    text = f"{cue}{value} end"
    assert (kind, len(cue), len(cue) + len(value)) in pii.find_spans(text)
    assert pii.redact(text, pii.find_spans(text)) == f"{cue}<{kind.upper()}> end"


def test_pii_many_cues_in_one_run():
    start = time.process_time()
    assert pii.find_spans("token=" * 100_000) == []
    assert time.process_time() - start < 20
    assert pii.find_spans("token=abcdefgh/token = abcdefgh1") == [("secret", 23, 32)]


# -- 8: mixing -------------------------------------------------------------

def check_mixture(rows, docs):
    want = Counter((i, n, total, round(t, 6), n * c)
                   for (i, _, _), (n, total, t, c) in zip(docs, brute.mixture(docs)))
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows) == want


def test_mixing_query(spark, small_dir, documents):
    rows = queries.op8_mixing(spark, small_dir).collect()
    check_mixture(rows, documents)
    words, target = Counter(), {}
    source = {i: s for i, _, s in documents}
    for r in rows:
        words[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r["size"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_mixing_odd_rows(odd, none):
    docs = [(r[0], r[1], r[2]) for r in odd_rows()]
    plan = mixing.mixture_plan(odd).withColumn("taken", F.col("size") * F.col("copies"))
    check_mixture(plan.collect(), docs)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    want = Counter()
    for d, (_, _, _, c) in zip(odd_rows(), brute.mixture(docs)):
        want[d] += c
    assert Counter(tuple(r) for r in mixed.collect()) == +want
    assert mixing.mixture_plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_is_near_its_targets_and_unequal(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "w " * int(rng.integers(1, 300)), f"s{i % 7}") for i in range(4000)]
    rows = mixing.mixture_plan(spark.createDataFrame(docs, "doc_id int, text string, source string"), bins=16).collect()
    source = {i: s for i, _, s in docs}
    words, target, chosen = Counter(), {}, defaultdict(list)
    for r in rows:
        s = source[r.doc_id]
        words[s] += r["size"] * r.copies
        target[s] = r.target
        if r.target < 0.5 * r.source_size * 2:
            chosen[r["size"] < mixing.SHORT_WORDS].append(r.copies)
    assert all(abs(words[s] - target[s]) <= 300 for s in target)
    assert np.mean(chosen[True]) < 0.7 * np.mean(chosen[False])


# -- 9: sharding -----------------------------------------------------------

def check_shards(rows, docs, shards):
    data = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == data and len(rows) == len(docs)
    by_text, slots, size = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        by_text[(r["size"], r.text_crc32)].add(r.shard)
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[k] for k in range(shards)]


def test_sharding_query(spark, small_dir, documents):
    size = check_shards(queries.op9_sharding(spark, small_dir).collect(), [(i, t) for i, t, _ in documents], 24)
    largest = max(len((t or "").encode()) + 8 for _, t, _ in documents)
    assert max(size) - min(size) <= max(0.05 * sum(size) / 24, largest - sum(size) / 24)


def test_sharding_in_blocks(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "x" * int(rng.integers(1, 2000)) + str(i % 700)) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    size = check_shards(sharding.shard_documents(df, shards=5, block=40, fan_in=3).collect(), docs, 5)
    assert max(size) - min(size) <= 0.01 * max(size)


def test_sharding_odd_rows(odd, none):
    check_shards(sharding.shard_documents(odd, shards=3).collect(), [(r[0], r[1]) for r in odd_rows()], 3)
    assert sharding.shard_documents(none).count() == 0


def test_differencing_beats_greedy():
    rng = np.random.default_rng(5)
    values = rng.integers(1, 10_000, 400)
    parts = np.zeros((400, 8), dtype=np.int64)
    parts[:, 0] = values
    sums, where = sharding.differencing(parts)
    check = np.bincount(where[:, 0], weights=values, minlength=8)
    assert check.tolist() == sums.tolist()
    greedy = [0] * 8
    for v in sorted(values.tolist(), reverse=True):
        greedy[greedy.index(min(greedy))] += v
    assert sums.max() - sums.min() < max(greedy) - min(greedy)


# -- 10: SimHash -----------------------------------------------------------

def check_simhash(rows, docs):
    prints = [brute.simhash(t) for _, t in docs]
    groups = defaultdict(list)
    for k, r in enumerate(brute.components(prints)):
        groups[r].append(k)
    want = Counter()
    for members in groups.values():
        least = min((docs[k][0] for k in members if docs[k][0] is not None), default=None)
        want.update((docs[k][0], f"{prints[k]:016x}", least) for k in members)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == want
    return groups


def test_simhash_query(spark, small_dir, documents):
    check_simhash(queries.op10_simhash_dedup(spark, small_dir).collect(), [(i, t) for i, t, _ in documents])


def test_simhash_odd_rows(odd, none):
    docs = [(r[0], r[1]) for r in odd_rows()]
    groups = check_simhash(simhash.simhash_components(odd).collect(), docs)
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    want = [min((docs[k][0] for k in g), key=key) for g in groups.values()]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert simhash.near_dedup(none).count() == 0


def test_covering_masks_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(6)
    masks = np.array(simhash.masks(4), dtype=np.int64).view(np.uint64)
    assert len(masks) == 31
    for _ in range(3000):
        bits = rng.choice(64, size=int(rng.integers(0, 5)), replace=False)
        diff = np.uint64(sum(1 << int(b) for b in bits))
        assert (masks & diff == 0).any()


def test_links_in_chunked_buckets_and_long_chains(spark):
    rng = np.random.default_rng(7)
    # A chain (each step flips three bits), a dense cluster and loners.
    chain = [int(rng.integers(0, 1 << 62))]
    for _ in range(150):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    centre = int(rng.integers(0, 1 << 62))
    dense = [centre ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(400)]
    values = sorted({*chain, *dense, *(int(x) for x in rng.integers(0, 1 << 63, 500))})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(i, i, v) for i, v in enumerate(signed)], "_row bigint, doc bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.components(df, chunk=16).collect()}
    assert [got[v] for v in signed] == brute.components(values)
