"""Cases that once went wrong: lost or foreign text, memory, special strings, wide blanks, other languages."""

import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from rarefy.llm import html_template, oracle, packing, pii, quality_rules, voronoi_knn
from rarefy.llm.common import public_vocabulary
from rarefy.llm.text_encoding import Encoder

from . import brute


@pytest.mark.parametrize("page,want", [
    ('<article><svg class="i"/><h1>T</h1><p>Hello world</p></article>', "T\nHello world"),
    ('<article><h1>T</h1><svg><path d="M0"/><title>x</title></svg><p>Hello</p><svg/></article>', "T\nHello"),
    ("<article><p>One</p><object data=x><p>Two</p></article>", "One\nTwo"),
    ("<article><p>So <math><mi>x</mi></math> is <math/> it</p><canvas id=c></canvas><p>End</p></article>",
     "So x is it\nEnd"),
    ("<article><p>A</p><script>var a='<p>'</script><style>p{}</style><textarea><p>t</textarea><p>B</p></article>",
     "A\nB"),
])
def test_elements_beside_text_do_not_swallow_it(page, want):
    assert html_template.page_text(page) == want


def pages_of(spark, layouts):
    rows = [(i, f"http://host.example/{i}", h) for i, h in enumerate(layouts)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    return {r.page_id: r.text for r in html_template.extract_main_text(df).collect()}


def test_a_listing_page_does_not_change_its_host(spark):
    page = ("<body><div class=wrap><div class=by>Posted by user{i} on day {i}</div><article><h1>Title {i}</h1>"
            "<p>The text of page {i}</p></article></div></body>")
    listing = ("<body><div class=wrap><article><h1>One</h1><p>First</p></article><article><h1>Two</h1>"
               "<p>Second</p></article></div></body>")
    got = pages_of(spark, [page.format(i=i) for i in range(8)] + [listing])
    assert got.pop(8) == "One\nFirst\nTwo\nSecond"
    assert got == {i: f"Title {i}\nThe text of page {i}" for i in range(8)}


def test_an_own_article_wins_over_the_host_container(spark):
    plain = "<body><div class=post><h1>T{i}</h1><p>Text {i}</p></div><div class=x>Copyright by us</div></body>"
    other = "<body><div class=post><p>Around</p><article><p>The article</p></article></div></body>"
    got = pages_of(spark, [plain.format(i=i) for i in range(9)] + [other])
    assert got.pop(9) == "The article"
    assert got == {i: f"T{i}\nText {i}" for i in range(9)}


def test_packing_many_equal_pieces_in_little_memory():
    lengths = np.array([600] * 5000 + [1] * 400)
    began = time.time()
    tracemalloc.start()
    bins = packing.local_search(lengths, packing.best_fit_decreasing(lengths, 1024), 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bins) == 5000 and peak < 100 << 20 and time.time() - began < 30
    assert sorted(i for b in bins for i in b) == list(range(5400))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_strings_are_encoded_as_by_the_library(name):
    enc, tok = Encoder(public_vocabulary(name)), brute.tokenizer(name)
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "<|startoftext|>", "no <| such |> thing", ""]
    assert list(enc.ids(texts)) == [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
                                    for t in texts]
    assert np.frombuffer(next(enc.ids(["hello <|endoftext|> world"])), dtype="<u4").size == len(
        tok.encode("hello <|endoftext|> world", add_special_tokens=False).ids) < 7
    as_text = Encoder(public_vocabulary(name), special_as_text=True)
    assert len(next(as_text.ids(["<|endoftext|>"]))) > 4


def test_special_strings_in_packed_documents(spark):
    tok, text = brute.tokenizer("byte_bpe_50k.json"), "hello <|endoftext|> world"
    got = packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    ids = brute.ids(tok, text)
    assert [(r.length, r.ids_crc32) for r in got] == [(len(ids), zlib.crc32(ids.tobytes()))]


@pytest.mark.parametrize("blanks", [0, 3, 4, 10, 1000])
def test_any_number_of_blanks_after_a_cue(blanks):
    gap = " " * blanks
    for text, kind, value in ((f"token{gap}={gap}abcd12345678 end", "secret", "abcd12345678"),
                              (f"account no:{gap}1234567890 end", "account", "1234567890")):
        at = text.index(value)
        assert (kind, at, at + len(value)) in [tuple(s) for s in pii.find_spans(text)]
        assert value not in pii.redact(text, pii.find_spans(text))


def test_quality_twin_follows_the_language(spark):
    words = " ".join(f"слово{i} речь{i}" for i in range(40))
    documents = pd.DataFrame({"doc_id": [1, 2, 3], "text": [words] * 3, "lang": ["ru", "en", None],
                              "source": ["s"] * 3, "n_chars": [len(words)] * 3})
    con = duckdb.connect()
    con.register("documents", documents)
    twin = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, kept FROM ({oracle.SQL['op6_quality_rules']})").fetchall()}
    rows = quality_rules.quality_verdicts(spark.createDataFrame(
        [(int(i), words, lang) for i, lang in zip((1, 2, 3), ("ru", "en", None))],
        "doc_id bigint, text string, lang string")).collect()
    stop = set(quality_rules.STOP_WORDS)
    assert {r.doc_id: r.kept for r in rows} == twin == {
        i: brute.kept(words, quality_rules.RULES, stop, lang) for i, lang in ((1, "ru"), (2, "en"), (3, None))}
    assert twin == {1: True, 2: False, 3: True}


def occurrence_template(pages):
    """Strings that stand on all pages of a host in a class with two element tokens, by explicit vectors."""
    vectors = defaultdict(Counter)
    strings = {}
    for i, page in enumerate(pages):
        texts, opened = html_template.read_page(page)
        for n in opened:
            vectors["e", n.token][i] += 1
        for t in texts:
            words = " ".join(t.text.split())
            if words:
                vectors["s", t.last.token, words][i] += 1
                strings["s", t.last.token, words] = words
    classes = defaultdict(list)
    for token, vector in vectors.items():
        classes[tuple(sorted(vector.items()))].append(token)
    return {strings[t] for vector, tokens in classes.items() for t in tokens
            if t in strings and len(vector) == len(pages) and sum(x[0] == "e" for x in tokens) >= 2}


def test_template_by_explicit_occurrence_vectors(spark):
    layout = ("<body><div class=top>Welcome to the site</div><div class=main><div class=post><h2>Title {i}</h2>"
              "<p>Own words {i}</p>{more}</div></div><div class=low><div>Owned by the owner</div></div></body>")
    pages = [layout.format(i=i, more="<p>More %d</p>" % i * (i % 3)) for i in range(7)]
    template = occurrence_template(pages)
    assert template == {"Welcome to the site", "Owned by the owner"}
    want = {}
    for i, page in enumerate(pages):
        texts, _ = html_template.read_page(page)
        blocks = defaultdict(str)
        for t in texts:
            if " ".join(t.text.split()) not in template:
                blocks[t.block] += t.text
        want[i] = "\n".join(b for _, b in sorted(blocks.items()) if b.strip())
    assert pages_of(spark, pages) == want


@pytest.mark.parametrize("page,text", [
    ("<body><article>" + "<font>" * 100_000 + "deep</article>", "deep"),
    ("<body>" + "<div>a" * 50_000, "\n".join("a" * 50_000)),
    ("<body><article>" + "<font>x" * 60_000 + "</b></i>" * 60_000, "x" * 60_000),
])
def test_deep_pages_in_bounded_memory(page, text):
    began = time.time()
    tracemalloc.start()
    assert html_template.page_text(page) == text
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and time.time() - began < 60


def test_deep_pages_without_an_article_on_a_host(spark):
    deep = "<body><div class=post>" + "<font>w " * 3000 + "{i}</div><div class=low>Owned by the owner</div></body>"
    got = pages_of(spark, [deep.format(i=i) for i in range(4)])
    assert got == {i: "w " * 3000 + str(i) for i in range(4)}


def pairs_sent(spark, caplog, x, every):
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    with caplog.at_level("INFO", logger=voronoi_knn.__name__):
        got = voronoi_knn.top_k_inner_product(df, query=f"vec_id % {every} = 0", k=5).collect()
    whole = np.floor(64 * x)
    want = []
    for q in range(0, len(x), every):
        s = whole[q] @ whole.T
        best = sorted((-s[i], i) for i in range(len(x)) if i != q)[:5]
        want += [(q, k, i, int(-v)) for k, (v, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == want
    a, b = caplog.records[-1].args
    return a / b


def test_top_k_prunes_clustered_vectors(spark, caplog):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    x = 4 * centers[rng.integers(20, size=1500)] + 0.02 * rng.normal(size=(1500, 16))
    assert pairs_sent(spark, caplog, x, 10) < 0.5


def test_top_k_of_unclustered_vectors(spark, caplog):
    x = np.random.default_rng(2).normal(size=(600, 16))
    assert pairs_sent(spark, caplog, x, 10) <= 1.0


def test_groups_that_need_all_rows_are_merged():
    sent, sizes = dict.fromkeys(range(24), 50_000), dict.fromkeys(range(24), 100)
    assert voronoi_knn.merged_groups(sent, sizes, 50_000, 2048) == set(range(24))
    assert voronoi_knn.merged_groups(dict.fromkeys(range(24), 2_000), sizes, 50_000, 2048) == set()
    some = {g: 50_000 if g < 5 else 100 for g in range(24)}
    # Small groups ride along while the merged queries fit one block.
    assert voronoi_knn.merged_groups(some, sizes, 50_000, 2048) == set(range(20))
    assert voronoi_knn.merged_groups({}, {}, 10, 2048) == set()
