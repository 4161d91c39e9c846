"""Operators that judge each text alone, against plain Python."""

import html
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from checks.compare import connect
from paddock.llm import containment, kneser_ney, neighbours, piece_lattice, queries, repetition, site_style, stream_vbyte, url_templates
from paddock.llm import textbytes as tb
from tests.llm.conftest import ODD, SF, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    held = connect(SF).execute(queries.ORACLES[name])
    names = [d[0] for d in held.description]
    assert sorted(got.columns) == sorted(names)
    expected = sorted(repr(tuple(dict(zip(names, r))[c] for c in got.columns)) for r in held.fetchall())
    assert sorted(repr(tuple(v.item() if hasattr(v, "item") else v for v in r)) for r in got.itertuples(index=False, name=None)) == expected


def counted(text):
    """Repetition counts of one text, the plain way."""
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_repetition_counts(spark, odd, nothing):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in repetition.repetition_rules(odd).collect()}
    assert got == {(i, *counted(t)) for i, t in ODD}
    assert repetition.repetition_rules(nothing).count() == 0


def test_long_regular_lines_differ(spark):
    """A Thue-Morse word and its complement hash alike modulo 2**64."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word}\n{other}"), (2, f"{word}\n{other}\n{word}"), (3, f"x {word} y x {other} y x {word} y")]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in repetition.repetition_rules(documents(spark, rows)).collect()}
    assert got == {(i, *counted(t)) for i, t in rows}


def test_repetition_verdict(spark):
    fresh = " ".join(f"w{k}" for k in range(200))
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(1, fresh), (2, fresh + (" " + passage) * 8), (3, "\n".join(["a line of it"] * 3 + [f"line {k} is new" for k in range(4)] + [fresh])), (4, "few words")]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in repetition.repetition_rules(documents(spark, rows)).collect()}
    assert kept == {1: (False, True), 2: (False, False), 3: (False, True), 4: (True, False)}


def accuracy(spark, classify, label, tables):
    got = {r.doc_id: r for r in classify(tables["documents"], tables["labels"]).collect()}
    for r in got.values():
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    rows = [(got[r.doc_id].predicted, r[label]) for r in tables["labels"].collect() if got[r.doc_id].held_out]
    return np.mean([a == b for a, b in rows])


def test_quality_on_held_out_rows(spark, tables):
    assert accuracy(spark, neighbours.classify, "quality", tables) > 0.8


def test_toxicity_on_held_out_rows(spark, tables):
    assert accuracy(spark, kneser_ney.classify, "toxic", tables) > 0.8


@pytest.mark.parametrize("module", [neighbours, kneser_ney])
def test_classifiers_on_odd_tables(spark, module, odd, nothing, tables):
    none = tables["labels"].limit(0)
    column = "quality" if module is neighbours else "toxic"
    labels = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    for found in (labels, none):
        rows = module.classify(odd, found, column).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert module.classify(nothing, none, column).count() == 0


def test_toxic_words_decide(spark):
    random.seed(4)
    vocabulary = ["".join(random.choices("abcdehilmnorstu", k=random.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = random.choices(vocabulary, k=80)
        if i % 4 == 0:
            for _ in range(4):
                words[random.randrange(80)] = random.choice(["zog", "grub", "fnord"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    got = kneser_ney.classify(documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got if r.held_out]) > 0.95


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_containment(spark, odd, nothing):
    item = " ".join(f"i{k}" for k in range(40))
    long = " ".join(f"d{k}" for k in range(9000))
    scattered = " ".join(item.split()[:20]) + " " + long + " " + " ".join(item.split()[17:]).upper()
    rows = [(1, long + " " + item), (2, scattered), (3, " ".join(item.split()[:30])), (4, None), (None, item), (5, item.replace(" ", "\n"))]
    items = spark.createDataFrame([(7, item, 1), (8, "too few words", 1), (9, None, 1), (None, item, 1)], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in containment.contaminated(documents(spark, rows), items).collect()}
    expected = set()
    for i, t in rows:
        for j, x in ((7, item), (None, item)):
            n = len(shingles(t, 5) & shingles(x, 5))
            if 100 * n >= 80 * len(shingles(x, 5)):
                expected.add((i, j, n))
    assert got == expected and {i for i, _, _ in got} == {1, 2, None, 5}
    assert containment.contaminated(nothing, items).count() == 0 == containment.contaminated(odd, items.limit(0)).count()
    clean = containment.without_items(documents(spark, rows, clashing=True), items)
    assert {r.doc_id for r in clean.collect()} == {3, 4} and "bucket" in clean.columns


def test_containment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_HASHES", 40)
    items = spark.createDataFrame([(k, " ".join(f"i{k}_{w}" for w in range(20))) for k in range(12)], "item_id bigint, text string")
    docs = documents(spark, [(k, f"before {r.text} after") for k, r in enumerate(items.orderBy("item_id").collect())])
    assert sorted((r.doc_id, r.item_id) for r in containment.contaminated(docs, items).collect()) == [(k, k) for k in range(12)]


def test_sketch_cannot_miss():
    for size in range(1, 300):
        assert containment.sketch_length(size, 80) >= size - math.ceil(0.8 * size) + 1


def test_vbyte_round_trip():
    values = np.array([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1] * 7, np.uint32)
    control, data = stream_vbyte.encode(values)
    assert len(control) == -(-len(values) // 4) and len(data) == 7 * (3 * 1 + 2 * 2 + 2 * 3 + 2 * 4)
    back = stream_vbyte.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert (back == values).all() and len(stream_vbyte.decode(np.zeros(0, np.uint8), np.zeros(0, np.uint8), 0)) == 0


SPACES = ["a  b", "a   b", " a", "a ", "a  ", "\n b", "a \nb", "a\n  b", "\u00a0 b", "a \u00a0 b", "it's  <|endoftext|> x", "nul\0 byte  x", "tab\t x", "", " ", "  "]


def test_ids_are_the_tokenizers(spark, tmp_path):
    """Cuts made before the tokenizer are cuts it makes itself: odd white space, marks, contractions, special tokens."""
    random.seed(6)
    signs = [*"abé \n\t\r.,'s\"<|>t$_-012²º×÷ɏǅ漢😀\x85\xa0\x1c\u2003", " ", "'re", "'ll", "'s", "<|endoftext|>", " the", " don't"]
    texts = [" \xa0 \xa0 don't", "a\n \n b", "x  y ", "it's 'they''ll'", "'s", "l'", "'r"]
    texts += ["".join(random.choice(signs[: random.choice([16, len(signs)])]) for _ in range(random.randrange(40))) for _ in range(3000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    stream_vbyte.write(documents(spark, list(enumerate(texts))), f"{tmp_path}/f", path)
    got = {r.doc_id: r.ids for r in stream_vbyte.read(spark, f"{tmp_path}/f").collect()}
    plain = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [k for k, e in enumerate(plain) if got[k] != [*e.ids, 0]] == []


def test_token_file(spark, odd, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_vbyte, "BLOCK_IDS", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, t) for i, t in ODD if i is not None and (i, t) != ODD[4]] + [(100 + k, t) for k, t in enumerate(SPACES)]
    stream_vbyte.write(documents(spark, rows, clashing=True), f"{tmp_path}/f", path)
    got = {r.doc_id: r for r in stream_vbyte.read(spark, f"{tmp_path}/f").collect()}
    tokenizer, at = Tokenizer.from_file(path), 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].ids, got[i].start, got[i].n_tokens) == (ids, at, len(ids)), repr(t)
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    stream_vbyte.write(odd, f"{tmp_path}/odd", path)
    assert stream_vbyte.read(spark, f"{tmp_path}/odd").count() == len(ODD)
    stream_vbyte.write(nothing, f"{tmp_path}/none", path)
    assert stream_vbyte.read(spark, f"{tmp_path}/none").count() == 0


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_segmentations_decode_and_differ(spark, odd, nothing):
    rows = piece_lattice.sampled_segmentations(odd, MODEL, samples=3).collect()
    assert all(r.decodes for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.ids_crc32), []).append(tuple(r.ids))
    assert len({tuple(r.ids) for r in rows if r.doc_id == 7}) == 3
    assert sum(r.doc_id == 0 for r in rows) == 1 and [r.log_inclusion for r in rows if r.doc_id == 0] == [0.0]
    again = piece_lattice.sampled_segmentations(odd.repartition(5), MODEL, samples=3).collect()
    assert sorted((r.doc_id or -1, r.sample, r.ids_crc32) for r in rows) == sorted((r.doc_id or -1, r.sample, r.ids_crc32) for r in again)
    assert piece_lattice.sampled_segmentations(nothing, MODEL).count() == 0


def test_long_regular_words_have_lattices_of_their_own():
    """A Thue-Morse word and its complement, which hash alike modulo 2**64, are two words."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    text = f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}"
    codes, _ = piece_lattice._codes([text])
    start = np.flatnonzero(codes == ord("▁"))
    lattice = piece_lattice.Lattice(codes, start, np.append(start[1:], len(codes)), piece_lattice.Pieces.of(MODEL))
    assert lattice.word[0] == lattice.word[2] != lattice.word[1]


def paths(pieces, known, word):
    if not word:
        yield (), 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            i, w = known[word[:n]]
            for rest, more in paths(pieces, known, word[n:]):
                yield (i, *rest), w + more


def test_segmentations_follow_the_lattice():
    import sentencepiece

    pieces = piece_lattice.Pieces.of(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    weight = dict(zip(pieces.ids.tolist(), pieces.logs.tolist()))
    known = {model.id_to_piece(i): (i, weight[i]) for i in range(model.get_piece_size()) if i in weight}
    all_ = {a + b: x + y for a, x in paths(pieces, known, "▁the") for b, y in paths(pieces, known, "▁cats")}
    total = np.logaddexp.reduce(list(all_.values()))
    keys = tb.mix(np.arange(4000, dtype=np.uint64) * np.uint64(77))
    ((_, _, samples),) = piece_lattice.segment(["the cats"] * 4000, keys, pieces, 3)
    seen, first, weighed = Counter(), Counter(), Counter()
    for s, (exists, ids, at, log_p, inclusion) in enumerate(samples):
        assert exists.all()
        for t in range(4000):
            path = tuple(ids[at[t] : at[t + 1]].tolist())
            assert abs(log_p[t] - (all_[path] - total)) < 1e-6
            seen[path] += 1
            first[path] += s == 0
            weighed[path] += np.exp(-inclusion[t])
    noise = np.random.default_rng(0).gumbel(size=(50_000, len(all_))) + np.array(list(all_.values()))
    drawn = np.bincount(np.argpartition(-noise, 3, axis=1)[:, :3].ravel(), minlength=len(all_)) / 50_000
    for (path, w), share in zip(all_.items(), drawn):
        assert abs(first[path] / 4000 - np.exp(w - total)) < 0.02
        assert abs(seen[path] / 4000 - share) < 0.02
        if share > 0.2:  # inverse inclusion scores sum to one for every path
            assert abs(weighed[path] / 4000 - 1) < 0.1
    assert len(set(tuple(ids[at[0] : at[1]].tolist()) for _, ids, at, _, _ in samples)) == 3


def test_segmentations_of_the_query_have_ids(spark):
    assert "ids" in queries.QUERIES["op7_gumbel_lattice"](spark, SF).columns


def test_lattices_of_many_texts_take_bounded_memory():
    """Words of six letters, most of them new to their piece, in 2.6 MB of texts."""
    pieces = piece_lattice.Pieces.of(MODEL)
    rng = np.random.default_rng(3)
    words = ["".join(w) for w in rng.choice(list("etaoinshrdlu"), (120_000, 6))]
    texts = [" ".join(words[k] for k in rng.integers(0, len(words), 300)) for _ in range(1250)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tb.powers(4 * tb.PIECE_BYTES)
    tracemalloc.start()
    seen = 0
    for part, _, _ in tb.pieces(iter([batch]), "text", piece_lattice.PIECE):
        some = tb.column(part, "text").to_pylist()
        keys = np.arange(len(some), dtype=np.uint64)
        seen += sum(b - a for a, b, _ in piece_lattice.segment(some, keys, pieces, 2, piece_lattice.TOGETHER))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(texts) and peak < 100e6, peak


def test_all_segmentations_of_a_short_text():
    pieces = piece_lattice.Pieces.of(MODEL)
    ((_, _, samples),) = piece_lattice.segment(["ab"], np.array([5], np.uint64), pieces, 12)
    out = [(e[0], tuple(i[a[0] : a[1]].tolist()), inc[0]) for e, i, a, _, inc in samples]
    there = [o for o in out if o[0]]
    assert len({o[1] for o in there}) == len(there) < 12 and all(o[2] == 0 for o in there)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- a <p>comment</p> --><article><header><h1>Head &amp; line</h1></header><p>One  <b>bold</b>
text &#233;<p>Two<br>three &nbsp;four<form>Your name<input></form><aside>See also</aside><section class="comments"><p>Nice!</p></section></article>
<div id="sidebar">Side</div><footer>&copy; us</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "http://a.b/x", PAGE), (2, None, None), (3, "no scheme", ""), (4, "http://a.b/y", PAGE[: PAGE.index("three") + 3]), (5, "http://c/", "just text &lt; <b>bold"), (5, "http://c/", "just text &lt; <b>bold")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as node", "3 as text")
    got = site_style.main_text(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted(
        (i, t, len(t)) for i, t in [(1, "Head & line\nOne bold text é\nTwo\nthree four"), (2, ""), (3, ""), (4, "Head & line\nOne bold text é\nTwo\nthr"), (5, "just text < bold"), (5, "just text < bold")]
    )
    assert site_style.main_text(df.limit(0)).count() == 0


def test_low_branches_are_removed(spark):
    pages = [
        (k, f"http://site.org/{k}", f"<body><div class='top'><p>The Daily Site</p></div><div class='story'><p>Story {k} with words {k * 7} of its own and more of them</p></div></body>")
        for k in range(20)
    ]
    got = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Story {k} with words {k * 7} of its own and more of them" for k in range(20)}


def test_pages_of_the_tables(spark, tables):
    got = {r.page_id: r.text for r in site_style.main_text(tables["pages"]).collect()}
    for r in tables["pages"].collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(p|h1|/p|/h1|br)>", "\x01", article)))
        assert got[r.page_id] == "\n".join(x for x in (" ".join(b.split()) for b in plain.split("\x01")) if x)


URLS = [
    "http://A.Example.NET/en/1?x#y", "https://example.net/de/2", "http://x.example.com/de/3#top", "https://q.org/fr/9/", "https://q.org?/fr/9", None,
    "no scheme", "http://", "http://net/en/", "http://evilexample.com/de/1", "http://x.net", "ftp://h/p?a://b", "http://h.com/a#/b",
]


def ruled(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for v, h, p in url_templates.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id bigint, url string").selectExpr("*", "1 as host", "2 as n", "3 as bad")
    none = spark.createDataFrame([], "page_id bigint, bad int")
    for r in url_templates.judge_urls(df, none).collect():
        host, path, rule, verdict = ruled(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_templates.judge_urls(df.limit(0), none).count() == 0


def test_url_templates(spark):
    pages = [(k, f"http://h.com/{'junk' if k % 2 else 'news'}/{'abcdefghij'[k % 10]}{'qrstuvwxyz'[k // 10 % 10]}{'klmno'[k // 100]}/{k}.html") for k in range(400)]
    labels = [(k, int(k % 2)) for k in range(0, 400, 3)]
    got = url_templates.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert {(r.template, r.verdict) for r in got} == {("/junk/*/#.html", "block"), ("/news/*/#.html", "allow")}


def test_url_templates_of_long_paths(spark):
    deep = [(k, f"http://h.com/a/b/c/d/e/f/{'spam' if k % 2 else 'ok'}/{'abcdefghij'[k % 10]}{'qrstuvwxyz'[k // 10 % 10]}{'klmno'[k // 100]}") for k in range(400)]
    one = [(1000, "http://h.com/" + "/".join("xyz"[k % 3] for k in range(300)))]
    labels = [(k, int(k % 2)) for k in range(0, 400, 3)]
    got = url_templates.judge_urls(spark.createDataFrame(deep + one, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    held = {(r.template, r.verdict) for r in got if r.page_id < 1000}
    assert held == {("/a/b/c/d/e/f/spam/*", "block"), ("/a/b/c/d/e/f/ok/*", "allow")}
    assert [r.template for r in got if r.page_id == 1000] == [one[0][1][len("http://h.com") :]]


def test_url_branches_merge_upwards(spark):
    """A leaf without labels, and a parent without any, are judged by what lies above."""
    pages = [(k, f"http://h.com/bad/x{'abcdefgh'[k % 8]}/{'pqrstuvw'[k // 8 % 8]}/page") for k in range(64)] + [(100 + k, f"http://h.com/good/{'abcdefgh'[k % 8]}/page") for k in range(64)]
    labels = [(k, 1) for k in range(64) if k % 8] + [(100 + k, 0) for k in range(64)]
    got = url_templates.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")).collect()
    assert {r.verdict for r in got if r.page_id < 64} == {"block"} and {r.verdict for r in got if r.page_id >= 100} == {"allow"}
    assert len({r.purity for r in got if r.page_id < 64}) == 1


def test_names_do_not_empty_a_page(spark):
    text = "A story that is told at some length here and goes on"
    sources = [
        f"<body class='has-sidebar'><article class='post no-comments'><p>{text}</p></article></body>",
        f"<body class='comments'><div id='content-widget'><p>{text}</p></div></body>",
        f"<body><div class='widget'><main role='main' class='search'><p>{text}</p></main></div></body>",
        f"<body><div class='widget'><p>{text}</p></div></body>",
        f"<article><p>{text}</p><figure><figcaption>{text}</figcaption></figure><dialog>{text}</dialog><label>{text}</label></article>",
        f"<body><article><p>{text}</p><div class='comments'><article>Nice</article></div></article></body>",
    ]
    df = spark.createDataFrame([(k, f"http://h{k}.org/", s) for k, s in enumerate(sources)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in site_style.main_text(df).collect()}
    assert got == {0: text, 1: text, 2: text, 3: text, 4: "\n".join([text] * 4), 5: text}


def test_shared_counts_are_exact(spark):
    texts = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000]} often" for k in range(5000)]
    words, heads, _ = kneser_ney.words_of(*tb.flat(pa.array(texts)))
    keys, n = np.unique(words, return_counts=True)
    openings, m = np.unique(heads, return_counts=True)
    used, all_used = kneser_ney.shared_counts(documents(spark, list(enumerate(texts))).repartition(7), keys, openings)
    assert used.tolist() == n.tolist() and all_used.tolist() == m.tolist()
