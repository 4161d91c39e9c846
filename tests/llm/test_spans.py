"""Secret spans, runs of words and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paddock.llm import hard_negatives, secret_owners, suffix_dedup, word_runs
from paddock.llm import queries as corpus
from paddock.llm import textbytes as tb
from tests.llm.conftest import SF, documents

WORD = re.compile("[^\x20\x09-\x0d]+")
EMPTY = hashlib.sha256(b"").hexdigest()


# --- runs of words


def runs_of(w):
    """All runs by walking every period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def described(i, text, plant):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode())
    if plant and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = runs_of(w)
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < e for s, e, q in runs)]
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (i, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(), n, len(kept))


def test_cover():
    assert {(b - a) % word_runs.MODULUS for a in word_runs.COVER for b in word_runs.COVER} == set(range(word_runs.MODULUS))


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 260))]
            for _ in range(rng.randint(0, 3) if w else 0):
                a = rng.randrange(len(w))
                p = rng.randint(1, max(1, (len(w) - a) // 4))
                for x in range(a, rng.randint(a, len(w))):
                    w[x] = w[a + (x - a) % p]
            texts.append(w)
        offs = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        got = [tuple(r) for r in word_runs.find_runs(np.array(sum(texts, []), np.int64), offs).tolist()]
        assert got == [(s + o, e + o, q) for w, o in zip(texts, offs, strict=False) for s, e, q in runs_of(w)]


def test_equal_ends_at_a_block_border():
    tail = list(range(10, 10 + 2 * word_runs.MODULUS))
    texts = [[1, 2, 3, 4, 5] + tail * 4, [7, 8, 9, 6, 5] + tail * 4]
    offs = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
    got = word_runs.find_runs(np.array(texts[0] + texts[1]), offs)
    assert [tuple(r) for r in got.tolist()] == [(5, 253, 62), (258, 506, 62)]


@pytest.mark.parametrize("plant", [False, True])
def test_periodic_runs(spark, plant):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a b c été 漢 dd".split()) for _ in range(rng.randrange(120)))) for i in range(120)]
    got = [tuple(r) for r in word_runs.periodic_runs(documents(spark, rows, clashing=True), plant=plant).collect()]
    assert sorted(got) == sorted(described(i, t, plant) for i, t in rows)


def test_runs_of_odd_rows(spark, odd, nothing):
    got = {r.doc_id: r for r in word_runs.periodic_runs(odd, plant=True).collect()}
    assert word_runs.periodic_runs(odd).count() == odd.count() and word_runs.periodic_runs(nothing).count() == 0
    for i in (0, 1, 2):
        assert (got[i].n_runs, got[i].start, got[i].runs_sha256, got[i].collapsed_sha256) == (0, None, EMPTY, EMPTY)
    assert tuple(got[4]) == described(4, "same words here and there " * 30, True)
    assert tuple(got[None]) == described(None, "a row without an id " * 5, False)
    assert got[7].n_words == 30_000


def test_runs_in_slices_of_the_grid(monkeypatch):
    w = np.array(([1, 2, 3] * 40 + list(range(9, 60))) * 5)
    offs = np.array([0, 300, len(w)])
    whole = word_runs.find_runs(w, offs)
    monkeypatch.setattr(word_runs, "GRID_SLICE", 7)
    assert (word_runs.find_runs(w, offs) == whole).all() and len(whole) == 5


def test_collapsed(spark, odd, nothing):
    rows = [(1, "x\ty  z"), (2, "go on " * 9 + "end"), (3, None), (4, "a  b")]
    got = {r.doc_id: r.text for r in word_runs.collapsed(documents(spark, rows, clashing=True)).collect()}
    assert got == {1: "x\ty  z", 2: "go on end", 3: None, 4: "a  b"}
    assert word_runs.collapsed(odd).columns == odd.columns and word_runs.collapsed(nothing).count() == 0


# --- secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
KINDS = ("assign", "access", "hex", "owned")


def live(v):
    return sum(c.isalpha() for c in v) >= 2 and sum(c.isdigit() for c in v) >= 2 and len(set(v.lower())) >= 8


def secrets(rows):
    """By Python's own matcher: (doc_id, counts, base digest, spans, live, examples)."""
    found, owners = [], {}
    for i, text, owner in rows:
        text = text or ""
        assigned = list(ASSIGN.finditer(text))
        base = [(m.start(), 0, m.end(), m[2]) for m in assigned if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        tokens, at = [], 0
        for cut in [*assigned, None]:
            part = text[at : cut.start() if cut else len(text)]
            for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", part):
                if live(m[0]) and not re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", m[0]):
                    tokens.append((at + m.start(), 3, at + m.end(), m[0]))
            at = cut.end() if cut else at
        found.append((i, sorted(base), sorted(tokens)))
        for s in base + tokens:
            owners.setdefault(s[3].lower(), set()).add(owner)
    out = []
    for i, base, tokens in found:
        line = lambda spans: ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in sorted(spans))
        n = lambda s: len(owners[s[3].lower()])
        alive = [s for s in base + tokens if n(s) <= 2 and live(s[3])]
        out.append((
            i, *[sum(s[1] == k for s in base) for k in range(3)], hashlib.sha256(line(base).encode()).hexdigest(),
            line(base + [s for s in tokens if s in alive]), len(alive), sum(n(s) > 2 for s in base + tokens),
        ))
    return sorted(out, key=repr)


def found_in(spark, rows):
    df = spark.createDataFrame([(i, t, o, 1, 2) for i, t, o in rows], "doc_id bigint, text string, source string, span int, hash int")
    return sorted((tuple(r) for r in secret_owners.secret_spans(df).drop("live").collect()), key=repr)


def test_secret_spans(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdef0123456789") for _ in range(k))
    pool = [word(20) for _ in range(6)] + ["AKIA" + "".join(rng.choice("ABCXYZ0189") for _ in range(k)) for k in (13, 14, 16)]
    pool += ["".join(rng.choice("ABxyz01+/_=-.") for _ in range(k)) for k in (15, 16, 17, 30, 40)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append(rng.choice([
                rng.choice(pool), "Password = ", "token=", "secret:", "api_KEY' : \"", "apikey=", "é漢 ", " ", "\n", "token=password=", "ſecret=kKK",
                word(15), word(16), "AKIA", "x" * 20, f"passwd={word(11)}", f"passwd={word(12)}", "PASSWORD", "=", "😀",
            ]))
        rows.append((i, "".join(parts), f"src{rng.randrange(4)}"))
    assert found_in(spark, rows) == secrets(rows)


def test_many_matches_in_one_text(spark):
    rows = [(1, " ".join(f"{k:016x}" for k in range(5 * secret_owners.BLOCK + 3)), "a"), (2, "deadbeef01234567" * 4, "b")]
    assert found_in(spark, rows) == secrets(rows)


def test_examples_and_owned(spark):
    key, own = "Zx9Qw8Er7Ty6Ui5Op4", "Aa1Bb2Cc3Dd4Ee5Ff6"
    rows = [(k, f"see {key} there", f"src{k % 3}") for k in range(9)] + [(50, f"mine {own}", "src0"), (51, f"mine {own.upper()}", "src1")]
    got = {r[0]: r for r in found_in(spark, rows)}
    assert got[0][5:] == ("", 0, 1) and got[50][5:] == ("owned:5:23", 1, 0) and got[51][5:] == ("owned:5:23", 1, 0)


def test_secrets_of_odd_rows(spark, odd, nothing):
    got = secret_owners.secret_spans(odd).collect()
    assert len(got) == odd.count() and {r.base_sha256 for r in got} == {EMPTY}
    assert secret_owners.secret_spans(nothing).count() == 0
    rows = [(None, "token=abcdefghijkl12", None), (None, "token=abcdefghijkl12", None), (3, None, "a"), (3, "", "a")]
    assert found_in(spark, rows) == secrets(rows)


def test_no_python_in_the_secret_scan(spark, tables):
    plan = secret_owners.secret_spans(tables["documents"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- hard negatives


def mined(rows, scale=256):
    """(anchor, positive, rank, negative, scores) with every pair scored in Python integers."""
    held = [(k, i, label, [int(np.floor(scale * float(x))) for x in v]) for k, (i, label, v) in enumerate(rows)]
    out = []
    for k, i, label, v in held:
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j, other) for m, j, other, w in held if m != k), key=lambda s: s[:2] + (s[2] or 0,))
        for p, _, pid, _ in [s for s in scored if s[3] == label][:5]:
            fits = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, pid, r, s[2], -p, -s[0]) for r, s in enumerate(fits, 1)]
    return sorted(out, key=repr)


def negatives_of(spark, rows, **given):
    df = spark.createDataFrame([(i, label, v, 1, 2) for i, label, v in rows], "vec_id bigint, label int, embedding array<double>, uid int, score int")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **given).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 20))
    rows = [(int(i) * 25, int(k := rng.integers(4)), (centres[k] * 0.4 + rng.normal(size=20)).tolist()) for i in rng.permutation(500)]
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 50)
    monkeypatch.setattr(hard_negatives, "AIMS", (2, 12))
    assert negatives_of(spark, rows) == mined(rows)


def test_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(2)), rng.integers(0, 2, 4).astype(float).tolist()) for i in range(0, 900, 10)]
    rows += rows[:20] + [(None, 0, [1.0, 1.0, 0.0, 1.0]), (None, 1, [1.0, 1.0, 0.0, 1.0])]
    assert negatives_of(spark, rows) == mined(rows)


def test_rows_that_take_no_part(spark):
    good = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.25]), (3, 2, [0.5])]
    bad = [(4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [float("nan"), 1.0]), (8, 2, [float("inf"), 1.0]), (9, 2, [1e308, 0.0])]
    assert negatives_of(spark, good + bad) == mined(good) != []
    assert negatives_of(spark, bad) == [] and negatives_of(spark, good[1:]) == []


def test_scores_beyond_exact_doubles(spark):
    rows = [(0, 1, [3e5, 1.0]), (1, 1, [4e5, 7.0]), (2, 2, [2e5, 3.5]), (3, 2, [1.5e5, 9.25])]
    assert negatives_of(spark, rows) == mined(rows) != []


def test_cells_leave_components_out():
    """Lists without the light leading components return what full products do."""
    rng = np.random.default_rng(2)
    weights = np.geomspace(0.01, 30, 40)
    rows, anchors = np.floor(rng.normal(size=(700, 40)) * weights * 50), np.floor(rng.normal(size=(30, 40)) * weights * 50)
    score = (rows @ anchors.T).astype(np.int64)
    least = np.sort(score, 0)[-25]
    i, j, s = hard_negatives._reaching(rows, anchors, least)
    assert set(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == {
        (a, b, int(score[a, b])) for a, b in zip(*np.nonzero(score >= least[None, :]), strict=True)
    }


@pytest.mark.parametrize("name", ["op11_secret_owners", "op12_hard_negatives", "op13_word_runs"])
def test_queries_of_the_tables(spark, tables, name):
    got = corpus.QUERIES[name](spark, SF)
    if name == "op13_word_runs":
        rows = [(r.doc_id, r.text) for r in tables["documents"].select("doc_id", "text").collect()]
        assert sorted(tuple(r) for r in got.collect()) == sorted(described(i, t, True) for i, t in rows)
        return
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(corpus.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_hashes_of_blocks():
    """Equal bytes have equal hashes wherever they lie; Thue-Morse words, their complements and other lengths differ."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"xyz{word}{other}--{word}".encode(), np.uint8)
    prefix = tb.prefix_hash(data)
    start = np.array([3, 3 + 1024, 3 + 2048 + 2, 3, 3 + 2048 + 2, 3, 5])
    a, b, c, d, e, f, g = tb.block_hash(prefix, start, start + np.array([1024, 1024, 1024, 400, 400, 401, 0])).tolist()
    assert a == c and d == e and len({a, b, d, f, g}) == 5


def test_samples_of_texts_end_to_end():
    """Texts laid end to end have the samples of each text for itself."""
    sizes = suffix_dedup.Sizes(100)
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 300, 5, 36, 37, 35, 0, 1000, 120)] + [np.full(200, 120, np.uint8)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got, _ = suffix_dedup._samples(np.concatenate(texts), offs, sizes)
    want = []
    for text, at in zip(texts, offs):
        h = [tb.window_hash(tb.prefix_hash(text[p : p + sizes.anchor]), sizes.anchor)[0] for p in range(len(text) - sizes.anchor + 1)]
        least = [min(h[p : p + sizes.reach]) for p in range(len(h) - sizes.reach + 1)]
        want += [at + p for p, x in enumerate(h) if any(least[j] == x for j in range(max(0, p - sizes.reach + 1), min(p + 1, len(least))))]
    assert got.tolist() == want and len(want) > 20


def test_notes_of_one_pass():
    """Each start of a string lies under one note; a note comes twice if a text has it, or if texts share it."""
    sizes = suffix_dedup.Sizes(100)
    random.seed(3)
    text = lambda n: "".join(random.choice("abcd") for _ in range(n))
    shared = text(130)
    texts = [shared + text(90), "", text(99), text(60) + shared, "ab" * 70, "x" * 100, text(400), None]
    batch = pa.RecordBatch.from_pydict({"k1": list(range(8)), "k2": list(range(8)), "text": texts})
    rows = [r for b in suffix_dedup._notes(sizes)(iter([batch])) for r in b.to_pylist()]
    under = {(r["place"]["k1"], p) for r in rows for p in range(r["place"]["lo"], r["place"]["hi"] + 1)}
    starts = {(k, p) for k, t in enumerate(texts) for p in range(len(t or "") - sizes.length + 1)}
    assert under == starts
    often = Counter(r["note"] for r in rows)
    candidates = {(r["place"]["k1"], p) for r in rows if often[r["note"]] > 1 for p in range(r["place"]["lo"], r["place"]["hi"] + 1)}
    count = Counter(texts[k][p : p + sizes.length] for k, p in starts)
    assert {(k, p) for k, p in starts if count[texts[k][p : p + sizes.length]] > 1} <= candidates
    assert not any(k == 6 for k, _ in candidates) and {(4, 0), (5, 0)} <= candidates
