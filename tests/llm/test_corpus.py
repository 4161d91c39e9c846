"""Operators that compare texts with each other, and the pipeline, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paddock.llm import near_dedup, suffix_dedup
from paddock.llm.components import components
from paddock.scratch import Scratch
from tests.llm.conftest import ODD, SF, documents
from tests.llm.test_texts import LOWER, WORD, shingles


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)]
    with Scratch(spark, "test") as tmp:
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), tmp).collect()}
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert got == roots(edges, ends)


def linked(rows, n):
    """Component of every document by comparing all pairs."""
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = shingles(t, n) if len(words) >= n else {tuple(words)} if words else set()
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in roots(edges, ids).items()}


def families(seed):
    random.seed(seed)
    rows = []
    for f in range(12):
        base = [random.choice("abcdefghijklmnopqrstuvwxyz") + str(random.randrange(900)) for _ in range(random.choice([3, 8, 60, 150]))]
        for _ in range(random.choice([1, 2, 10, 25])):
            words = list(base)
            for _ in range(random.randrange(0, max(2, len(base) // 8))):
                words[random.randrange(len(words))] = f"e{random.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rows = families(words)
    got = near_dedup.near_duplicates(documents(spark, rows, clashing=True), words).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_the_tables(spark, tables):
    rows = [(r.doc_id, r.text) for r in tables["documents"].collect()]
    got = near_dedup.near_duplicates(tables["documents"]).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, 2)


def test_near_duplicates_on_odd_rows(spark, odd, nothing):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert len(got) == len(ODD) and all(k for *_, k in got)
    assert [g for g in got if g[0] in (-1, 0, 1, 2)] == [(-1, 5, None, True), (0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True)]
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.one_of_each(odd).count() == len(ODD) - 1  # the repeated row goes


def test_rows_of_one_id_are_judged_for_themselves(spark):
    a, b, c, d = ("".join(f"{x}{k} " for k in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (4, d.upper() + " more"), (5, c)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, rows), 5).collect()}
    assert got == {(1, 36, 1, True), (2, 36, 1, False), (2, 36, 2, True), (3, 36, 3, True), (4, 37, 3, False), (5, 36, 3, False)}
    kept = near_dedup.one_of_each(documents(spark, rows, clashing=True)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (2, b), (3, c), (3, d)]


def removed(rows, length):
    """Result of every row by counting all strings of ``length`` bytes."""
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(b[p : p + length] for b in texts for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if often[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def check_removed(spark, rows, length, **more):
    got = suffix_dedup.repeated_bytes(documents(spark, rows, **more), length).collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed(rows, length)


@pytest.mark.parametrize("length", [100, 400])
def test_repeated_strings(spark, length):
    random.seed(length)
    text = lambda n: "".join(random.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (length - 1, length, length + 1, 2 * length, 3 * length + 7)]
    rows = [(k, text(random.randrange(3 * length)) + random.choice(shared) + text(random.randrange(length)) + random.choice(shared)) for k in range(60)]
    base = text(6 * length)
    for k in range(60, 100):  # a family of edited and cut copies
        copy = list(base[random.randrange(length) : random.randrange(4 * length, 6 * length)])
        for _ in range(random.randrange(4)):
            copy[random.randrange(len(copy))] = "X"
        rows.append((k, "".join(copy)))
    rows += [(200, "ab" * (2 * length)), (201, "x" * (length + 1)), (202, "x" * length), (203, base), (203, base), (None, base)]
    check_removed(spark, rows, length, clashing=True)


def test_overlapping_quotes_of_one_text(spark):
    """Quotes whose only partner lies inside a gap between repeated samples."""
    random.seed(9)
    text = lambda n: "".join(random.choice("abcdefgh \n") for _ in range(n))
    rows = []
    for _ in range(25):
        base = text(2500)
        rows.append((len(rows), base))
        for _ in range(14):
            at = random.randrange(1950)
            rows.append((len(rows), text(30) + base[at : at + random.randrange(400, 521)] + text(30)))
    check_removed(spark, rows, 400)


def test_long_regular_strings_differ(spark):
    """Thue-Morse words and their complements, which hash alike modulo 2**64, are no copies of each other."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"first {word} end"), (2, f"second {other} stop"), (3, f"x {word + other} y"), (4, f"z {other} y")]
    check_removed(spark, rows, 1024)


def test_repeated_strings_on_odd_rows(spark, odd, nothing):
    check_removed(spark, ODD, 400)
    assert suffix_dedup.repeated_bytes(nothing).count() == 0
    kept = suffix_dedup.without_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted((len(r.text) if r.text is not None else -1) for r in kept.where("doc_id IN (0, 4, 6)").collect()) == [-1, 0, 0, len(ODD[8][1])]


def test_pipeline_stages(spark, tables):
    """Every stage against its operator's own result on the stage's input."""
    docs = tables["documents"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        before = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = {r.doc_id: r.text for r in after.collect()}
        assert set(kept[name]) <= set(before)
        if name == "near_duplicates":
            groups = linked(list(before.items()), 5)
            assert set(kept[name]) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "repeated_strings":
            expected = {r[0]: r[1] - r[2] for r in removed(list(before.items()), 200)}
            assert all(0 <= expected[i] - len(t.encode()) < 4 * 50 for i, t in kept[name].items()) and set(kept[name]) == set(before)
        elif name == "decontaminate":
            items = [shingles(r.text, 5) for r in tables["benchmark"].collect()]
            bad = {i for i, t in before.items() if any(s and 100 * len(s & shingles(t, 5)) >= 80 * len(s) for s in items)}
            assert set(kept[name]) == set(before) - bad
        docs = after
    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == set(kept["decontaminate"]) and all(r.decodes for r in rows)


def test_last_stage_gives_the_ids(spark, tables):
    rows = corpus_pipeline.STAGES[4][1](spark, tables["documents"].limit(20), SF).collect()
    assert rows and all(len(r.ids) == r.n_pieces and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32 for r in rows)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_a_row_is_kept_if_its_id_is_its_components(spark):
    rows = [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l m"), (2, "a b c d e f g h i j k l"), (None, "x y")]
    got = sorted(((r.doc_id or 0), r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, rows), words=2).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_short_passages_that_repeat(spark):
    """The pipeline's stage removes shared passages of over 50 short words, and nothing else."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 5)))
    own = lambda n: " ".join(word() for _ in range(n))
    passages = [own(rng.randint(51, 80)) for _ in range(8)]
    rows = [(k, f"{own(40)} {passages[k % 8]} {own(40)}" if k < 24 else own(120)) for k in range(40)]
    docs = documents(spark, rows).withColumns({"_starts": F.lit(1), "_k1": F.lit(2), "_k2": F.lit(3)})
    got = corpus_pipeline.repeated_strings(spark, docs, SF)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    for k, text in rows:
        if k < 24:
            # A neighbouring character may agree by chance.
            assert len(text) - len(texts[k]) - len(passages[k % 8]) in range(0, 9)
        else:
            assert texts[k] == text
