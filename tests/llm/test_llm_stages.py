"""The stages of the pipeline and the line counts, on cases where a cut would show."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
from corpusloom.llm import minhash, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def brute_force(texts):
    """The least id of each text's component under pairs of similarity 0.8 and more."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items()}
    for a, b in combinations(sorted(texts), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(8), {}
    for k in range(25):
        base = prose(rng, rng.randint(40, 300))
        texts[10 * k] = " ".join(base)
        for c in range(1, 6):  # copies around similarity 0.8, on both sides of it
            words = list(base)
            for at in rng.sample(range(len(words)), max(1, len(words) * c // 120)):
                words[at] = prose(rng, 1)[0]
            texts[10 * k + c] = " ".join(words)
    passage = prose(rng, 60)
    texts |= {1000 + k: " ".join(passage + prose(rng, 40)) for k in range(30)}  # a shared passage, no near copies
    want = brute_force(texts)
    for chunk, pivots in ((minhash.CHUNK, minhash.PIVOTS), (3, 0)):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts.items()), chunk, pivots).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts.items()), "").collect()}
    assert kept == {i for i, r in want.items() if i == r} and len(kept) < len(texts)


NOTICE = " ".join(f"{w} cookies" for w in "this page and all of its partners store read keep share sell combine compare measure list sort".split())


def test_shared_longest_line_counts_each_document(spark):
    rng = random.Random(4)
    rows = [(i, f"{NOTICE}\n{' '.join(prose(rng, 4))}") for i in range(60)]  # depleted: a long shared line, a short own one
    rows += [(1000 + i, "\n".join([NOTICE, " ".join(prose(rng, 40))])) for i in range(5)]
    copied = " ".join(prose(rng, 40))
    rows += [(2000 + i, copied) for i in range(90)]
    out = {r.doc_id: r for r in quality.op9(frame(spark, rows)).collect()}
    assert all(not out[i].base_failed and not out[i].kept and out[i].left_words == 4 for i in range(60))
    assert all(out[1000 + i].kept and out[1000 + i].left_words == 40 for i in range(5))
    assert all(out[2000 + i].kept and out[2000 + i].left_words == 40 for i in range(90))


def test_lines_of_failing_documents_count(spark):
    rng = random.Random(5)
    line = "Subscribe to our letter"
    rows = [(i, f"{line}\n{' '.join(prose(rng, 40))}") for i in range(40)]
    rows += [(1000 + i, f"{line}\n{' '.join(prose(rng, 3))}") for i in range(20)]  # under ten words
    rows += [(2000 + i, f"Only on forty pages\n{' '.join(prose(rng, 40))}") for i in range(40)]
    out = {r.doc_id: r for r in quality.op9(frame(spark, rows)).collect()}
    assert all(out[i].kept and out[i].left_words == 40 for i in range(40))
    assert all(out[1000 + i].base_failed and not out[1000 + i].kept for i in range(20))
    assert all(out[2000 + i].kept and out[2000 + i].left_words == 44 for i in range(40))


def test_lines_above_the_limit_leave_the_texts(spark):
    """A document that is kept loses the notice that stands on more pages of its host than the limit; other hosts, blank and rare lines stay."""
    rng = random.Random(12)
    notice = "All rights reserved 2024 by nobody."
    own = {i: "\n".join([" ".join(prose(rng, 40)), "", notice.replace("2024", str(2000 + i)) + "  ", " ".join(prose(rng, 30))]) for i in range(60)}
    rows = [(i, t, "en", "s", len(t)) for i, t in own.items()] + [(100, own[0], "en", "t", 1), (101, "rare line here\n" + own[1], "en", "s", 7)] + [(200 + i, notice + f"\nword {'abcdefghij'[i % 10]}{i}", "en", "s", 1) for i in range(5)]
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert set(got) == {*own, 100, 101}
    for i, t in own.items():
        a, b, _, c = t.split("\n")
        assert (got[i].text, got[i].n_chars) == ("\n".join([a, b, c]), len(a) + len(b) + len(c) + 2)
    assert (got[100].text, got[100].n_chars) == (own[0], 1)
    assert got[101].text.startswith("rare line here\n") and "reserved" not in got[101].text


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(6)
    short = " ".join(rng.choice("abcdefghijklmnop") for _ in range(51))  # 101 bytes
    passages = [" ".join(prose(rng, 51)), " ".join(prose(rng, 60)), short]
    spare = " ".join(prose(rng, 48))  # too few words
    own = [[" ".join(prose(rng, 80)) for _ in range(2)] for _ in range(8)]
    glue = ["", "("]  # the edges of a passage may stand beside other characters
    rows = [(i, f"{own[i][0]} {glue[i % 2]}{[*passages, spare][i // 2]}{')' * (i % 2)} {own[i][1]}") for i in range(8)]
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, frame(spark, rows), "").collect()}
    for i, text in rows:
        if i < 6:
            words = passages[i // 2].split()
            edges = [glue[i % 2] + words[0], words[-1] + ")" * (i % 2)]
            assert out[i].text.split() == [*own[i][0].split(), *edges, *own[i][1].split()] and out[i].n_chars == len(out[i].text)
        else:
            assert out[i].text == text


def test_passages_of_the_corpus(spark):
    """Whole table: no window of 49 words that stood twice is left, and texts without one are untouched."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = Counter(tuple(t.split()[s : s + 49]) for t in texts.values() for s in range(len(t.split()) - 48))
    for d, t in texts.items():
        w, gone = t.split(), set()
        for s in range(len(w) - 48):
            if count[tuple(w[s : s + 49])] > 1:
                gone |= set(range(s, s + 49))
        assert out[d].split() == [x for i, x in enumerate(w) if i not in gone]
        assert gone or out[d] == t


def test_repeated_and_null_id_rows_stay_once(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(prose(rng, 120)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[3]), (2, texts[4])]
    rows += [(None, "too short")]
    docs = frame(spark, [(i, t) for i, t in rows])
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert {r.text for r in docs.collect()} == set(texts), name
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == sorted([(1, texts[0]), (0, texts[1]), (0, texts[2]), (2, texts[3]), (2, texts[4])])
