"""Classifiers, the lattice and personal data: held-out accuracy, brute force, and odd inputs."""

import itertools
import math
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackloom.llm import lattice_lm, pii_crf, quality_mil, toxicity
from trackloom.llm.chars import Chars

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 50_000), (5, "a b " * 20_000), (5, "a b " * 20_000), (None, "no key"), (7, "\U0001f600 ß İ")]


def odd(spark):
    rows = [(i, t, "en", None, None, "clash", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, held_out string, score double")


def test_toxicity_scores_many_texts_in_little_memory():
    model = toxicity.ToxicityModel(0.5, np.linspace(-1, 1, 1 << toxicity.BUCKET_BITS, dtype=np.float32))
    texts = [f"words of text {i} " * 160 for i in range(600)]
    tracemalloc.start()
    found = model.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert found[::97].tolist() == [model.score([t])[0] for t in texts[::97]]


def test_words_match_a_plain_split():
    texts = ["", "  a\tb\n", "éa  x\x0by", "\x1cq z"]
    c = Chars(texts)
    assert c.n_words.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    h = Chars(["same word", "word same"]).word_hashes()
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


@pytest.mark.parametrize("module, good, bad", [(quality_mil, "The quiet river runs by the old mill, and so on. ", "BUY!! NOW!! ### $$$ "), (toxicity, "The quiet river runs by the old mill. ", "The quiet river runs by you stupid idiot. ")])
def test_classifiers_learn(module, good, bad):
    rng = np.random.default_rng(1)
    texts = [(good if i % 2 else bad) * int(rng.integers(1, 9)) for i in range(240)]
    labels = np.array([i % 2 for i in range(240)] if module is quality_mil else [1 - i % 2 for i in range(240)])
    model = module.train(texts[:160], labels[:160], 0.5)
    assert (((model.score(texts[160:]) > 0.5) == labels[160:]).mean()) > 0.95
    assert all(0 <= s <= 1 for s in model.score(["", "word", "x" * 10_000]))


def test_unseen_misspellings_are_near():
    texts = ["you are a stupid man here today", "you are a clever man here today"] * 100
    model = toxicity.train(texts, np.array([1, 0] * 100), 0.5)
    seen, misspelt, clean = model.score(["he is stupid now", "he is stupidd now", "he is clever now"])
    assert misspelt > clean and seen > clean


def test_without_labels_the_prior_is_the_score(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for fit, score, name in ((quality_mil.fit_quality, quality_mil.score_quality, "quality_score"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic_score")):
        out = score(docs, fit(docs, none)).collect()
        assert len(out) == len(ODD) and {r[name] for r in out} == {0.5}
        assert score(docs.limit(0), fit(docs, none)).count() == 0


def test_odd_inputs_get_scores(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (4, 1, 0), (4, 1, None), (5, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for fit, score, name in ((quality_mil.fit_quality, quality_mil.score_quality, "quality_score"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic_score")):
        out = score(docs, fit(docs, labels)).collect()
        assert len(out) == len(ODD) and all(0 <= r[name] <= 1 for r in out)
        same = [r[name] for r in out if r.doc_id == 5]
        assert same[0] == same[1]


PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.load_pieces(PATH)
    prob = lattice_lm.first_probabilities(pieces)
    lattice = lattice_lm.Lattice(pieces)
    number = {p: i for i, p in enumerate(pieces) if p}
    for word in ("the", "ansible", "a"):
        w, total = lattice_lm.MARK + word, 0.0
        for cuts in itertools.product((False, True), repeat=len(w) - 1):
            parts, lo = [], 0
            for i, cut in enumerate(cuts, 1):
                if cut:
                    parts.append(w[lo:i])
                    lo = i
            parts.append(w[lo:])
            if all(p in number for p in parts):
                total += math.exp(sum(prob[number[p]] for p in parts))
        assert lattice.forward([word], prob)[0] == pytest.approx(math.log(total), abs=1e-9)
    assert np.isfinite(lattice.forward(["\U0001f600", "x" * 5000], prob)).all()


def test_lattice_scores_against_plain_counts(spark):
    docs = odd(spark).withColumn("learn", F.coalesce(F.col("doc_id") < 6, F.lit(False)))
    out = lattice_lm.lattice_scores(docs, PATH).collect()
    assert len(out) == len(ODD)
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in ODD}
    learned = [w for i, t in ODD if i is not None and i < 6 for w in (t or "").encode().lower().split() + [b""]]
    n, kinds = len(learned), len(set(learned))
    for r in out:
        words = tokens[r.doc_id]
        known = set(learned)
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words), n, sum(w in known for w in words))
        if len(words) < 50:
            assert r.base_score == pytest.approx(sum(math.log10((learned.count(w) + 1) / (n + kinds + 1)) for w in words), abs=1e-9)
        assert r.score < 0
    empty = lattice_lm.lattice_scores(docs.limit(0), PATH)
    assert empty.count() == 0


@pytest.fixture(scope="module")
def crf():
    return pii_crf.train(pii_crf.labelled_table(600), epochs=80)


def test_patterns():
    text = "a.b@mail.example.com, 10.0.0.1 and 300.1.1.1; 4111 1111 1111 1111 or 4111111111111112; +1 (689) 555-4072."
    found = [(pii_crf.KINDS[k], text[s:e]) for s, k, e in pii_crf.pattern_spans(text)]
    assert found == [("email", "a.b@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (689) 555-4072")]


def test_crf_adds_what_patterns_miss_and_leaves_clean_text(crf):
    missed = ["write to jane at mail dot example dot com now", "call 689-555-4072 now"]
    for (base, every), _ in zip(pii_crf.find_spans(missed, crf), missed):
        assert not base and len(every) == 1
    assert pii_crf.find_spans(["At the mill, 12 of 300 were here at 10:30.", ""], crf) == [([], []), ([], [])]


NEIGHBOURS = [
    ("call 689-555-4072, 689-555-4073 now", ["689-555-4072", "689-555-4073"]),
    ("call (689) 555-4072 (689) 555-4073 (212) 555-1234 now", ["(689) 555-4072", "(689) 555-4073", "(212) 555-1234"]),
    ("tel 0012 345 678901, 0034 567 890123", ["0012 345 678901", "0034 567 890123"]),
    ("call 689-555-4072,689-555-4073 now", ["689-555-4072", "689-555-4073"]),
    ("card 4111 1111 1111 1111 5500 0055 5555 5559 here", ["4111 1111 1111 1111", "5500 0055 5555 5559"]),
    ("visa 4111.1111.1111.1111 5500.0055.5555.5559 here", ["4111.1111.1111.1111", "5500.0055.5555.5559"]),
    ("mail jane at mail dot com, tom at web dot org now", ["jane at mail dot com", "tom at web dot org"]),
    ("write to jane at mail dot example dot com tom@web.org now", ["jane at mail dot example dot com", "tom@web.org"]),
    ("write to tom@web.org jane at mail dot example dot com now", ["tom@web.org", "jane at mail dot example dot com"]),
]


@pytest.mark.parametrize("text, want", NEIGHBOURS)
def test_neighbours_of_one_kind_are_all_found(crf, text, want):
    ((base, every),) = pii_crf.find_spans([text], crf)
    assert [text[s:e] for s, _, e in every] == want and set(base) <= set(every)
    assert not any(w in pii_crf.redact(text, every) for w in want)


def test_runs_that_are_no_list_give_no_spans(crf):
    clean = ["on 2021-04-03, 2021-04-04, 2021-04-05 here", "in 1998 2021 4050 3333 2222 1111 4040 3030 of", "12, 34, 56, 7890 and 1998, 1999, 2000, 2001, 2002"]
    assert pii_crf.find_spans(clean, crf) == [([], [])] * 3


def test_the_labelled_table_has_neighbours():
    def kinds(row):
        return [k for k in (y for _, y in row) if k]

    rows = pii_crf.labelled_table(300)
    assert sum(len(kinds(r)) > 8 and len(set(kinds(r))) == 1 for r in rows) > 10


def test_pruned_viterbi_equals_the_full_one(crf):
    texts = [" ".join(w for w, _ in row) for row in pii_crf.labelled_table(80, seed=3)]
    c, y = crf.labels(texts)
    line = pii_crf._lines(c)
    full = pii_crf.viterbi(crf.emissions(pii_crf.word_shapes(c), line), line, crf.step, crf.start)
    assert (y == full).all() and (y > 0).any()


def test_spans_and_redaction(spark, crf):
    docs = odd(spark).unionByName(spark.createDataFrame([(8, "x a@b.co y", "en", None, None, "", 0.0)], odd(spark).schema))
    out = docs.select("doc_id", pii_crf.pii_spans(F.col("text"), crf).alias("f")).collect()
    assert len(out) == len(ODD) + 1 and [r.f.spans for r in out if r.doc_id == 8] == ["email:2:8"]
    clean = {r.doc_id: r.text for r in pii_crf.redact_documents(docs, crf).collect()}
    assert clean[8] == "x [EMAIL] y" and clean[1] is None and clean[2] == ""
