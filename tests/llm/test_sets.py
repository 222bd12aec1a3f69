"""Joins, fingerprints, rules, mixing and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from trackloom.llm import jaccard_join, line_rules, merkle, mixing, packing, url_filter

SCHEMA = "doc_id long, text string, source string, size long, target string"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, None, "clash") for i, t, s in rows], SCHEMA)


def odd_rows():
    return [(1, None, None), (2, "", "a"), (3, " \n ", "b"), (4, "word " * 30_000, "b"), (5, "one two", "a"), (5, "one two", "a"), (6, "One TWO", None), (None, "no key at all", "c"), (7, "x" * 40_000, "c")]


def near_copies(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))) for _ in range(8)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        out.append((i, " ".join(words), "s"))
    return out


def brute_classes(rows, words, percent):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_join_against_brute_force(spark, monkeypatch):
    rows = near_copies()
    # 0: all pivot rounds before the open pairs, and buckets dealt by two and three shingles
    for factor, above in ((jaccard_join.OPEN_FACTOR, jaccard_join.SPLIT_ABOVE), (0, 1)):
        monkeypatch.setattr(jaccard_join, "OPEN_FACTOR", factor)
        monkeypatch.setattr(jaccard_join, "SPLIT_ABOVE", above)
        out = jaccard_join.jaccard_join(docs_of(spark, rows), words=4, percent=85).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_classes(rows, 4, 85)


def test_unlike_texts_around_one_passage(spark, monkeypatch):
    """Every two documents share a third of their shingles; a few pairs are copies but for a word."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, passage + " " + " ".join(f"o{rng.randrange(60)}" for _ in range(44)), "s") for i in range(90)]
    rows += [(200 + i, t + " end", "s") for i, t, _ in rows[::9]]
    monkeypatch.setattr(jaccard_join, "OPEN_FACTOR", 0)
    monkeypatch.setattr(jaccard_join, "SPLIT_ABOVE", 4)
    out = jaccard_join.jaccard_join(docs_of(spark, rows), words=2, percent=40).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_classes(rows, 2, 40)


def test_jaccard_join_odd_inputs(spark):
    out = jaccard_join.jaccard_join(docs_of(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in out}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 5), (4, 1, 4), (7, 1, 7)} <= got
    assert jaccard_join.jaccard_join(docs_of(spark, [])).count() == 0
    kept = jaccard_join.drop_near_copies(docs_of(spark, odd_rows()))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 7]


def test_one_of_each_class_stays_with_null_and_repeated_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = lambda t, i: t.replace("0 ", f"0 {i} ", 1)
    rows = [(3, a, "s"), (None, near(a, 1), "s"), (None, near(a, 2), "s"), (5, near(a, 3), "s")]  # null keys beside others
    rows += [(None, b, "s"), (None, near(b, 1), "s"), (None, b.upper(), "s")]  # null keys alone
    rows += [(3, c, "s"), (2, near(c, 1), "s"), (2, near(c, 1), "s"), (2, near(c, 2), "s")]  # 3 is the least of another class, 2 occurs with two texts
    rows += [(None, None, "s"), (None, "", "s"), (9, " ", "s"), (9, "", "s")]  # without words: in no class
    for given in (rows, rows[::-1]):
        kept = [(r.doc_id, r.text) for r in jaccard_join.drop_near_copies(docs_of(spark, given)).collect()]
        assert [i for i, t in kept if t and t.startswith("a")] == [3]
        assert [i for i, t in kept if t and t.lower().startswith("b")] == [None]
        assert [i for i, t in kept if t and t.startswith("c")] == [2]
        assert sorted(map(str, ((i, t) for i, t in kept if not (t or "").strip()))) == sorted(map(str, [(None, None), (None, ""), (9, " "), (9, "")]))


def test_merkle_against_plain_code(spark):
    rows = [(1, "a b c d e f g h i j\nk l", "s"), (2, "", "s"), (3, None, "s"), (4, "  lead\n\n\ttail ", "s"), (5, "w " * 3000, "s")]
    leaves = lambda t: [hashlib.md5(p.encode()).hexdigest()[:12] for p in re.findall(merkle.PARAGRAPH, t or "")]
    out = {r.doc_id: r for r in merkle.add_fingerprint(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        assert out[i].tree.paragraphs == leaves(t) and "".join(re.findall(merkle.PARAGRAPH, t or "")) == (t or "")
    assert out[2].tree.root == out[3].tree.root != out[4].tree.root
    edited = docs_of(spark, [(1, "w " * 3000, "s")]).withColumn("other", F.concat(F.substring("text", 1, 1000), F.lit("q"), F.substring(F.col("text"), F.lit(1002), F.lit(9999))))
    both = merkle.add_fingerprint(merkle.add_fingerprint(edited).withColumnRenamed("tree", "a"), "other").withColumnRenamed("tree", "b")
    r = both.select(merkle.changed_sections(F.col("a"), F.col("b")).alias("s"), merkle.changed_paragraphs(F.col("a"), F.col("b")).alias("p"), merkle.likeness(F.col("a.paragraphs"), F.col("b.paragraphs")).alias("k")).first()
    assert r.s == [3] and len(r.p) == 1 and 0 < r.k < 1


def test_next_rows(spark):
    rows = [(i * 7 % 1000, f"t{i}", "s") for i in range(1000)] + [(None, "z", "s")]
    out = merkle.with_next(docs_of(spark, rows), "doc_id", ["text"]).collect()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert {r.text: r.next_text for r in out} == want
    assert merkle.with_next(docs_of(spark, []), "doc_id", ["text"]).count() == 0
    many = spark.range(30_000).select((F.col("id") * 7 % 30_011).alias("doc_id"), F.col("id").cast("string").alias("text"))
    out = {r.doc_id: r.next_doc_id for r in merkle.with_next(many, "doc_id", ["text"]).collect()}  # several blocks in each run
    order = sorted(out, reverse=True)
    assert len(order) == 30_000 and out == dict(zip(order, order[1:] + order[:1]))
    one = merkle.with_next(docs_of(spark, [(3, "only", "s")]), "doc_id", ["text"]).first()
    assert one.next_text == "only"


def brute_targets(sizes, weights=(5, 2, 1), top=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        left, share = total - sum(capped.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / share > top * sizes[s] + 1e-9]
        if not over:
            return capped | {s: left * w[s] / share for s in rest}
        capped |= {s: top * sizes[s] for s in over}


def test_mixing_targets_and_copies(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "c", "d", None, "é"]) if i % 3 else "a") for i in range(900)]
    rows += odd_rows()
    out = mixing.mix_plan(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
    mixed = mixing.mix_sources(docs_of(spark, rows))
    assert mixed.columns == [c.split()[0] for c in SCHEMA.split(", ")] and mixed.count() == sum(r.copies for r in out)
    assert sorted(map(str, mixing.mix_plan(docs_of(spark, rows)).collect())) == sorted(map(str, out))
    assert mixing.mix_plan(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, rows).withColumn("_source", F.lit(1)).withColumn("copies", F.lit("mine"))
    kept = mixing.mix_sources(clash)
    assert kept.columns == clash.columns and {(r.target, r.copies, r._source) for r in kept.collect()} == {("clash", "mine", 1)}


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_a_sweep_is_best_fit_within_its_range(spark):
    rng = random.Random(4)
    gaps = [(rng.randrange(1, 65), 1000 + i) for i in range(40)]
    sizes = sorted((rng.randrange(1, 65) for _ in range(80)), reverse=True)
    rows = sorted([(0, packing.GAP, -1, n, s) for n, s in gaps] + [(0, packing.PIECE, i, n, -1) for i, n in enumerate(sizes)], key=lambda r: (-r[3], -r[1]))
    out = packing._sweep(spark.createDataFrame(rows, "home long, kind int, id long, size long, sequence_id long").coalesce(1), 64).collect()
    left = sorted(g for g, _ in gaps)
    unplaced = 0
    for n in sizes:
        fit = next((g for g in left if g >= n), None)
        if fit is None:
            unplaced += 1
        else:
            left.remove(fit)
            left = sorted([*left, fit - n])
    assert sum(r.kind == packing.PIECE for r in out) == unplaced
    assert sorted(r.size for r in out if r.kind == packing.GAP) == [g for g in left if g]


def test_packing_over_many_ranges(spark):
    """Ranges of their own, pieces that no gap of their range holds, one length with a third of all rows."""
    rng = random.Random(9)
    lengths = [rng.choice([rng.randrange(1, 513), rng.randrange(1, 60), 171]) for _ in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = spark.createDataFrame([(i % 50, n) for i, n in enumerate(lengths)], "doc_id long, length long")
        out = packing.pack(pieces, max_tokens=512).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.length for r in out) == sorted(lengths)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 512
    assert len(bins) <= 1.005 * best_fit_decreasing(lengths, 512) + 1


def test_packing_ranges_follow_rows(spark, monkeypatch):
    """As many ranges as the rows need: with few rows a band takes one round, whatever the session's partitions; and many small ranges."""
    rng = random.Random(4)
    lengths = [min(512, max(1, int(rng.lognormvariate(3.5, 1)))) for _ in range(3000)]
    steps, write = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: steps.append(name) or write(df, name))
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        for rows in (packing.RANGE_ROWS, 300):
            monkeypatch.setattr(packing, "RANGE_ROWS", rows)
            steps.clear()
            out = packing.pack(pieces, max_tokens=512).collect()
            assert steps.count("swept") <= (packing.LAST_BAND + 1 if rows > 300 else 100)
            assert sorted((r.doc_id, r.length) for r in out) == sorted(enumerate(lengths))
            bins = defaultdict(list)
            for r in out:
                bins[r.sequence_id].append((r.offset, r.length))
            for parts in bins.values():
                assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 512
            assert len(bins) <= (1 if rows > 300 else 1.03) * best_fit_decreasing(lengths, 512) + 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packing_fills_without_gaps(spark):
    rng = random.Random(5)
    rows = [(i + 100, " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(0, 700))), "s") for i in range(120)] + odd_rows()
    pieces = packing.token_pieces(docs_of(spark, rows), TOKENS, keep_ids=True, max_tokens=512).cache()
    packed = packing.pack(pieces, max_tokens=512)
    out = packed.collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    by_doc = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= 512 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
    copies = Counter((i, t) for i, t, _ in rows)
    for (i, t), n in copies.items():
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert len({(r.sequence_id, r.offset) for r in parts}) == len(parts)  # repeated rows each have a place
        got = [x for r in parts[:: n if len(parts) == n else 1] for x in r.ids]
        assert got == tok.encode(t or "", add_special_tokens=False).ids + [1]
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= best_fit_decreasing([r.length for r in out], 512) + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert all(len(whole[s]) == sum(n for _, n in parts) for s, parts in bins.items())
    assert packing.pack_documents(docs_of(spark, []), TOKENS).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme casino", "http://A.Example.com/en/x?q", "https://www.example.com/en/", "http://b.net/fr/1", "http://b.org/free-pills", "http://b.org/free", "http://freeware.org/winter", "http://x.casino.org#a", "http://b.com"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert out[0] == ("", "", None, "allow") and out[2] == ("", "", None, "block") and out[3] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert out[4][2:] == ("www.example.com/en/", "allow") and out[5][2:] == ("net/fr/", "block") and out[6][3] == "block" and out[7][3] == "allow" and out[8][3] == "allow" and out[9][3] == "block" and out[10][2:] == (None, "allow")
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_line_rules_against_plain_code(spark):
    rng = random.Random(6)
    common = "All rights reserved by the house 12."
    rows = []
    for i in range(150):
        lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), common.replace("12", str(i)))
        rows.append((i, "\n".join(lines + lines[:1] * (i % 2)), "s" if i % 5 else None))
    rows += odd_rows()
    out = line_rules.quality_rules(docs_of(spark, rows), min_docs=10).collect()
    assert len(out) == len(rows)
    norm = lambda x: re.sub("[0-9]", "0", " ".join(x.lower().split()))
    have = defaultdict(set)
    for i, t, s in rows:
        if t is not None:
            for line in t.split("\n"):
                if line.split():
                    have[s, norm(line)].add((i, t))
    gone = {k for k, v in have.items() if len(v) >= 10}
    assert any("all rights" in k[1] for k in gone)
    want = {}
    for i, t, s in rows:
        words, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.split()]
        tri = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
        want[i, t] = (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(hit), sum(len(x.split()) for x in lines if (s, norm(x)) in gone))
    keyed = {(r.doc_id, r.n_words): (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.words_removed) for r in out}
    for (i, t), w in want.items():
        assert keyed[i, w[0]] == w
    assert line_rules.quality_rules(docs_of(spark, [])).count() == 0


def test_a_document_of_mostly_frequent_lines_is_depleted(spark):
    words = lambda x, n: " ".join(f"{x}w{k}" for k in range(n))
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(30)]  # digits of a line count as 0
    rows = [(i, words("foot", 60) + "\n" + words(x, 10 if i < 25 else 200), "s") for i, x in enumerate(letters)]
    out = {r.doc_id: r for r in line_rules.quality_rules(docs_of(spark, rows)).collect()}
    assert all(r.words_removed == 60 and r.n_words >= line_rules.MIN_WORDS and not r.base_failed for r in out.values())
    assert [i for i in sorted(out) if out[i].kept] == list(range(25, 30))


def test_copies_of_a_page_count_each_and_repeated_rows_do_not(spark):
    page = " ".join(f"word{k}" for k in range(80)).translate(str.maketrans("0123456789", "abcdefghij"))
    copies = [(i, page, "s") for i in range(20)]
    assert not any(r.kept for r in line_rules.quality_rules(docs_of(spark, copies)).collect())
    fewer = copies[:19] + [copies[0]] * 5 + [(99, page, "t")]  # 19 documents of the host, one of them six times
    out = line_rules.quality_rules(docs_of(spark, fewer)).collect()
    assert len(out) == 25 and all(r.kept and r.words_removed == 0 for r in out)


def test_the_limit_does_not_grow_with_the_host(spark):
    words = lambda x, n: " ".join(f"{x}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))
    rows = [(i, words(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}", 60), "s") for i in range(600)]
    rows += [(1000 + i, "the same footer for all of these pages here\n" + words(f"v{chr(97 + i)}", 60), "s") for i in range(20)]
    out = line_rules.quality_rules(docs_of(spark, rows)).collect()
    assert {r.doc_id for r in out if r.words_removed} == set(range(1000, 1020)) and all(r.kept for r in out)


def test_stripped_texts_are_what_the_line_rule_leaves(spark):
    rows = [(i, f"head line\n\nown text of page {chr(97 + i)}\nHEAD   line", "s") for i in range(20)] + [(50, "head line", "t"), (51, None, "s"), (51, None, "s"), (52, "head  line", "s")]
    docs = docs_of(spark, rows)
    frequent = line_rules.frequent_lines(docs)
    left = {r.doc_id: r.text for r in line_rules.strip_frequent_lines(docs, frequent).collect()}
    assert left[3] == "\nown text of page d" and left[50] == "head line" and left[51] == "" and left[52] == ""


def test_a_vocabulary_table_of_many_overlapping_terms(spark):
    rng = random.Random(9)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))): rng.choice([0.5, 1.0, 1.5]) for _ in range(4000)}
    strict = set(rng.sample(sorted(terms), 200))
    table = spark.createDataFrame([(t.upper() if len(t) % 2 else t, w, t in strict) for t, w in terms.items()] + [(None, 9.0, True), ("", 9.0, True)], "term string, weight double, strict boolean")
    urls = ["http://h.org/" + "".join(rng.choice("abcABC-/.") for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules=(), terms=table, soft_limit=3.0).collect()}
    for i, u in enumerate(urls):
        words = {w for w in re.split("[^0-9a-z]+", u.lower()) if w in terms}
        want = sum(3.0 if w in strict else terms[w] for w in words) >= 3.0
        assert got[i] == ("block" if want else "allow"), u
    assert 20 < sum(v == "block" for v in got.values()) < 480
