"""Run detection, SimHash tiles and spelling variants against brute force, the registered queries too."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trackloom.llm import common, queries, run_detection, simhash_tiles, spelling_trie

SCHEMA = "doc_id long, text string, source string, size long, starts string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, "clash") for i, t in rows], SCHEMA)


def odd_rows():
    return [(1, None), (2, ""), (3, " \n "), (4, "word " * 30_000), (5, "one two"), (5, "one two"), (6, "One TWO"), (None, "no key at all"), (7, "x" * 40_000), (8, "a b  c")]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- runs


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            a, z = i, j + q
            if z - a >= max(6, 4 * q) and not any(p < q and b <= a and y >= z for b, y, p in found):
                found.append((a, z, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_texts(seed, cases):
    rng = random.Random(seed)
    for _ in range(cases):
        k = rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.choice([0, 1, 5, 8, 20, 60]))]
        for _ in range(rng.randint(0, 3)):
            p = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(w))
            w[at:at] = (p * rng.randint(1, 9))[: rng.randint(1, 40)]
        yield w


def test_runs_against_brute_force():
    texts = list(periodic_texts(1, 900))
    for at in range(0, len(texts), 3):  # several texts at once: no run may cross from one to the next
        part = texts[at : at + 3]
        ids, doc = np.array([x for w in part for x in w], np.int64), np.repeat(np.arange(3), [len(w) for w in part])
        begin = np.concatenate([[0], np.cumsum([len(w) for w in part])])
        want = [(a + int(s), z + int(s), q) for s, w in zip(begin, part) for a, z, q in brute_runs(w)]
        assert list(zip(*[x.tolist() for x in run_detection.find_runs(ids, doc)])) == want


def test_runs_where_hashes_deceive(monkeypatch):
    """Thue-Morse words have equal polynomial hashes without being equal; a reach that is far too long is found out as well."""
    tm = np.array([bin(i).count("1") % 2 for i in range(1 << 13)], np.int64)
    assert len(run_detection.find_runs(tm, np.zeros(len(tm), np.int64))[0]) == 0  # it has no cubes
    monkeypatch.setattr(run_detection, "_reach", lambda ids, i, q, lo, hi: (lo.copy(), hi.copy()))
    for w in periodic_texts(2, 150):
        found = run_detection.find_runs(np.array(w, np.int64), np.zeros(len(w), np.int64))
        assert list(zip(*[x.tolist() for x in found])) == brute_runs(w)


def test_grammar_derives_every_place():
    """Each symbol's two parts spell the same words at all its places, and rules of Re-Pair are used twice at least."""
    w = np.array([0, 1, 2, 0, 1, 2, 0, 1, 3, 0, 1, 2, 2, 2, 2, 2, 2], np.int64)
    g = run_detection.Grammar(w, np.zeros(len(w), np.int64))
    for rule in range(len(g.lo)):
        places = g.at[g.rule == rule]
        size = g.hi[rule] - g.lo[rule]
        assert g.lo[rule] < g.mid[rule] < g.hi[rule]
        assert {tuple(w[p : p + size]) for p in places} == {tuple(w[g.lo[rule] : g.hi[rule]])}
    assert np.bincount(g.rule).max() >= 2


def test_long_texts_of_few_words():
    for w, n in (([0] * 60_000, 1), ([i % 7 for i in range(60_000)], 1), ([0] * 30_000 + [1] * 30_000, 2)):
        assert len(run_detection.find_runs(np.array(w), np.zeros(len(w), np.int64))[0]) == n


def test_collapse_runs_odd_inputs(spark):
    rows = [*odd_rows(), (9, "a b a b a b a b c"), (10, "x x x x x x y y y y y y")]
    out = run_detection.collapse_runs(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    of = {r.doc_id: r for r in out}
    assert (of[1].n_words, of[1].n_runs, of[1].worst, of[1].collapsed) == (0, 0, None, "")
    assert (of[4].n_runs, tuple(of[4].worst), of[4].collapsed) == (1, (0, 30_000, 1), "word")
    assert (of[9].n_runs, tuple(of[9].worst), of[9].collapsed) == (1, (0, 8, 2), "a b c")
    assert (of[10].n_runs, tuple(of[10].worst), of[10].collapsed) == (2, (0, 6, 1), "x y")  # a tie: the first
    assert of[None].n_words == 4 and of[8].n_words == 2
    assert run_detection.collapse_runs(docs_of(spark, [])).count() == 0


def test_op11_query(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op11_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    periodic = 0
    for doc_id, text in docs:
        w = words_of(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 1200:
            continue
        runs = brute_runs(w)
        gone = {i for a, z, q in runs for i in range(a + q, z)}
        best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
        periodic += bool(runs)
        r = got[doc_id]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{z - a},{q}\n" for a, z, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert periodic > 5


# ---- fingerprints


def brute_print(text):
    w = words_of((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(grams))


def brute_components(prints, radius=2):
    """(key, fingerprint) rows to the least key that each reaches."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (k, _) in enumerate(prints):
        groups[top(i)].append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    return [least[top(i)] for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_xxh64_by_majority(spark):
    texts = ["A b C d e f", "a", "One two", "", None, "é É ß words", "tie x y tie x y", "long " * 5000]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", simhash_tiles.simhash(F.col("t")).alias("f")).collect()
    assert {r.i: r.f for r in out} == {i: signed(brute_print(t)) for i, t in enumerate(texts)}
    # Spark's own hash of the only shingle of a text
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] == signed(brute_print("One two THREE"))


@pytest.mark.parametrize("tile", [4, 512])
def test_links_against_brute_force(spark, monkeypatch, tile):
    """Chains and clusters of fingerprints, with the top bit set too; small tiles cut hot populations."""
    monkeypatch.setattr(simhash_tiles, "TILE", tile)
    rng = random.Random(tile)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 4)):
                x ^= 1 << b
    prints = sorted(prints)
    found = simhash_tiles.simhash_links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")).collect()
    assert all(bin((r.a ^ r.b) & ((1 << 64) - 1)).count("1") <= 2 for r in found)
    up = {signed(p): signed(p) for p in prints}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in found:
        up[top(r.a)] = top(r.b)
    want = brute_components(list(enumerate(prints)))
    classes, mine = defaultdict(set), defaultdict(set)
    for p, w in zip(prints, want):
        classes[w].add(signed(p))
        mine[top(signed(p))].add(signed(p))
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))
    assert max(map(len, classes.values())) > 3


def test_forest_connects_what_links_connect():
    x, y = np.array([0, 1, 2, 2, 3, 0, 5]), np.array([10, 10, 10, 11, 11, 11, 5 + 7])
    _, node = np.unique(np.concatenate([x, y]), return_inverse=True)
    kept = simhash_tiles._forest(node[:7], node[7:])
    assert len(kept) == 6  # eight nodes in two components: seven links, of which one closes a circle


def test_simhash_join_odd_inputs(spark):
    rows = [*odd_rows(), (None, "no key at all"), (12, "no key at all"), (None, "another one without key")]
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_tiles.simhash_join(docs_of(spark, rows)).collect()]
    prints = [(i, brute_print(t)) for i, t in rows]
    want = [(i, signed(p), c) for (i, p), c in zip(prints, brute_components(prints))]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert simhash_tiles.simhash_join(docs_of(spark, [])).count() == 0


def test_op12_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    want = {i: (format(p, "016x"), c) for (i, p), c in zip(prints, brute_components(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op12_simhash"](spark, sf).collect()} == want


# ---- spelling


def brute_near(words):
    near, wild = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            d = w[:i] + w[i + 1 :]
            if d in words:
                near[w].add(d)
                near[d].add(w)
            wild[i, d].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_forms(n, ratio=10):
    near, form = brute_near(n), {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n}


def variants(spark, n):
    out = spelling_trie.spelling_variants(spark.createDataFrame([(w, k, "clash") for w, k in n.items()], "word string, n long, root string")).collect()
    assert len(out) == len({r.word for r in out})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in out}


def test_variants_against_brute_force(spark):
    """Words over few letters, so that tries fork everywhere; prefixes of one another; repeated letters; accents; a letter beyond the plane."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(500)}
    words |= {"a" * k for k in range(6, 30)} | {"straße" + x for x in ("", "n", "nx", "\U0001d400", "\U0001d400n")} | {"überall", "uberall", "berall", "überal"}
    assert len(words) > 400
    n = {w: rng.choice([2, 2, 3, 25, 300, 5000]) for w in words}
    got = variants(spark, n)
    assert got == brute_forms(n)
    assert any(r[4] != r[2] for r in got.values() if r[2])  # a chain of forms


def test_long_words_meet_by_blocks(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abc") for _ in range(k)) for k in (63, 64, 65, 66, 200, 4000)]
    words = set(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "e" + w[i + 1 :]}
        words |= {w[1:], w[:-1], w + "f", "g" + w}
    n = {w: rng.choice([2, 30, 500]) for w in words}
    assert variants(spark, n) == brute_forms(n)


def test_variants_odd_inputs(spark):
    frame = spark.createDataFrame([(None, 5), ("", 5), ("short", 100), ("longenough", 2), ("longenough", 3)], "word string, n long")
    assert [tuple(r) for r in spelling_trie.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()] == [("longenough", 5, 0, None, None, "longenough")]
    assert spelling_trie.spelling_variants(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling_trie.spelling_variants(frame, ratio=1)


def test_op13_query(spark, sf):
    n = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    want = brute_forms({w: k for w, k in n.items() if k >= 2})
    got = queries.QUERIES["op13_spelling"](spark, sf).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    assert sum(1 for v in want.values() if v[2]) > 3


def test_materialize_leaves_no_shuffle_files(spark):
    """What op13_spelling and others write between their steps stays whole; the shuffles behind it do not pile up on the disks."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: set(re.findall(r"shuffle_(\d+)_", disk.getAllBlocks().mkString(" ")))
    before = shuffles()
    made = common.materialize(spark.range(50_000).groupBy((F.col("id") % 997).alias("k")).agg(F.max("id").alias("m")), "made")
    for _ in range(40):
        if not shuffles() - before:
            break
        time.sleep(0.25)
    assert not shuffles() - before
    assert made.count() == 997 and made.agg(F.max("m")).first()[0] == 49_999
    assert spark.conf.get(common._CLEAN_UP, None) is None
