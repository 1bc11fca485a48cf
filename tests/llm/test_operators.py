"""The operators against plain versions, and in every odd case."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchlog.llm import automaton, components, decontaminate, minhash, neighbours, packing, passages, quality, suffixes, textops, toxicity, urls, warc
from batchlog.llm.queries import URL_RULES

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, a periodic, a long, empty and white ones."""
    rng = random.Random(seed)
    shared = [words(rng, 70), words(rng, 30), words(rng, 12)]
    docs = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and docs:
            text = rng.choice(docs)[1]
        elif kind == 1 and docs:
            w = (rng.choice(docs)[1] or "").split()
            for _ in range(max(1, len(w) // 60)):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind in (2, 3):
            text = f"{words(rng, rng.randrange(60))}\n{rng.choice(shared)}\t{words(rng, rng.randrange(60))}"
        else:
            text = words(rng, rng.randrange(150))
        docs.append((i, text))
    docs += [(n, ""), (n + 1, None), (n + 2, " \t\n"), (n + 3, "a b c " * 80), (n + 4, "A B c"), (n + 5, "a b C"), (n + 6, words(rng, 30_000, 10**9)), (n + 7, "é ü 中文 " * 30), (n + 8, shared[0].upper())]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in docs], DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Words


def sliced(size, f):
    """What ``f`` gives where a slice has ``size`` bytes."""
    small, textops.SLICE_BYTES = textops.SLICE_BYTES, size
    try:
        return f()
    finally:
        textops.SLICE_BYTES = small


def test_slices_split_like_the_patterns():
    texts = [t for _, t in corpus()] + ["x", "y", "no space between", "end ", " start", "long" * 200, ""]
    for splitter, plain in ((textops.SPACED, brute.spaced), (textops.SPACED_FOLDED, lambda t: brute.spaced((t or "").translate(brute.FOLD))), (textops.ALNUM_FOLDED, brute.alnum)):
        for size in (textops.SLICE_BYTES, 64, 1000):
            for overlap in (0, 3, 40):

                def split(splitter=splitter, overlap=overlap):
                    out = {i: [] for i in range(len(texts))}
                    for s in textops.slices(pa.array(texts), splitter, overlap):
                        for i, row in enumerate(s.rows):
                            f, n = s.first[i], s.first[i + 1]
                            assert len(out[row]) - s.base == s.skip
                            assert b" ".join(s.words[c][:-1] for c in s.codes[f:n]) == s.span(f, n)
                            assert [bytes(s.data[a:b]) for a, b in zip(s.start[f:n], s.end[f:n], strict=True)] == s.span(f, n).split(b" ")[: n - f]
                            out[row] += s.span(f, n).decode().split(" ")[s.skip : n - f]
                    return [out[i] for i in range(len(texts))]

                assert sliced(size, split) == [plain(t) for t in texts]


def thue_morse(n):
    """Two words of 2**n letters for which sums over powers of any odd multiplier agree."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_of_words_and_runs_do_not_collide():
    rng = random.Random(0)
    pairs = [w.encode() for n in (8, 11, 12) for w in thue_morse(n)]
    assert len(set(textops.hashes_of(pairs).tolist())) == len(pairs)
    x, y = textops.hashes_of([b"x", b"y"])
    for n in (4, 6, 8):
        a, b = (np.array([x if c == "a" else y for c in w]) for w in thue_morse(n))
        assert textops.runs_of(a, len(a)) != textops.runs_of(b, len(b))
    some = np.array([rng.randrange(3) for _ in range(400)], np.uint64)
    for k in (1, 2, 3, 5, 6, 12, 13, 20):
        runs, plain = textops.runs_of(some, k), [tuple(some[i : i + k]) for i in range(401 - k)]
        assert len(set(runs.tolist())) == len(set(plain))
        assert len({(r, p) for r, p in zip(runs.tolist(), plain, strict=True)}) == len(set(plain))


def test_words_that_differ_are_never_taken_for_equal(spark):
    """Words that collide under polynomial hashes."""
    rng, docs = random.Random(2), []
    for n in (11, 12):
        for w in thue_morse(n):
            docs.append((len(docs), " ".join([*(f"c{n}x{i}" for i in range(10)), w, *(f"d{n}x{i}" for i in range(60))])))
    df = frame(spark, docs)
    assert rows(automaton.remove_substrings(df), "doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256") == sorted(brute.repeats(docs, 20), key=repr)
    assert rows(suffixes.remove_passages(df), "doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256") == sorted(brute.repeats(docs, 50), key=repr)
    items = [(0, docs[0][1].split()[10]), (1, " ".join(docs[2][1].split()[3:20]))]
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.contamination(docs, items), key=repr)
    short = [(i, " ".join(t.split()[: 10 + 11])) for i, t in docs]
    assert rows(minhash.near_duplicates(frame(spark, short)), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(short), key=repr)
    assert rng is not None


def test_pieces_of_long_texts_give_what_whole_texts_give():
    texts = pa.array([t for _, t in corpus(3)] + ["x" * 900 + " y z " + "a b " * 30, "\n".join(["same line here"] * 40), None])
    own = [(1, words(random.Random(3), 70)), (2, "a b c a b c a"), (3, "w1 w2")]

    def shown(x):
        return [tuple(y.tolist() if isinstance(y, np.ndarray) else y for y in row) if isinstance(row, tuple) else row for row in x]

    def anchored(length, grain):
        out = []
        for row, h, place, ctx in passages.anchors_of(texts, length, grain):
            out += zip(row.tolist(), place.tolist(), h.tolist(), ctx, strict=True)
        return sorted(out)

    def contaminated():
        index = decontaminate.index_items([i for i, _ in own], [t for _, t in own], 13, 3)
        counts = {w.grain: dict.fromkeys(w.shingles.ravel().tolist(), 1) for w in index.windows}
        for w in index.windows:
            counts[w.grain] |= dict.fromkeys(w.shingles.ravel().tolist(), 1)
        found = [(decontaminate.Lookup(keys), *rest) for keys, *rest in decontaminate.prefixes(index, counts)]
        return [(n, h, sorted(set(i))) for n, _, h, i in decontaminate.found_in(texts, index, found, 13)]

    def trimmed():
        gone = np.array([[3, 5], [40, 90], [95, 200]])
        return [(row, *passages.trimmed(parts, gone)) for row, parts in passages.documents_of(texts)]

    model = toxicity.Model(np.sort(np.concatenate([textops.hashes_of([b"w1", b"w2", b"a"]), textops.hashes_of([b"w100"], textops.BEGINNING)])), np.array([1.0, -2.0, 0.5, 0.25]), np.array([1.0, 2.0]))
    checks = [
        lambda: anchored(20, 6), lambda: anchored(50, 12), contaminated, trimmed, lambda: [(i, x.tolist()) for i, x in minhash.sets(texts)], lambda: np.round(quality.statistics(texts), 9).tolist(),
        lambda: np.round(toxicity.logits(texts, model), 9).tolist(), lambda: sorted((r, w, n) for x in toxicity.feature_counts(texts) for r, w, n in zip(*(y.tolist() for y in x), strict=True)),
    ]
    for check in checks:
        whole = shown(check())
        assert len(whole) > 1
        for size in (50, 300, 2000):
            assert shown(sliced(size, check)) == whole


def test_equal_windows_choose_equal_minimisers():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    got = set(textops.minimiser_positions(h, np.ones(500, bool), 7).tolist())
    want = {i + int(np.argmin(h[i : i + 7])) for i in range(494)}
    assert got == want


# 1: decontamination


def items(docs):
    rng = random.Random(5)
    long = [t for _, t in docs if t and len(t.split()) > 60]
    out = [(i, " ".join(long[i % len(long)].split()[5 : 5 + rng.randrange(3, 40)])) for i in range(8)]
    return [*out, out[0][:1] + ("w1 w2",), (20, ""), (21, None), (None, "w1 w2 w3"), (22, "A b C!"), (23, out[1][1])]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, block):
    docs = corpus()
    docs += docs[:3]  # repeated rows
    bench = spark.createDataFrame(items(docs), "item_id long, text string").withColumn("lang", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = decontaminate.decontaminate(frame(spark, docs), bench, block_bytes=block)
    want = brute.contamination(docs, items(docs))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    kept = decontaminate.clean(frame(spark, docs), bench, block_bytes=block)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows(kept, "doc_id") == sorted(((w[0],) for w in want if not w[5]), key=repr)
    none = decontaminate.decontaminate(frame(spark, docs), bench.limit(0))
    assert none.filter("n_hit > 0 or contaminated").count() == 0
    assert none.count() == len(docs)
    assert decontaminate.decontaminate(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_clean_judges_each_row_by_itself(spark, block):
    dirty, fine = " ".join(f"d{i}" for i in range(20)), " ".join(f"f{i}" for i in range(20))
    docs = [(1, dirty), (1, fine), (None, dirty), (None, fine), (2, dirty), (3, fine), (4, None), (None, None), (3, fine)]
    bench = spark.createDataFrame([(0, dirty)] + [(i, " ".join(f"x{i}y{j}" for j in range(20))) for i in range(1, 12)], "item_id long, text string")
    kept = decontaminate.clean(frame(spark, docs).withColumn("text_key", F.lit("clash")), bench, block_bytes=block)
    assert rows(kept, "doc_id", "text") == sorted([d for d in docs if d[1] != dirty], key=repr)


# 2: urls


def test_url_rules_and_mining(spark):
    pages = [
        (0, "http://a.com/en/1"), (1, "HTTP://X.Example.COM/en/7?q"), (2, "https://b.net/de/1#x"), (3, "https://m.example.net/de/8/"), (4, "http://o.org/es/"), (5, "http://notcom/en/"), (6, None), (7, "no scheme"),
        (8, "http://"), (9, "http://host?x=://y/z"), (10, "://q.org/es/3"), (11, "http://com/en/"), (None, "http://a.com/en/1"), (0, "http://a.com/en/1"),
    ]
    spam = [(100 + i, f"http://s{i}.bad.io/win/{i}?bet={i}") for i in range(40)] + [(200 + i, f"http://s{i}.good.io/read/{i}") for i in range(40)] + [(300, "http://new.bad.io/win/7?bet=1"), (301, "http://new.bad.io/read/7")]
    labels = spark.createDataFrame([(100 + i, True) for i in range(40)] + [(200 + i, False) for i in range(40)] + [(None, True), (300, None), (999, True)], "page_id long, bad boolean")
    df = spark.createDataFrame(pages + spam, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("tokens", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, labels, URL_RULES).collect()}
    assert urls.judge(df, labels, URL_RULES).count() == len(pages + spam)
    assert got[0] == ("a.com", "/en/1", "com/en/", "block")
    assert got[1] == ("x.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("b.net", "/de/1", "net/de/", "allow")
    assert got[3] == ("m.example.net", "/de/8/", "example.net/de/8", "block")
    assert got[4] == ("o.org", "/es/", "org/es/", "block")
    assert got[5] == ("notcom", "/en/", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("host", "", None, "allow")
    assert got[10] == ("q.org", "/es/3", "org/es/", "block")
    assert got[11] == ("com", "/en/", "com/en/", "block")
    assert got[300][3] == "block"  # not labelled, but with all tokens of a mined rule
    assert got[200][3] == "allow"
    assert all(got[100 + i][3] == "block" for i in range(40))
    empty = urls.judge(df, labels.limit(0), URL_RULES)
    assert empty.filter("rule is null and verdict = 'block'").count() == 0
    assert urls.judge(df.limit(0), labels, URL_RULES).count() == 0


def test_no_mined_rule_is_lost_among_many(spark):
    # 80 hosts of 8 tokens, one of them their own: over 10,000 rules of confidence 1.
    sure = [(i, f"http://h{i % 80}.bad.io/a/b?c={i}") for i in range(1600)]
    mixed = [(2000 + i, "ftp://mixed.org/x") for i in range(25)]
    good = [(3000 + i, "http://fine.net/a/b?c=1") for i in range(1600)]
    new = [(9000, "ftp://mixed.org/x"), (9001, "http://h3.bad.io/other"), (9002, "https://fine.net/y")]
    df = spark.createDataFrame(sure + mixed + good + new, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 2020) for i, _ in sure + mixed + good], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(df, labels, URL_RULES).filter("page_id >= 9000").collect()}
    assert got == {9000: "block", 9001: "block", 9002: "allow"}


def test_mined_rules_against_counting_all_itemsets(spark):
    """Generated urls: the verdicts are those of all rules found by counting every set of tokens."""
    import itertools

    rng = random.Random(8)
    pages, labels = [], []
    for i in range(400):
        parts = [p for p in ("win", "bet", "news", "a", "b") if rng.random() < 0.35]
        host = rng.choice(["x.io", "y.org", "z.net"])
        bad = ("win" in parts and "bet" in parts) or ("a" in parts and host == "y.org") or rng.random() < 0.1
        always = "/p/q/r" if "b" in parts else ""  # tokens that occur together
        pages.append((i, f"http://{host}/{'/'.join(parts)}{always}"))
        if i < 300:
            labels.append((i, bad))
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    own = {r.page_id: set(r.t) for r in df.select("page_id", urls.tokens(F.col("url")).alias("t")).collect()}
    least, confidence = 12, 0.75
    count = {}
    for i, bad in labels:
        for k in range(1, 6):
            for x in itertools.combinations(sorted(own[i]), k):
                n = count.setdefault(x, [0, 0])
                n[0] += 1
                n[1] += bad
    rules = [set(x) for x, (n, b) in count.items() if b >= least and b / n >= confidence]
    assert rules
    got = {r.page_id: r.verdict for r in urls.judge(df, lab, [], min_support=0.0, min_confidence=confidence, min_count=least).collect()}
    assert got == {i: "block" if any(x <= t for x in rules) else "allow" for i, t in own.items()}
    assert len(set(got.values())) == 2


def test_a_site_of_many_common_tokens(spark):
    """40 path parts that always occur together are one item, not 2**40 itemsets."""
    path = "/".join(f"part{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    pages = [(i, f"http://h{i % 7}.io/{path}/{'win' if i % 2 else 'read'}") for i in range(200)] + [(900, f"http://new.org/{path}/win"), (901, "http://new.org/read/parta")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([(i, i % 2 == 1 and i % 10 != 1) for i in range(200)], "page_id long, bad boolean")
    got = {r.page_id: r.verdict for r in urls.judge(df, lab, []).filter("page_id >= 900").collect()}
    assert got == {900: "block", 901: "allow"}


def test_minimal_rules(spark):
    rng = random.Random(3)
    for n in (0, 1, 60):
        sets = {frozenset(rng.sample("abcdefghij", rng.randrange(2, 7))) for _ in range(n)} | ({frozenset("ab"), frozenset("abcd"), frozenset("k"), frozenset("akl")} if n else set())
        df = spark.createDataFrame([(sorted(s), 0.1, 0.9) for s in sets], "tokens array<string>, support double, confidence double")
        got = [r.tokens for r in urls.minimal(df).collect()]
        assert sorted(got) == sorted(sorted(s) for s in sets if not any(o < s for o in sets))


# 3 and 10: repeated passages


@pytest.mark.parametrize(("remove", "length"), [(automaton.remove_substrings, 20), (suffixes.remove_passages, 50)])
@pytest.mark.parametrize("limit", [8000, 2])
def test_repeated_passages(spark, remove, length, limit):
    docs = [*corpus(2), (None, words(random.Random(9), 80)), (-5, words(random.Random(9), 90))]
    df = frame(spark, docs).withColumn("removal", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("place", F.lit(None).cast("long"))
    for name in ("_doc", "_tag", "_marks", "_all", "_chosen", "marks", "chosen", "row", "doc", "tag"):
        df = df.withColumn(name, F.lit(name))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.lit(None).cast("int")))
    got = remove(df, length=length, limit=limit)
    assert rows(got, "doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256") == sorted(brute.repeats(docs, length), key=repr)
    assert got.columns == [*df.drop("removal").columns, "removal"]
    assert got.filter("_marks <> '_marks' or _doc <> '_doc' or row <> 'row' or map_contains_key(m, 'k') is not true").count() == 0
    given = dict(docs)
    for r in got.collect():
        w = brute.spaced(given[r.doc_id])
        gone = {i for a, b in zip(r.removal.spans[::2], r.removal.spans[1::2], strict=True) for i in range(a, b)}
        assert brute.spaced(r.text) == [x for i, x in enumerate(w) if i not in gone]
        if not gone:
            assert r.text == given[r.doc_id]
    assert remove(df.limit(0), length=length).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = words(random.Random(3), 120)
    df = frame(spark, [(1, text), (1, text), (2, text), (2, words(random.Random(4), 100))])
    got = suffixes.remove_passages(df)
    assert rows(got.filter("doc_id = 1"), "removal.n_removed") == [(0,), (0,)]
    assert rows(got.filter("doc_id = 2"), "removal.n_removed") == [(0,), (120,)]


def test_automaton_statistics_are_longest_matches():
    rng = random.Random(7)
    for _ in range(60):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        a = automaton.Automaton()
        for s in seqs[:-1]:
            a.start()
            for i, w in enumerate(s):
                a.add(w, i)
        held = {tuple(s[i:j]) for s in seqs[:-1] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, (n, _) in enumerate(a.statistics(seqs[-1])):
            want = max((k for k in range(i + 2) if k == 0 or tuple(seqs[-1][i + 1 - k : i + 1]) in held), default=0)
            assert n == want


def test_frequent_anchor_is_bisected(spark):
    """A passage in many documents, each with other words around it, beyond the limit."""
    rng = random.Random(11)
    passage = words(rng, 64, 10**9)
    docs = [(i, f"{words(rng, 40, 10**9)} {passage} {words(rng, 40, 10**9)}") for i in range(60)]
    got = suffixes.remove_passages(frame(spark, docs), limit=5)
    assert rows(got, "doc_id", "removal.n_words", "removal.n_removed", "removal.kept_sha256") == sorted(brute.repeats(docs, 50), key=repr)
    assert passages.PLACE_BITS == 40


# 4: near duplicates


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = corpus(seed, 120)
    df = frame(spark, docs).withColumn("component_id", F.lit("clash")).withColumn("id", F.lit(1))
    assert rows(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs), key=repr)


def test_near_duplicates_of_large_buckets(spark):
    """Many near copies, most of which are not linked with the smallest id."""
    rng = random.Random(4)
    base = words(rng, 120, 10**9).split()
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    assert rows(minhash.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs), key=repr)
    assert rows(minhash.near_duplicates(frame(spark, docs), rounds=2), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute.near(docs), key=repr)
    kept = minhash.deduplicated(frame(spark, docs))
    assert rows(kept, "doc_id") == sorted(((r[0],) for r in brute.near(docs) if r[3]), key=repr)


def test_near_duplicates_in_odd_cases(spark):
    text = words(random.Random(1), 40)
    df = frame(spark, [(5, text), (5, text), (3, text), (None, text), (None, None), (8, None), (9, "")])
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 36, 3, False), (3, 36, 3, True), (None, 36, None, True), (None, 0, None, True), (8, 0, 8, True), (9, 0, 9, True)}
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.deduplicated(df).count() == 5


def test_estimate_is_near_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    errors = []
    for _ in range(40):
        a, b = np.unique(pool[:2000]), np.unique(pool[300:2300])
        s = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(float(minhash.estimate(minhash.sketch(a), minhash.sketch(b), len(a), len(b))) - s)
        pool = rng.permutation(pool)
    assert abs(np.mean(errors)) < 0.03
    a, b = np.unique(pool[:1000]), np.unique(pool[1500:2500])
    assert abs(float(minhash.estimate(minhash.sketch(a), minhash.sketch(b), len(a), len(b)))) < 0.03


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5: WARC


def test_warc(spark):
    long = "é<p>\r\n\r\nWARC/1.1\r\n" * 20_000
    pages = [(3, "u3", "same"), (1, "u1\r\nX: y", "same"), (2, None, ""), (4, "u4", None), (5, "u5", long), (6, "u6", "other"), (None, "n", "same"), (None, "n", "lone"), (1, "u1", "same"), (7, "u7", "WARC/1.1\r\nContent-Length: 5\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).withColumn("payload", F.lit(1)).withColumn("record_id", F.lit(1))
    got = warc.archive_pages(df).collect()
    assert len(got) == len(pages)
    assert {r.url for r in got} == {"u3", "u1%0D%0AX: y", "u1", "u4", "u5", "u6", "u7", "n", None}
    import base64
    import hashlib

    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[digest(h)] = min(p, first.get(digest(h), p))
    assert sorted((r.payload_digest, r.payload_bytes) for r in got) == sorted((digest(h), len((h or "").encode())) for _, _, h in pages)
    for d, ps in first.items():
        own = [r for r in got if r.payload_digest == d]
        assert [(r.page_id, r.refers_to) for r in own if r.record_type == "response"] == [(ps, None)]
        assert all(r.refers_to == ps and r.payload == b"" for r in own if r.record_type == "revisit")
    assert [r.record_type for r in got if r.payload_digest == digest("lone")] == ["response"]
    assert next(r.payload for r in got if r.page_id == 5).decode() == long
    least = warc.archive_pages(df, least_bytes=5)
    assert least.filter("record_type = 'revisit'").count() == 0
    assert warc.archive_pages(df.limit(0)).count() == 0


def plain_warc(raw):
    """The records of an archive, read by the letter of the format: (headers, block)."""
    import gzip

    data, out = gzip.decompress(raw), []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        out.append((headers, data[:n]))
        assert data[n : n + 4] == b"\r\n\r\n"
        data = data[n + 4 :]
    return out


def test_archives_are_standard(spark, tmp_path):
    import base64
    import hashlib
    import zlib as z

    body = ["<p>é</p>", "same", "same", "", None, "x" * 3_000_000, "same"]
    df = spark.createDataFrame([(i, f"http://h/{i}" if i != 3 else None, t) for i, t in enumerate(body)], "page_id long, url string, html string").coalesce(1)
    got = warc.archive(df, f"file://{tmp_path}/w", file_bytes=2000).collect()
    assert sorted((r.page_id, r.url) for r in got) == [(i, f"http://h/{i}" if i != 3 else None) for i in range(len(body))]
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    seen, ids = {}, set()
    for folder in ("raw", "deduplicated"):
        files = [f for f in (tmp_path / "w" / folder).iterdir() if f.name.startswith("part-")]
        assert len(files) > 1  # bounded by bytes
        for f in files:
            raw, n = f.read_bytes(), 0
            while raw:  # a member for each record
                d = z.decompressobj(31)
                assert d.decompress(raw).startswith(b"WARC/1.1\r\n")
                assert d.eof
                raw, n = d.unused_data, n + 1
            records = plain_warc(f.read_bytes())
            assert n == len(records)
            assert records[0][0]["WARC-Type"] == "warcinfo"
            for h, block in records:
                assert h["WARC-Record-ID"].startswith("<urn:uuid:")
                assert h["WARC-Date"].endswith("Z")
                if h["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200")
                page = int(h["X-Page-Id"])
                whole = (body[page] or "").encode()
                assert h["WARC-Payload-Digest"] == f"sha1:{digest(whole)}"
                assert b"Content-Length: %d" % len(whole) in http
                if folder == "deduplicated":
                    seen[page] = h
                    assert payload == (whole if h["WARC-Type"] == "response" else b"")
                    assert h["WARC-Record-ID"] not in ids
                    ids.add(h["WARC-Record-ID"])
                else:
                    assert payload == whole
    for page, first in ((2, 1), (6, 1), (4, 3)):
        assert seen[page]["WARC-Type"] == "revisit"
        assert seen[page]["WARC-Refers-To"] == seen[first]["WARC-Record-ID"]
        assert seen[page]["WARC-Refers-To-Target-URI"] == seen[first]["WARC-Target-URI"]
        assert seen[page]["WARC-Refers-To-Date"] == seen[first]["WARC-Date"]
        assert seen[page]["WARC-Profile"].endswith("identical-payload-digest")
    assert {p for p, h in seen.items() if h["WARC-Type"] == "response"} == {0, 1, 3, 5}


def test_large_pages(spark):
    """40 pages of 5 MB, and one over a gzip member's bound; a third are copies."""
    rng = random.Random(1)
    bodies = ["".join(rng.choices("abcdefgh \n", k=1000)) * 5000 for _ in range(3)]
    df = spark.range(41).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.when(F.col("id") == 40, F.lit("é" * 10_000_000)).when(F.col("id") % 3 == 0, F.lit(bodies[0])).otherwise(F.concat(F.when(F.col("id") % 3 == 1, bodies[1]).otherwise(bodies[2]), F.col("id").cast("string"))).alias("html")).repartition(4)
    got = warc.archive_pages(df).select("page_id", "record_type", "refers_to", "payload_bytes", F.sha1("payload").alias("h")).collect()
    given = {r.page_id: r for r in df.select("page_id", F.sha1("html").alias("h"), F.octet_length("html").alias("n")).collect()}
    assert len(got) == 41
    for r in got:
        copy = r.page_id % 3 == 0 and r.page_id != 0
        assert (r.record_type, r.refers_to, r.payload_bytes) == ("revisit" if copy else "response", 0 if copy else None, given[r.page_id].n)
        assert copy or r.h == given[r.page_id].h


# 6: toxicity


def test_toxicity_held_out(spark, data):
    data = data.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    assert (np.diff(model.theta) > 0).all()
    test = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    found, said = test[test.label == 1].toxic, test[test.toxic].label
    assert found.mean() > 0.9
    assert said.mean() > 0.97
    assert test.expected_severity.between(0, 2).all()
    assert ((test.grade > 0) == test.toxic).all()
    assert ((test.expected_severity >= 1) == test.toxic).all()


def test_toxicity_in_odd_cases(spark):
    docs = [(i, "you idiot go away now" if i % 4 == 0 else f"a fine day number {i}") for i in range(200)] + [(500, None), (501, ""), (None, "you idiot go away now"), (0, "you idiot go away now"), (502, "word " * 100_000 + "you idiot go away now")]
    labels = [(i, 1 if i % 4 == 0 else 0) for i in range(200)] + [(None, 1), (3, None), (4, 0)]
    df = frame(spark, docs).withColumn("toxic", F.lit("clash")).withColumn("word", F.lit(2))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(df, lab)
    got = {r.doc_id: r.toxic for r in toxicity.score(df, model).collect()}
    assert toxicity.score(df, model).count() == len(docs)
    assert all(got[i] == (i % 4 == 0) for i in range(200))
    assert not got[500]
    assert not got[501]
    assert got[None]
    assert got[502]
    kept = toxicity.clean(df, model)
    assert kept.columns == df.columns
    assert kept.count() == 150 + 2
    for none in (lab.limit(0), lab.withColumn("toxic", F.lit(0))):
        assert toxicity.score(df, toxicity.fit(df, none)).filter("toxic").count() == 0
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), lab)).count() == 0


def plain_loss(x, grade, weights, theta, ridge):
    """The mean negative log likelihood of grades, row by row."""
    total = 0.0
    for row, g in zip(x, grade, strict=True):
        above = [1.0, *(1 / (1 + np.exp(t - row @ weights)) for t in theta), 0.0]
        total -= np.log(above[g] - above[g + 1])
    return total / len(grade) + ridge / 2 * (weights @ weights)


def test_ordinal_fit_against_a_plain_one():
    """Planted weights and thresholds; the fit reaches the least loss, and no step away from it is better."""
    rng = np.random.default_rng(3)
    x = np.log1p(rng.poisson(0.7, (1500, 6)))
    true, cuts = np.array([2.0, 1.0, 0.5, -1.0, 0.0, 3.0]), np.array([1.0, 3.0])
    z = x @ true + rng.logistic(size=1500)
    grade = (z[:, None] > cuts[None, :]).sum(axis=1)
    row, col = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(row, col, x[row, col], grade, 6, steps=1500, ridge=1e-3)
    assert theta[0] < theta[1]
    least = plain_loss(x, grade, w, theta, 1e-3)
    assert least <= plain_loss(x, grade, true, cuts, 1e-3)
    for i in range(6):
        for step in (-0.05, 0.05):
            assert plain_loss(x, grade, w + step * np.eye(6)[i], theta, 1e-3) > least - 1e-5
    assert np.abs(w - true).max() < 0.5
    # Expected severity rises with the planted one.
    m = toxicity.Model(np.zeros(0, np.uint64), w, theta)
    e = m.above(x @ w).sum(axis=1)
    assert [e[grade == g].mean() for g in range(3)] == sorted(e[grade == g].mean() for g in range(3))


def test_scores_against_a_plain_version(spark):
    docs = [(i, t) for i, t in corpus(7, 30)]
    weights = {b"w1 ": 1.0, b"w2 ": -2.0, b"w30 ": 0.5, b"w10": 0.25, b"chang": 3.0}
    listed = [*weights]
    h = np.array([textops.hashes_of([w.strip()], textops.WORD if w.endswith(b" ") else textops.BEGINNING)[0] for w in listed])
    by = np.argsort(h)
    m = toxicity.Model(h[by], np.array([weights[listed[i]] for i in by]), np.array([0.5, 2.0]))
    for r in toxicity.score(frame(spark, docs), m).collect():
        own = {}
        for w in brute.alnum(dict(docs)[r.doc_id]):
            raw = w.encode()
            for f in (raw + b" ", *(raw[:k] for k in toxicity.BEGINNINGS if len(raw) > k)):
                own[f] = own.get(f, 0) + 1
        z = sum(np.log1p(own.get(f, 0)) * w for f, w in weights.items())
        e = sum(1 / (1 + np.exp(t - z)) for t in (0.5, 2.0))
        assert abs(r.expected_severity - e) < 1e-9
        assert r.toxic == (e >= 1)


# 7: packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = corpus(4, 40)
    docs += docs[:2]
    df = frame(spark, docs).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    got = packing.pack(df, length=256).collect()
    t = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs}
    pieces = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.length, r.ids_crc32, r.doc_tokens) == (len(ids), zlib.crc32(r.ids), len(want[r.doc_id]))
        assert ids == want[r.doc_id][r.start : r.start + r.length]
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padding))
    assert sorted(pieces) == list(range(len(pieces)))
    for s, ps in pieces.items():
        ps.sort()
        assert [p[0] for p in ps] == [sum(p[1] for p in ps[:i]) for i in range(len(ps))]
        filled = sum(p[1] for p in ps)
        assert filled == 256 or s == max(pieces)
        assert {p[2] for p in ps} == {0 if filled & (filled - 1) == 0 else 256 - filled}
    assert sum(r.length for r in got) == sum(len(want[i]) for i, _ in docs)
    assert packing.pack(df.limit(0)).count() == 0


def test_ids_are_those_of_the_vocabulary_file(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    signs = [*"  \n\t'!é中ß٣\u0301\u2028\x1c,.-", "word", "don't", "12", " <|endoftext|>", "日本語", "🙂", "\u00a0"]
    texts = [t or "" for _, t in corpus(5)] + ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x<|endoftext|>  \n y", "<|endoftext|", "<| endoftext |>", "<|endofprompt|> é<|endoftext|>日本"]
    texts += ["".join(rng.choice(signs) for _ in range(200)) for _ in range(100)]
    path = packing.vocabulary_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    small, packing.PART = packing.PART, 300
    try:  # with and without cuts
        assert [np.concatenate(packing.encoder(path)(x)).tolist() for x in texts] == want
    finally:
        packing.PART = small
    assert [np.concatenate(packing.encoder(path)(x)).tolist() for x in texts] == want
    got = packing.pack(frame(spark, list(enumerate(texts)))).collect()
    ids = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {i: [*x, 1] for i, x in enumerate(want)}


def test_long_runs_are_packed(spark):
    from tokenizers import Tokenizer

    n = 1_000_000
    texts = [" " * n, "\n" * n, "a" * n, "x " * 1000 + "é" * n + " \n" * 1000, "-" * 5000 + " tail"]
    t = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    got = packing.pack(frame(spark, list(enumerate(texts)))).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.array_sort(F.collect_list(F.struct("start", "ids_crc32"))).alias("crc")).collect()
    for r in got:
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.n == r.all == len(ids)
        ends = [x.start for x in r.crc[1:]] + [len(ids)]
        assert all(zlib.crc32(np.array(ids[x.start : e], "<u4").tobytes()) == x.ids_crc32 for x, e in zip(r.crc, ends, strict=True))


# 8: quality


def test_quality_held_out(spark, data):
    data = data.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.classify(docs, labels.select("doc_id", "quality")).join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert held.score.between(0, 1).all()


def test_quality_in_odd_cases(spark):
    docs = corpus(6, 30) + [(None, "x y"), (0, "repeated row")]
    df = frame(spark, docs).withColumn("quality", F.lit("clash")).withColumn("stats", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (2, None), (4, 1)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0), labels.limit(1)):
        got = quality.classify(df, lab).collect()
        assert len(got) == len(docs)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.classify(df.limit(0), labels).count() == 0


def test_statistics_against_a_plain_version():
    texts = ["", None, "One, two.\nThree three!\r\n\nx|y  #tag", "é ü 中文\nA1 b2", "same line\nsame line\n" * 3]
    for t, got in zip(texts, quality.statistics(pa.array(texts)), strict=True):
        t = t or ""  # noqa: PLW2901
        raw, w, lines = t.encode(), brute.spaced(t), [x for x in t.replace("\r", "\n").split("\n") if x]
        kind = lambda b: int(quality._KIND[b])
        n = max(len(t), 1)
        shares = [sum(kind(b) == k for b in raw) / n for k in range(13)]
        size = [len(x.encode()) for x in w] or [0]
        many, rows_ = max(len(w), 1), max(len(lines), 1)
        odd = sum(7 <= kind(x.encode()[-1]) <= 10 for x in w) / many
        want = [*shares, np.log1p(n), np.log1p(len(w)), np.mean(size), np.std(size), len(set(w)) / many, odd, np.log1p(len(lines)), len(set(lines)) / rows_, len(w) / rows_ / 100]
        assert np.allclose(got, want, atol=1e-9)


def test_isotonic_against_the_formula():
    """Pool adjacent violators gives max over a of min over b of the mean of a to b."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        weight, x = rng.integers(1, 6, n).astype(float), np.sort(rng.random(n))
        good = np.array([rng.integers(0, int(w) + 1) for w in weight], float)
        knots, levels = quality.isotonic(x, good, weight)
        want = [max(min(good[a : b + 1].sum() / weight[a : b + 1].sum() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        pools = [(want[i], weight[i], good[i], x[i] * weight[i]) for i in range(n)]
        merged = []
        for level, w, g, xw in pools:
            if merged and abs(merged[-1][0] - level) < 1e-12:
                merged[-1] = (level, merged[-1][1] + w, merged[-1][2] + g, merged[-1][3] + xw)
            else:
                merged.append((level, w, g, xw))
        assert np.allclose(knots, [xw / w for _, w, _, xw in merged])
        assert np.allclose(levels, np.maximum.accumulate([(g + 1) / (w + 2) for _, w, g, _ in merged]))


def test_quality_fit_against_a_plain_one(spark):
    """Normal equations and scores, by numpy on all rows at once."""
    docs = corpus(9, 120)
    labels = [(i, int(i % 3 == 0 or len(t or "") > 400)) for i, t in docs]
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    stats = quality.described(df).cache()
    m = quality.fit(stats, lab, held, features=32)
    out = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    half = {r.doc_id: r.h for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("h")).collect()}
    x = {i: quality.statistics(pa.array([t]))[0] for i, t in docs}
    assert np.allclose(m.centre, np.mean([x[i] for i in out], axis=0))
    fitting = [i for i in out if half[i]]
    z, y = m.features(np.array([x[i] for i in fitting])), np.array([dict(labels)[i] for i in fitting], float)
    assert np.allclose(m.weights, np.linalg.solve(z.T @ z / len(y) + 1e-3 * np.eye(z.shape[1]), z.T @ y / len(y)))
    got = {r.doc_id: r.score for r in quality.score(stats, m, held).collect()}
    assert all(abs(got[i] - np.interp(m.features(x[i][None, :]) @ m.weights, m.knots, m.levels)[0]) < 1e-9 for i in got)


# 9: neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[50]  # many copies of a query
    x[300] = x[0] * 3
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (None, x[0].tolist()), (1050, [1.0] * 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("v", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, k=5, every=50, block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    d = x.astype(np.float64)
    for q in range(0, 600, 50):
        s = (d * d[q]).sum(axis=1) / (np.sqrt((d * d).sum(axis=1)) * np.sqrt((d[q] * d[q]).sum()))
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [v for v, _ in got[q]] == want
        assert np.allclose([v for _, v in got[q]], s[want], atol=1e-12)
    assert set(got) == set(range(0, 600, 50))
    few = neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), k=5)
    assert few.count() == 2
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_a_repeated_query_row_hides_no_equal_candidate(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[51] = x[50]
    data = [(50, x[50].tolist())] * 6 + [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1)
    got = neighbours.nearest(df, k=5, every=50).filter("query_id = 50").orderBy("rank").collect()
    d = x.astype(np.float64)
    s = (d @ d[50]) / np.sqrt((d * d).sum(axis=1) * (d[50] @ d[50]))
    assert [r.vec_id for r in got] == sorted((i for i in range(60) if i != 50), key=lambda i: (-s[i], i))[:5]
    assert got[0].vec_id == 51


@pytest.mark.parametrize("size", [64, 1536])
def test_neighbours_in_blocks(spark, size):
    """Any layout of blocks gives the nearest by brute force, also of many dimensions and with a row that is a third of all."""
    rng = np.random.default_rng(size)
    x = np.round(rng.normal(size=(300, size)) * rng.lognormal(size=(300, 1)), 3)
    x[250:] = x[100] + rng.normal(size=(50, size)) * 0.01
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 150
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = unit @ unit.T
    for block, candidates in ((2, 40), (1000, 100_000)):
        got = {}
        for r in neighbours.nearest(df, k=3, every=50, block=block, candidates=candidates).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        for q in range(0, 300, 50):
            copies = [i for i in range(300) if i != q] + [7] * 150
            want = sorted(copies, key=lambda i, q=q: (-s[q, i], i))[:3]
            assert [v for v, _ in got[q]] == want
            assert np.allclose([v for _, v in got[q]], s[q, want], atol=1e-12)


@pytest.mark.parametrize("block", [1000, 5])
def test_a_query_of_another_length_takes_no_rows_from_others(spark, block):
    rng = np.random.default_rng(4)
    data = {i: rng.normal(size=9 if i in (100, 101, 150) else 8) for i in range(400)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, k=5, every=50, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 400, 50):
        s = {i: v @ data[q] / np.sqrt((v @ v) * (data[q] @ data[q])) for i, v in data.items() if i != q and len(v) == len(data[q])}
        assert got[q] == sorted(s, key=lambda i: (-s[i], i))[:5]
