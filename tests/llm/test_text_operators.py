import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skylattice.llm import decontam, packing, quality, simhash, substring_dedup, token_counts
from skylattice.llm import tokenizer as tk
from tests.llm import brute

PATH = P.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def lib(t):
    return LIB.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 a1!'é漢<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_and_pre_tokens_give_the_library_ids(text):
    enc = tk.load(PATH, tk.file_bytes(PATH))
    assert enc.splits_at_space and enc.ids(text).tolist() == lib(text)
    assert [i for p in token_counts.pre_tokens(text) for i in lib(p)] == lib(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    import sentencepiece

    path = P.path(name)
    want = (lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or ""))) if name.endswith("model") else (lambda t: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids))
    rows = brute.corpus()[:30]
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(brute.frame(spark, rows), path).collect())
    assert got == Counter((d, want(t)) for d, t, *_ in rows)


@pytest.mark.parametrize("char", [" ", "\n", "x", "é"])
def test_very_long_runs(char):
    enc, text = tk.load(PATH, tk.file_bytes(PATH)), "a b" + char * 1_000_000 + " end"
    assert enc.ids(text).tolist() == lib(text) and sum(enc.pieces(t) for t in token_counts.pre_tokens(text)) == len(lib(text))


def test_long_pre_tokens_are_looked_up_by_digest(spark):
    rows = [(k, f"{'漢字' * 200} short {'x' * n} {'x' * n}") for k, n in enumerate([1, 47, 48, 49, 50, 5000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PATH).collect()}
    assert got == {d: len(lib(t)) for d, t in rows}


@pytest.mark.parametrize("head", [1 << 18, 5, 0])
def test_token_counts(spark, head):
    rows = brute.corpus()
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(brute.frame(spark), PATH, head=head).collect())
    assert got == Counter((d, len((t or "").encode()), n := len(lib(t)), n > 512) for d, t, *_ in rows)


def test_packing(spark):
    rows = brute.corpus()
    out = packing.pack_documents(brute.frame(spark), PATH, 64).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for part in by.values():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == [sum(x.length for x in part[:k]) for k in range(len(part))] and sum(r.length for r in part) <= 64
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array(lib(t) + [2], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    total = sum(r.length for r in out)
    assert len(by) <= 1.03 * -(-total // 64) + 1


def test_cut_puts_the_remainder_first():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(3, 4) == [(0, 3)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=20))
def test_plan_places_every_length_once(hist):
    used, sequences = Counter(), 0
    for pattern, n in packing.plan(hist, 40):
        assert n > 0 and sum(length * c for length, c in pattern) <= 40
        sequences += n
        for length, c in pattern:
            used[length] += n * c
    assert used == Counter(hist)
    plain = packing.best_fit(np.array([hist.get(k, 0) for k in range(41)]), 40)
    assert sequences <= sum(n for _, n in plain)


def test_fit_is_least_squares():
    h = np.zeros(11)
    h[[3, 7, 4, 6, 2]] = [50, 50, 30, 40, 20]
    groups = packing.patterns([2, 3, 4, 6, 7], 10)
    x = packing.fit(h, groups, 2000)
    best = sum(np.bincount(p[:, j], v, 11) for p, v in zip(groups, x) for j in range(p.shape[1]))
    assert np.abs(best - h).max() < 12  # 6 + 4 and 2 + 2 + 6 compete; 3 + 7 fits exactly
    assert abs(best[3] - 50) < 1 and abs(best[7] - 50) < 1


def test_quality_counts_and_verdicts(spark):
    rows = brute.corpus()
    out = quality.rules(brute.frame(spark)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = Counter()
    for d, t, *_ in rows:
        c = brute.counts(t)
        want[(d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert all(not r.kept for r in out if r.base_failed or r.doc_id == 407) and sum(r.kept for r in out) > 20
    kept = quality.keep(brute.frame(spark))
    assert kept.columns == brute.frame(spark).columns and kept.count() == sum(r.kept for r in out) and kept.first().n_words == "clash"


def test_rows_that_repeat_a_doc_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(2), "b"), (1, text(1), "a"), (2, text(2), "c"), (None, text(3), "d"), (3, text(4), "e"), (3, text(4), "e"), (4, None, "f"), (5, "", "g"), (None, text(3), "h")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(parts)
        got = simhash.keep_one(df)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, text(1), "a"), (None, text(3), "d"), (None, text(3), "h"), (3, text(4), "e"), (4, None, "f")], key=str)


def test_keep_one_shuffles_no_texts(spark):
    """Whether or not Spark takes the table of ids for small enough to broadcast."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    df = spark.createDataFrame([(k, text(k // 2)) for k in range(40)], "doc_id long, text string").repartition(3)
    df = simhash.written(df)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simhash.keep_one(df)
        assert sorted(r.doc_id for r in got.collect()) == list(range(0, 40, 2))
        steps = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert any("Scan parquet" in s and "text#" in s for s in steps)
    assert not [s for s in steps if " Exchange" in s.split("\n")[0] and "text#" in s]


@pytest.mark.parametrize("most, map_bits", [(100_000, 1 << 28), (10, 1 << 28), (10, 64)])
def test_rows_are_picked_by_their_ids(spark, monkeypatch, most, map_bits):
    """By broadcast, by bitmap, and by one too small to leave anything out."""
    monkeypatch.setattr(simhash, "BROADCAST_NAMES", most)
    monkeypatch.setattr(simhash, "MAP_BITS", map_bits)
    rows = [(k * 7919 - 1_000_000, f"t{k}", k) for k in range(1500)] + [(None, "none", -1), (5, "again", 1), (5, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket long").repartition(3)
    ids = [5, 12, *[r[0] for r in rows[:1500:3]]]
    named = spark.createDataFrame([(i,) for i in ids], "held long")
    got, rest = simhash.picked(df, named), simhash.picked(df, named, without=True)
    assert got.columns == rest.columns == df.columns
    assert Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[0] in ids)
    assert Counter(map(tuple, rest.collect())) == Counter(r for r in rows if r[0] not in ids)
    monkeypatch.setattr(simhash, "BROADCAST_NAMES", 0)
    twice = spark.createDataFrame([(k, f"a b c d e f{k // 2}") for k in range(40)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(twice).collect()) == list(range(0, 40, 2))


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    values = [rng.choice([rng.randrange(100), rng.randrange(10**7)]) for _ in range(2000)]
    df = spark.createDataFrame([(v, k % 7) for k, v in enumerate(values)], "v long, g int")
    parts = df.select(F.lit("x").alias("k"), F.lit("r").alias("ratio"), quality.bucket(F.col("v")).alias("bucket"), "g").groupBy("k", "ratio", "bucket", "g").agg(F.count("*").alias("n"))
    q = quality.quantiles(parts, ["k"]).first()
    s = sorted(values)
    for got, p in ((q.low, quality.LOW), (q.mid, 50), (q.high, quality.HIGH)):
        true = s[-(-len(s) * p // 100) - 1]
        assert got <= true <= got * (1 + 2**-10) + 1


def test_groups_have_thresholds_of_their_own(spark, monkeypatch):
    """One source writes symbols, long words, lines twice and repeats as a habit, the other does not: the same text is
    judged differently in each, by every one of the four ratios."""
    monkeypatch.setattr(quality, "LEAST_GROUP", 100)
    rng = random.Random(5)

    def some(n, low=4, high=6):
        return ["".join(rng.choices("abcdefghij", k=rng.randint(low, high))) for _ in range(n)]

    def text(kind):
        if kind == "symbols":
            return " ".join(w + "#" * rng.randint(0, 2) for w in some(80))
        if kind == "long":
            return " ".join(some(80, 8, 11))
        if kind == "lines":
            return "\n".join(f"x\n{' '.join(some(3))}" for _ in range(25))
        if kind == "repeats":
            twice = some(12)
            return " ".join(some(60) + twice + some(3) + twice)
        return " ".join(some(80))

    odd = ["symbols", "long", "lines", "repeats"]
    rows = [(text(odd[k % 4]), "en", "wild") for k in range(400)] + [(text("plain"), "en", "calm") for _ in range(400)]
    probes = [(text(o), "en", s) for s in ("wild", "calm") for o in odd for _ in range(2)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows + probes)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.rules(df).collect()}
    verdicts = [kept[len(rows) + k] for k in range(len(probes))]
    assert sum(verdicts[:8]) >= 7 and not any(verdicts[8:])
    limits = {r.source: r for r in quality.thresholds(quality.with_counts(df)).collect()}
    for name, *_ in quality.RATIOS:
        assert limits["wild"][f"ceil_{name}"] > limits["calm"][f"ceil_{name}"]


def test_quality_with_clashing_columns(spark):
    names = ["_words", "_lines", "_hashes", "_sorted", "_at", "_lang", "_source", "row", "n_words", "kept", "base_failed", "ratio"]
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(90)), "en", "s", *names), (2, "few", None, None, *names)], ["doc_id", "text", "lang", "source", *names])
    kept = quality.keep(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [tuple(df.where("doc_id = 1").first())]
    assert {r.doc_id: r.kept for r in quality.rules(df).collect()} == {1: True, 2: False}
    assert quality.keep(df.limit(0)).count() == 0


@pytest.mark.parametrize("window,gram,hot", [(35, 8, 1000), (12, 4, 0), (12, 4, 3)])
def test_substring_dedup(spark, monkeypatch, window, gram, hot):
    monkeypatch.setattr(substring_dedup, "HOT_RUNS", hot)
    rows = brute.corpus()
    out = substring_dedup.remove(brute.frame(spark).repartition(5), window, gram).collect()
    want = Counter((d, *x) for (d, *_), x in zip(rows, brute.removed(rows, window)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(r.n_removed for r in out) > 1000


def test_simhash_components(spark):
    rows = brute.corpus()
    fp = [brute.fingerprint(t) for _, t, *_ in rows]
    root, least = brute.classes(set(fp), 3), {}
    for (d, *_), f in zip(rows, fp):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    want = Counter((d, f"{f:016x}", least.get(root[f])) for (d, *_), f in zip(rows, fp))
    for cap in (1024, 2):
        got = simhash.components(brute.frame(spark), cap=cap).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_pigeonring_loses_no_link(spark):
    """Clusters of fingerprints around centres, with small and with split keys."""
    rng = random.Random(8)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(25)}
    want = brute.classes(fps, 3)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for cap in (1024, 4):
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, cap).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
        assert {f: find(f) for f in fps} == want


def test_empty_tables(spark):
    df = brute.frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack_documents(df, PATH).count() == 0 and quality.rules(df).count() == 0 and simhash.components(df).count() == 0
    assert substring_dedup.remove(df).count() == 0 and token_counts.count_tokens(df, PATH).count() == 0 and decontam.overlaps(df, bench).count() == 0
    assert decontam.overlaps(brute.frame(spark, brute.corpus()[:5]), bench).count() == 0


def overlap(doc, item, window=20, agree=80):
    """Whether some diagonal has a window of the item that agrees well enough, by all positions."""
    d, i = doc, item
    size = min(len(i), window)
    for shift in range(-len(i) + 1, len(d)):
        same = [0 <= k + shift < len(d) and d[k + shift] == i[k] for k in range(len(i))]
        inside = [0 <= k + shift < len(d) for k in range(len(i))]
        for a in range(len(i) - size + 1):
            if all(inside[a : a + size]) and 100 * sum(same[a : a + size]) >= agree * size:
                return True
    return False


def test_decontamination(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(900)]
    items = [rng.choices(vocab, k=n) for n in (30, 45, 60, 25, 8)] + [[], ["w1"]]
    docs, leaky = [], set()
    for k in range(60):
        text = rng.choices(vocab[2:], k=rng.randrange(30, 300))
        if k % 3 == 0:
            item = list(items[k % 4])
            for _ in range(len(item) // 12):  # a substitution every dozen words
                item[rng.randrange(len(item))] = "zzz"
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + ("," if rng.random() < 0.2 else "") for w in item]
        docs.append((k, " ".join(text)))
    docs += [(99, " ".join(["q", *items[4], "r"])), (None, " ".join(items[0])), (98, None), (97, "")]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None)], "item_id long, text string")
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, seed string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()}
    low = lambda t: [x.strip(",").lower() for x in (t or "").split()]
    want = {(d, k) for d, t in docs for k, i in enumerate(items) if i and (overlap(low(t), i) if len(i) >= 12 else any(low(t)[a : a + len(i)] == i for a in range(len(low(t)))))}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 20
    leaky = {d for d, _ in got}
    kept = decontam.remove(df, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - leaky and kept.columns == df.columns


def test_near_groups_and_keep_one(spark):
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(2000)]
    rows, family = [], {}
    for k in range(40):
        base = rng.choices(vocab, k=rng.randrange(120, 400))
        for c in range(4):
            w = list(base)
            for _ in range(c * len(w) // 200):  # up to three edits in 200 words
                w[rng.randrange(len(w))] = "edited"
            rows.append((10 * k + c, " ".join(w).upper() if c == 3 else " ".join(w), "x"))
            family[10 * k + c] = k
    rows += [(900, None, "x"), (901, "", "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect() if r.doc_id is not None}
    sets = {d: set(simhash.shingles(simhash.words(t), 5)) for d, t, _ in rows if d is not None}
    linked = [(a, b) for k in range(40) for a in range(10 * k, 10 * k + 4) for b in range(a + 1, 10 * k + 4) if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert len(linked) > 100 and sum(got[a] == got[b] for a, b in linked) >= 0.97 * len(linked)
    assert all(family.get(d) == family.get(c) for d, c in got.items()) and got[901] == got[900] == 900
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, *{c for c in got.values()}])


def _classes(spark, rng, n):
    """n classes under one key of each word, the first two of a pair 78 bits apart in the shingles' signature."""
    sig = [[rng.getrandbits(64) for _ in range(8)] for _ in range(n)]
    flips = rng.sample(range(512), 78)
    sig[1] = [w ^ sum(1 << b % 64 for b in flips if b // 64 == i) for i, w in enumerate(sig[0])]
    order = rng.sample(range(n), n)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(k, *[(k * 7 if k > 1 else 0) % 1024 << 54 & (1 << 63) - 1] * 4, *map(signed, sig[k])) for k in order]
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["node", *[f"w{i}" for i in range(4)], *[f"g{i}" for i in range(8)]]))


@pytest.mark.parametrize("cap, blocks", [(300, 16), (100, 2)])
def test_pairs_meet_in_large_keys(spark, cap, blocks):
    rng = random.Random(cap)
    classes = _classes(spark, rng, 1500).selectExpr("*", "node as root")
    for k in (1, 3):
        assert sorted(map(tuple, simhash.candidates(classes, k, cap, blocks).collect())) == [(0, 1, False), (1, 0, False)]
    assert simhash.candidates(classes.withColumn("root", classes.node * 0), 1, cap, blocks).count() == 0


def test_each_names_its_nearest(spark):
    """All within the limit of each other: k are named, and that there are more."""
    df = spark.createDataFrame([(j, j // 2, *[0] * 4, (1 << j) - 1, *[0] * 7) for j in range(12)], ", ".join(f"{c} long" for c in ["node", "root", *[f"w{i}" for i in range(4)], *[f"g{i}" for i in range(8)]]))
    for cap in (1000, 4):
        for k in (1, 3, 20):
            want = {}
            for j in range(12):
                others = sorted((abs(i - j), i) for i in range(12) if i // 2 != j // 2)
                want[j] = ([i for _, i in others[:k]], len(others) > k)
            got: dict = {}
            for r in simhash.candidates(df, k, cap).collect():
                got.setdefault(r.node, ([], r.more))[0].append(r.other)
            assert {j: (sorted(o), m) for j, (o, m) in got.items()} == {j: (sorted(o), m) for j, (o, m) in want.items()}


def test_near_groups_are_those_of_the_exact_similarity(spark):
    rng = random.Random(9)
    rows, sets = [], {}
    for k in range(30):
        base = [f"u{rng.randrange(3000)}" for _ in range(200)]
        for c in range(6):  # about 1.0 down to 0.6
            w = list(base)
            for at in rng.sample(range(0, 200, 8), c):
                w[at] = f"edit{k}x{c}x{at}"
            rows.append((10 * k + c if k else None, " ".join(w)) if c else (10 * k, " ".join(w)))
    rows += [(1000, rows[0][1]), (7, "other words under a number that repeats, and so on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    named = {d: t for d, t in rows if d is not None and d >= 10 and d < 1000}
    sets = {d: set(simhash.shingles(simhash.words(t), 5)) for d, t in named.items()}
    root = {d: d for d in sets}
    for _ in range(6):
        for a in sets:
            for b in range(a - a % 10, a):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    found = lambda *a: {r.doc_id: r.component_id for r in simhash.near_groups(df.repartition(a[0]), *a[1:]).where("doc_id is not null and doc_id <> 7").collect()}
    got = found(1)
    assert got == found(7, 50, 100)  # neither on partitions nor on blocks
    wrong = [d for d in sets if got[d] != root[d]]
    assert len({*root.values()}) > 45 and len(wrong) <= 0.01 * len(sets) and got[1000] == 0
    assert all(root[d] <= got[d] for d in sets)  # nothing linked that is not near


def test_a_group_just_below_the_similarity_makes_no_table_of_its_pairs(spark, monkeypatch):
    """Nearly all pairs of 132 texts are candidates, few are links: no table grows with the pairs, and all links are found."""
    rng = random.Random(21)
    base, rows, made = [f"b{k}" for k in range(200)], [], []
    for k in range(120):
        w = list(base)
        for at in rng.sample(range(200), 3):
            w[at] = f"own{k}x{at}"
        rows.append((k, " ".join(w)))
        if k % 10 == 0:
            w[rng.randrange(200)] = "again"
            rows.append((1000 + k, " ".join(w)))
    sets = {d: set(simhash.shingles(simhash.words(t), 5)) for d, t in rows}
    root = {d: d for d in sets}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert 12 <= len(near) < 1000 and len({*root.values()}) > 20
    whole = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: (out := whole(df), made.append(out.count()))[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()} == root
    assert max(made) <= 32 * len(rows)  # 17,292 ordered pairs
    assert {r.doc_id: r.component_id for r in simhash.near_groups(df.repartition(3), held=4000).collect()} == root  # sets in blocks


def test_every_overlap_at_the_stated_agreement_is_found(spark):
    rng = random.Random(12)
    docs, items = [], []
    for k, n in enumerate([*range(5, 26), 33, 48, 59] * 3):
        items.append([f"i{k}x{j}" for j in range(n)])
        w, size = list(items[-1]), min(n, 20)
        at = rng.randrange(n - size + 1)  # one window agrees as far as it must, nothing else does
        w = [x if at <= j < at + size else "out" for j, x in enumerate(w)]
        for j in rng.sample(range(at, at + size), size * 20 // 100):
            w[j] = "sub"
        docs.append((k, " ".join(["before"] * 25 + w + ["after"] * 25)))
        w[next(j for j in range(at, at + size) if w[j] != "sub")] = "more"
        docs.append((k + 1000, " ".join(["before"] * 25 + w + ["after"] * 25)))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(len(items))}
