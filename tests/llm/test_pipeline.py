"""The pipeline, stage by stage, against plain versions on a small corpus."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from skylattice.llm import common, pii, quality
from tests.llm import brute

LIB = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def tables():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: rng.choices(vocab, k=n)
    items = [prose(n) for n in (30, 40, 50)]
    rows = []
    for k in range(260):
        w = prose(rng.randrange(60, 300))
        kind = k % 13
        if kind == 1:
            w = [x + "###" for x in w]
        elif kind == 2:
            w = prose(20)
        elif kind == 3:
            w = w[:10] * 30
        elif kind == 4:
            w[5:5] = items[k % 3]
        elif kind == 5:
            w[7:7] = ["mail", f"joe.{k}@mail{k % 7}.example.com", "card", "4785380592391139"]
        elif kind == 6 and rows:
            w = rows[-1][1].split()
        elif kind == 7:
            w = rows[-3][1].split()
            w[len(w) // 2] = "edited"
        rows.append((k, " ".join(w), ["en", "de"][k % 2], f"s{k % 4}"))
    rows += [(900, None, "en", "s0"), (901, "", None, None), (902, " ", "en", None)]
    return rows, items


def kept_by_rules(rows):
    """Plain thresholds: exact quantiles of the same integer ratios."""
    stat, groups = {}, defaultdict(list)
    for d, t, lang, source in rows:
        c = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), brute.counts(t)))
        c["n_lines"] = len([x for x in (t or "").split("\n") if brute.WORD.search(x)])
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        ratios = {n: c[a] * s // c[b] if c[b] else 0 for n, a, b, s, _ in quality.RATIOS}
        stat[d] = failed, ratios, lang, source
        if not failed:
            for key in ((lang, source), (lang,), ()):
                groups[key].append(ratios)
    quantile = lambda v, p: sorted(v)[-(-len(v) * p // 100) - 1]
    out = set()
    for d, (failed, ratios, lang, source) in stat.items():
        group = next((g for k in ((lang, source), (lang,)) if len(g := groups[k]) >= quality.LEAST_GROUP), groups[()])
        fine = not failed
        for name, _, _, _, slack in quality.RATIOS:
            low, mid, high = (quantile([r[name] for r in group], p) for p in (quality.LOW, 50, quality.HIGH))
            fine &= ratios[name] <= high + quality.SPREAD * (high - mid) + slack and (name != "mean_word_length" or ratios[name] >= low - quality.SPREAD * (mid - low) - slack)
        if fine:
            out.add(d)
    return out


def first_of_groups(rows):
    sets = {}
    for d, t, *_ in rows:
        w = brute.words(t.lower())
        sets[d] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {find(d) for d in sets}


def test_stages_against_plain_versions(spark, tmp_path):
    rows, items = tables()
    spark.createDataFrame([(*r, len(r[1] or ""), "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    columns, by, got = docs.columns, {r[0]: r for r in rows}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            docs = common.written(docs)
            assert docs.columns == columns, name
            got.append({r.doc_id: r.text for r in docs.collect()})
    rules = kept_by_rules(rows)
    assert set(got[0]) == rules and 100 < len(rules) < 260
    first = first_of_groups([by[d] for d in sorted(rules)])
    assert set(got[1]) == first and len(first) < len(rules)
    clean = {d for d in first if not any(f" {' '.join(i)} " in f" {by[d][1]} " for i in items)}
    assert set(got[2]) == clean and len(clean) < len(first)
    f = pii.Feistel(pii.DEMO_KEY)
    assert got[3] == {d: pii.replace(by[d][1], f)[0] for d in clean} and any(got[3][d] != by[d][1] for d in clean)
    assert not any("4785380592391139" in t for t in got[3].values())
    want = Counter()
    for d, t in got[3].items():
        ids = np.array(LIB.encode(t, add_special_tokens=False).ids + [2], dtype="<u4")
        first_piece = len(ids) % 1024 or 1024
        cuts = [0, *range(first_piece, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    out = docs.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    room = Counter()
    for r in out:
        room[r.sequence_id] += r.length
    plain: list[int] = []  # best fit decreasing
    for r in sorted(out, key=lambda r: -r.length):
        fits = [k for k, v in enumerate(plain) if v + r.length <= 1024]
        if fits:
            plain[max(fits, key=lambda k: plain[k])] += r.length
        else:
            plain.append(r.length)
    assert max(room.values()) <= 1024 and len(room) <= len(plain)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
