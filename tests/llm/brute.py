"""Plain versions of the operators, and a small table with every awkward case."""

import hashlib
import random
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    """Rows (doc_id, text, lang, source): nulls, empties, blanks, copies, near copies, shared passages, repeated ids."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(r.choices(vocab, k=n))
    passage = prose(60)
    rows = [(k, prose(r.choice([3, 20, 60, 150, 400])), r.choice(["en", "de"]), f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s0") for k in range(10)]  # copies
    for k in range(10):  # near copies
        w = rows[20 + k][1].split()
        w[len(w) // 2] = "changed"
        rows.append((200 + k, " ".join(w), "en", "s1"))
    rows += [(300 + k, prose(30) + " " + passage + "\n" + prose(10), "en", "s2") for k in range(6)]
    line = prose(40)
    rows += [(400, "\n".join([line] * 5), "en", "s0"), (401, None, None, None), (402, "", "en", None), (403, " \t\n\r\x0b\x0c ", "en", "s0"), (404, "one", None, "s0"), (405, "İı ß 漢字 \x1c x\x1c  y \xa0\xa0 <|endoftext|> z" * 3, "de", "s1")]
    rows += [(406, prose(6000), "en", "s0"), (407, "#$% <a|b> " * 60, "en", "s0"), (None, prose(50), "en", "s1"), (None, rows[0][1], "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3]), (408, "x" * 5000, "en", "s1")]
    return rows


def frame(spark, rows=None):
    rows = corpus() if rows is None else rows
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: "clash" for c in ("n_words", "kept", "fp", "key", "row", "words", "n", "block", "length", "spans")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in clash.items()})


def words(t):
    return WORD.findall(t or "")


def counts(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
    tri = list(zip(w, w[1:], w[2:]))
    c, cover = Counter(tri), set()
    for k, x in enumerate(tri):
        if c[x] > 1:
            cover |= {k, k + 1, k + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def removed(rows, n):
    """Per row (words, removed, sha256) of all-against-all windows."""
    docs = [words(t) for _, t, *_ in rows]
    c = Counter(tuple(w[k : k + n]) for w in docs for k in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if c[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(t, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words(low)
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, reach):
    """Component number of each fingerprint by all pairs."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = sorted(parent)
    for i, a in enumerate(f):
        for b in f[i + 1 :]:
            if (a ^ b).bit_count() <= reach:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {x: find(x) for x in f}
