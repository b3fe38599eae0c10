import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import suffix_automaton as sa
from tests.llm import brute

TEXT = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


def longest(text, refs):
    out = []
    for i in range(len(text)):
        n = 0
        while n <= i and any(text[i - n : i + 1] == r[k : k + n + 1] for r in refs for k in range(len(r))):
            n += 1
        out.append(n)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4), TEXT)
def test_matching_statistics(refs, text):
    assert sa.Automaton(refs).statistics(text).tolist() == longest(text, refs)


def test_spans_of_a_reference_go(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(50)]
    prose = lambda n: rng.choices(vocab, k=n)
    refs = [prose(n) for n in (10, 40, 80)] + [[]]
    docs = [prose(30) + refs[k % 3][: rng.randrange(80)] + prose(20) for k in range(30)] + [[]]
    least = 12
    want = []
    for d in docs:
        cover = [False] * len(d)
        for a in range(len(d) - least + 1):
            if any(d[a : a + least] == r[k : k + least] for r in refs for k in range(len(r))):
                cover[a : a + least] = [True] * least
        want.append((len(d), sum(cover), " ".join(x for x, c in zip(d, cover) if not c)))
    df = spark.createDataFrame([(k, " ".join(d), "x") for k, d in enumerate(docs)] + [(None, None, "x")], "doc_id long, text string, n_words string")
    ref = spark.createDataFrame([(" ".join(r),) for r in refs] + [(None,)], "text string")
    for shard in (20, 100_000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in sa.remove_reference(df, ref, least, shard).collect()}
        assert [got[k] for k in range(len(docs))] == want and got[None] == (0, 0, "")
    assert sa.remove_reference(df, ref.limit(0), least).where("n_removed > 0").count() == 0 and len(brute.corpus()) > 0
