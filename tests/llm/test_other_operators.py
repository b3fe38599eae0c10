import datetime
import itertools
import json
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import chat, html_text, pii, url_filter
from skylattice.llm.queries import RULES

F = pii.Feistel(b"test")


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 10**30), st.integers(0, 10**40))
def test_feistel_is_a_permutation_without_fixed_points(n, x):
    x %= n
    y = F.permute(x, n, "t")
    assert 0 <= y < n and y != x and F.permute(y, n, "t", True) == x


CASES = {
    "bob.42@mail8.example.com": "email", "+1 (988) 555-2485": "phone", "+49 30 1234567": "phone", "(555) 123-4567": "phone", "4111 1111 1111 1111": "card", "4785380592391139": "card", "70.123.182.155": "ipv4",
    "123-45-6789": "ssn", "2024-02-29": "date", "25.12.1999": "date", "12/31/2001": "date", "DE89 3704 0044 0532 0130 00": "iban", "GB82WEST12345698765432": "iban",
}


@pytest.mark.parametrize("value", CASES)
def test_values_keep_their_format_and_come_back(value):
    text = f"see {value}, and {value} again"
    new, kinds = pii.replace(text, F)
    assert kinds == [CASES[value]] * 2 and value not in new and len(new) == len(text)
    a, b = re.fullmatch(r"see (.*), and (.*) again", new).groups()
    assert a == b and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", value) or CASES[value] in ("email", "iban")
    assert pii.replace(new, F, True)[0] == text
    assert pii.replace(new, pii.Feistel(b"other"))[0] != new


def test_check_digits_and_calendar_hold():
    rng = random.Random(1)
    for _ in range(200):
        body = "".join(rng.choices("0123456789", k=15))
        body = "4" + body[1:]
        n = body + str(-pii.luhn_sum(body + "0") % 10)
        assert pii.luhn_sum(pii.card(F, n, False)) % 10 == 0
        d = datetime.date.fromordinal(rng.randrange(pii.FIRST_DAY, pii.LAST_DAY)).isoformat()
        datetime.date.fromisoformat(pii.date(F, d, False))


def test_one_date_has_one_pseudonym_in_all_orders():
    for iso in ("2020-12-25", "2020-03-04", "1999-12-12", "2024-02-29"):
        y, m, d = iso.split("-")
        late = [f"{m}/{d}/{y}"] if int(d) > 12 else []
        new = pii.replace(" ".join([iso, f"{d}.{m}.{y}", f"{d}/{m}/{y}", *late]), F)[0].split()
        y, m, d = new[0].split("-")
        assert new == [f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", *[f"{m}/{d}/{y}"][: len(late)]] and new[0] != iso
        assert pii.replace(" ".join(new), F, True)[0].split()[0] == iso


def test_long_secrets_and_many_values():
    for n in (8, 128, 129, 3000):
        value = "".join(random.Random(n).choices("abcXYZ0189", k=n))
        new, kinds = pii.replace(f"password={value} end", F)
        assert kinds == ["secret"] and new[9 : 9 + n] != value and new.endswith(" end") and pii.replace(new, F, True)[0] == f"password={value} end"
        assert all(new[9 + k : 9 + k + 128] != value[k : k + 128] for k in range(0, n, 128))
    began = time.time()
    text = " ".join(f"joe{k}@mail{k % 7}.example.com" for k in range(20_000))
    assert len(pii.replace(text, F)[1]) == 20_000 and time.time() - began < 20


def test_table_round_trip(spark):
    """All documents' values come back with the key, in one pass over the table each way; equal values have one pseudonym."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 8)))
    rows = [(k, " ".join(rng.choice([word(), word(), f" {rng.choice(list(CASES))},"]) for _ in range(rng.randrange(60)))) for k in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    new = pii.pseudonymize(df, b"k")
    back = {r.doc_id: r.text for r in pii.pseudonymize(new.select("doc_id", "text"), b"k", True).collect()}
    assert back == dict(rows)
    seen: dict[str, set[str]] = {}
    for r in new.collect():
        for old, value in zip((dict(rows)[r.doc_id] or "").split(","), (r.text or "").split(",")):
            for case in CASES:
                if old.endswith(f" {case}"):
                    seen.setdefault(case, set()).add(value[-len(case) :])
    assert len(seen) == len(CASES) and all(len(v) == 1 and v != {k} for k, v in seen.items())


@pytest.mark.parametrize("text", ["", "version 3.1.4", "4111 1111 1111 1112", "2023-02-30", "999.1.2.3", "000-12-3456", "chapter 12, page 1234567890", "a@b", "1.2.3.4.5", "x" * 100_000, "1" * 5000])
def test_what_does_not_validate_stays(text):
    assert pii.replace(text, F) == (text, [])


@pytest.mark.parametrize("value, before, after, kind", [
    ("4111 1111 1111 1111", "", " 123", "card"), ("4111111111111111", "", " 12/27", "card"), ("4111 1111 1111 1111", "", " 12", "card"), ("4111111111111111", "12 ", "", "card"), ("4111 1111 1111 1111", "2024-02-29 ", "", "card"),
    ("BE68539007547034", "", " EUR", "iban"), ("BE68 5390 0754 7034", "", " USD", "iban"), ("DE89 3704 0044 0532 0130 00", "", " EUR", "iban"), ("AT611904300234573201", "", " BANK", "iban"), ("+49 30 1234567", "", " 123456789", "phone"),
])
def test_values_before_and_after_other_words(value, before, after, kind):
    new, kinds = pii.replace(f"see {before}{value}{after} again", F)
    assert kind in kinds and value not in new and new.endswith(f"{after} again") and len(new) == len(f"see {before}{value}{after} again")


def test_pseudonyms_on_a_table(spark):
    rows = [(1, "call +1 (988) 555-2485"), (1, "call +1 (988) 555-2485"), (2, None), (None, "a@b.co"), (3, "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_values int")
    got = pii.pseudonymize(df, b"k").collect()
    assert sorted(r.n_values for r in got) == [0, 0, 1, 1, 1] and [r.text for r in got if r.doc_id == 2] == [None]
    same = pii.replace_in(df, b"k")
    assert same.columns == df.columns and {r.text for r in same.collect()} == {r.text for r in got} and same.first().n_values == 5
    assert pii.pseudonymize(df.limit(0)).count() == 0


# --- URL filter -----------------------------------------------------------------------------------

URLS = [
    "http://ththre.example.com/fr/825?page=2", "https://m.x.example.net/en/25#top", "HTTP://A.EXAMPLE.NET/de/1", "http://example.com/de/", "http://x.example.com/de/1", "http://notexample.com/de/1", "https://a.org/fr/", "https://a.org/fr", "http://net/", "http://net",
    "http://sub.net?x=/a", None, "", "no scheme", "//x", "://b.net/a", "http://ÀB.net/Ä", "ftp://example.net/en/http://x.org/fr/", "http://a.b..net/", "http://user@x.net:80/y",
]


def plain(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_verdicts(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[0], "x"), (0, URLS[0], "x")], "page_id long, url string, host string")
    want = sorted((-1 if k is None else k, *map(str, plain(u, RULES))) for k, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])])
    for judged in (url_filter.judge(df, RULES), url_filter.judge_by_join(df, RULES)):
        assert sorted((-1 if r.page_id is None else r.page_id, *map(str, (r.host, r.path, r.rule, r.verdict))) for r in judged.collect()) == want
    assert url_filter.judge(df.limit(0), RULES).count() == 0 and {r.verdict for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_ties_and_long_hosts(spark):
    rules = [("block", "a.b/"), ("allow", "b/c/"), ("block", "x.b/c"), ("allow", "b/ccc")]
    df = spark.createDataFrame([(0, "http://a.b/c/x"), (1, "http://" + "a." * 16_000 + "b/c/"), (2, "http://x.b/ccc"), (3, "http://" + "." * 5000), (4, "http://" + "b" * 100_000 + "/" + "c/" * 10_000)], "page_id long, url string")
    want = {0: "a.b/", 1: "a.b/", 2: "x.b/c", 3: None, 4: None}
    began = time.time()
    for judged in (url_filter.judge(df, rules), url_filter.judge_by_join(df, rules)):
        assert {r.page_id: r.rule for r in judged.collect()} == want
    assert time.time() - began < 20 and len(url_filter.candidates("a." * 100_000 + "b", "/c", [1], [1, 2])) == 2


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda key: len(key) % 3)
    rules = [("block", f"{c}.com/") for c in "abcdefgh"] + [("allow", "org/fr/")]
    a = url_filter.DigestArray(url_filter.build(rules))
    keys = ["a.com/", "h.com/", "zz", "org/fr/", "z.com/"]
    assert [a.strings[i] if i >= 0 else None for i in a.find(keys)] == ["a.com/", "h.com/", None, "org/fr/", None]


# --- HTML -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def weights():
    return html_text.fit(html_text.labelled_pages())


def test_held_out_pages(weights, monkeypatch):
    held = list(html_text.labelled_pages(400, 1234))
    right = {i for i, (p, t) in enumerate(held) if html_text.main_text(p, weights) == t}
    named = {i for i, (p, _) in enumerate(held) if "<article" in p or "<main" in p}
    assert len(right & named) >= 0.9 * len(named) and len(right) >= 0.87 * len(held)
    assert max(v for k, v in weights.items() if k.startswith("tag:")) < 0 and weights["n:related"] < 0 < weights["t:p"]
    flat = weights | {k: 1000 if k == "bias" else 0 for k in weights if k[:2] in ("n:", "t:", "ou", "bi", "in", "li")}
    assert sum(html_text.main_text(p, flat) == t for p, t in held) < 0.2 * len(held)
    monkeypatch.setattr(html_text, "region", lambda scores, words: (0, len(words)))  # no scan: what pages without names lose
    plain = {i for i, (p, t) in enumerate(held) if html_text.main_text(p, weights) == t}
    assert len(right - plain) >= 0.06 * len(held) and len(right) > len(plain)


def test_html_corners(spark, weights):
    cases = {
        "<body><nav><a>menu item</a></nav><article><h1>Title</h1><p>One &amp; two\n three<br>four <b>five<p>Six &lt;7&#33;<script>no <p> here</script><div class='ad'>buy</div><p>End.</article><footer>c</footer>": "Title\n\nOne & two three four five\n\nSix <7!\n\nEnd.",
        '<div class="content with-sidebar"><div id="page-menu"><article class="post ad-free"><p>Kept here.</p><div class="comment-list"><article class="comment">not me</article></div></article></div></div><div class="top-menu">nor me</div>': "Kept here.",
        "<article><p>cut off in a ta<": "cut off in a ta<", "<article><p>cut &am": "cut &am", "<article><p>cut<p class=\"x": "cut", "": "", "<nav>a b c</nav>": "", "plain words only": "plain words only", "<!-- a --><p>b<!-- c": "b", "<p>1 < 2 and 3<4</p>": "1 < 2 and 3<4",
    }
    for page, text in cases.items():
        assert html_text.main_text(page, weights) == text, page
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert len(html_text.main_text(long, weights)) == 20_000 * 11 - 2
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (None, None, "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extract(df).collect()) == ["", "a", "a"] and html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["button", "option", "select", "iframe", "svg", "object", "noscript", "textarea", "template", "title", "label"])
def test_elements_without_end_lose_nothing(weights, name):
    assert "Beta gamma delta." in html_text.main_text(f"<datalist><{name} value=x></datalist><p>Beta gamma delta.</p>", weights)
    assert "Beta gamma delta." in html_text.main_text(f"<{name}><p>Beta gamma delta.</p><p>More words.", weights)


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<p>" * 100_000, '<a "' * 50_000, '<a ">"' * 50_000 + "'", "<svg>" * 50_000, "<article>" * 50_000, "<" * 200_000, "<!--" * 50_000, "<p class=" + "a-" * 100_000 + ">"], ids=lambda p: p[:8])
def test_time_is_linear(weights, page):
    began = time.time()
    assert html_text.main_text("<p>Alpha beta.</p>" + page, weights).startswith("Alpha beta.")
    assert time.time() - began < 10


@given(st.lists(st.tuples(st.sampled_from(["w", "t:p", "t:div"]), st.integers(0, 5), st.integers(-3000, 3000)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_region_is_the_best_of_all(rows):
    words, s = [n if k == "w" else 0 for k, n, _ in rows], html_text.scores([(k, "x", n if k == "w" else 0, w) for k, n, w in rows], 50, 100)
    best = max([0, *(sum(s[a:z]) for a in range(len(s)) for z in range(a + 1, len(s) + 1))])
    a, z = html_text.region(s, words)
    assert sum(s[a:z]) <= best and (sum(s[a:z]) == best or min(s) <= 0 and not any(words) or any(k != "w" and w > 0 for k, _, w in rows))


def test_query_against_all_spans(spark, weights):
    """The text by trying every span of the page, each word scored by listing the elements around it."""

    def plain(page):
        rows = html_text.typed(page, weights)
        s = [w * n * 1000 if w > 0 else weights["lean:word"] * int(w * (1 + math.log(n))) if n else weights["lean:tag"] * w if k != "w" else 0 for k, _, n, w in rows]
        sums = [0, *itertools.accumulate(s)]
        spans = [(a, z) for a in range(len(s)) for z in range(a + 1, len(s) + 1) if rows[z - 1][2]]
        a, z = max(spans, key=lambda x: sums[x[1]] - sums[x[0]], default=(0, 0))
        if not spans or sums[z] <= sums[a]:
            return ""
        out = "".join("\0" if k[2:] in html_text._BLOCK else " " if k == "t:br" or k == "w" and not n else t if k == "w" and w > 0 else "" for k, t, n, w in rows[a:z])
        return "\n\n".join(x for x in (" ".join(x.split()) for x in out.split("\0")) if x)

    pages = [(i, "u", p) for i, (p, _) in enumerate(html_text.labelled_pages(60, 99))]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), weights).collect()}
    assert got == {i: (plain(p), len(plain(p))) for i, _, p in pages}
    assert sum(bool(t) for t, _ in got.values()) >= 57


# --- chat -----------------------------------------------------------------------------------------

TOOLS = '<tools>[{"name":"add","parameters":{"type":"object","properties":{"a":{"type":"integer"},"b":{"type":"integer","minimum":0}},"required":["a","b"],"additionalProperties":false}}]</tools>'


def call(i, name="add", **args):
    return f'<tool_call>{json.dumps({"id": i, "name": name, "arguments": args})}</tool_call>'


def test_tool_calls(spark):
    rows = [
        (1, 0, "system", TOOLS), (1, 1, "user", "sum"), (1, 2, "assistant", "ok " + call("c1", a=1, b=2) + call("c2", a={"$ref": "c1"}, b=1)), (1, 3, "tool", '{"tool_call_id":"c2","content":9}'), (1, 4, "tool", '{"content":{"y":1,"x":2},"tool_call_id":"c1"}'),
        (1, 5, "tool", '{"tool_call_id":"nope","content":1}'), (1, 6, "assistant", call("c3", b=-1) + call("c4", "mul", a=1) + "<tool_call>broken</tool_call>"),
        (2, 0, "assistant", call("c1", a={"$ref": "c9"}, b=1) + call("c9", a={"$ref": "c1"}, b=1)), (3, 0, "user", None), (None, 0, "user", 'é "q"\n'), (3, None, None, ""), (3, 0, "user", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message string")
    got = chat.format_chat(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    r = by[1, 2]
    assert (r.n_calls, r.n_linked, r.n_valid) == (2, 2, 2) and r.position == 3
    m = json.loads(r.message)
    assert m["content"] == "ok " and [c["id"] for c in m["tool_calls"]] == ["c1", "c2"] and r.message == chat.canonical(m)
    assert by[1, 3].position == 4 and by[1, 4].position == 4 and '{"x":2,"y":1}' in by[1, 4].message
    assert by[1, 5].n_orphans == 1 and (by[1, 6].n_calls, by[1, 6].n_valid, by[1, 6].n_broken) == (2, 0, 1)
    assert by[2, 0].position == 0 and by[2, 0].n_linked == 0
    assert by[None, 0].message == '{"content":"é \\"q\\"\\n","role":"user"}'
    assert chat.format_chat(df.limit(0)).count() == 0


@pytest.mark.parametrize("value,spec,ok", [(1, {"type": "integer"}, True), (1.5, {"type": "integer"}, False), (True, {"type": "number"}, False), ([1, "a"], {"items": {"type": ["integer", "string"]}, "maxItems": 2}, True), ("ab", {"pattern": "^a", "maxLength": 1}, False), ({"a": 1}, {"properties": {"a": {"enum": [2]}}}, False), (None, {"type": "null"}, True), ({"$ref": "x"}, {"type": "integer"}, True), (3, False, False)])
def test_schema_check(value, spec, ok):
    assert chat.valid(value, spec) is ok


OPTIONAL = {"anyOf": [{"type": "integer"}, {"type": "null"}]}


@pytest.mark.parametrize("value, spec, ok", [
    ("x", OPTIONAL, False), (None, OPTIONAL, True), (3, {"oneOf": [{"minimum": 1}, {"maximum": 5}]}, False), ("a", {"allOf": [{"type": "string"}, {"minLength": 2}]}, False), (1, {"not": {"type": "integer"}}, False),
    ({"a": "x"}, {"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}}}, False), ({"a": {"a": 1}}, {"additionalProperties": {"$ref": "#"}, "type": "object"}, False), (5, {"exclusiveMinimum": 5}, False), (5, {"exclusiveMaximum": 5}, False),
    (0.3, {"multipleOf": 0.1}, True), (0.35, {"multipleOf": 0.1}, False), ([1, 1.0], {"uniqueItems": True}, False), ([1, True], {"uniqueItems": True}, True), ({"x1": "s"}, {"patternProperties": {"^x": {"type": "integer"}}}, False),
    (["s", 1], {"prefixItems": [{"type": "string"}], "items": {"type": "string"}}, False), ("2023-02-30", {"format": "date"}, False), ("2024-02-29", {"format": "date"}, True), (True, {"enum": [1]}, False), ({"a": 1}, {"dependentRequired": {"a": ["b"]}}, False),
    (1, {"unevaluatedItems": False}, None), ("x", {"format": "own"}, None), (1, {"properties": {"a": {"minimun": 2}}}, None), ("x", {"pattern": "("}, None), (1, {"$ref": "other.json"}, None), (1, {"$ref": "#"}, None),
])
def test_schema_keywords(value, spec, ok):
    assert chat.valid(value, spec) is ok


def test_verdicts_in_a_message(spark):
    tools = [{"name": "add", "parameters": {"properties": {"a": OPTIONAL}}}, {"name": "own", "parameters": {"unevaluatedProperties": False}}]
    calls = [call(1, a="x"), call(2, a=None), call(3, "own", a=1)]
    df = spark.createDataFrame([(1, 0, "system", f"<tools>{json.dumps(tools)}</tools>"), (1, 1, "assistant", "".join(calls))], "conv_id long, turn long, role string, text string")
    row = chat.format_chat(df).where("turn = 1").first()
    assert row.n_valid == 1 and [c["valid"] for c in json.loads(row.message)["tool_calls"]] == [False, True, None]


@pytest.mark.parametrize("spec", [{"required": True}, {"pattern": "("}, {"minimum": "0"}, {"enum": 5}, {"properties": [1]}, {"type": [{}]}, {"type": {}}, {"anyOf": 3}, {"items": 7}, {"format": []}, {"pattern": "(a+)+$"}, {"uniqueItems": True, "items": 3}, {"$ref": 5}, {"multipleOf": 0}, [], 3, None, "x"], ids=str)
def test_no_schema_ends_a_job(spec):
    for value in ({"a": 1}, 10**400, 1e308, "a" * 40 + "b", [1, [2], {"a": 1}] * 1000, None, True, {"$refs": []}):
        assert chat.valid(value, spec) in (True, False, None)


@pytest.mark.parametrize("text", ['{"id":1,"name":"add","arguments":{"a":NaN}}', '{"id":1,"name":"add","arguments":{"a":1e999}}', '{"id":"\\ud800","name":"\\udfff","arguments":{"a":"\\ud800"}}', '{"id":1,"name":"add","arguments":' + "[" * 5000 + "]" * 5000 + "}", '{"id":1,"name":"add","arguments":{"a":' + "9" * 400 + "}}", '{"id":1,"name":"add","arguments":{"a":' + "9" * 5000 + "}}", "null", "[]", "{", '{"id":[1],"name":"x","arguments":"{"}'], ids=lambda t: t[:40])
def test_no_message_ends_a_job(spark, text):
    df = spark.createDataFrame([(1, 0, "system", TOOLS), (1, 1, "assistant", f"<tool_call>{text}</tool_call>"), (1, 2, "tool", '{"tool_call_id":"\\ud800","content":"\\ud800"}')], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in chat.format_chat(df).collect()}
    assert got[1].n_calls + got[1].n_broken == 1 and "NaN" not in (json.dumps(json.loads(got[1].message).get("tool_calls", 0))) and json.loads(got[2].message)["tool_results"][0]["tool_call_id"] == "\\ud800"


def plain_chat(rows):
    """The rows of format_chat, conversation by conversation and message by message."""
    parsed = [(c, t, r, chat.parse(r, x)) for c, t, r, x in rows]
    out = []
    for conv in {c for c, *_ in parsed}:
        mine = [(i, t, r, p) for i, (c, t, r, p) in enumerate(parsed) if c == conv]
        first = lambda x: (x[1] is not None, x[1] or 0, x[0])
        tools, owner, answer, at, uses = {}, {}, {}, {}, {}
        for i, t, _, p in sorted(mine, key=first):
            for x in p["tools"]:
                tools.setdefault(x["name"], set()).add(x["spec"])
            for c in p["calls"]:
                if c["id"] is not None:
                    owner.setdefault(c["id"], (i, c["k"]))
                    at[c["id"]] = min(at.get(c["id"], 10**9), t or 0)
                    uses.setdefault(c["id"], set()).update(c["refs"])
            for x in p["results"]:
                answer.setdefault(x["id"], t)
        level: dict[str, int] = {}
        while fresh := [c for c in at if c not in level and all(r in level or r not in at for r in uses[c])]:
            level |= {c: max([at[c], *(level[r] + 1 for r in uses[c] if r in at)]) for c in fresh}
        level |= {c: at[c] for c in at if c not in level}
        for i, t, role, p in mine:
            m: dict = {"role": role, "content": p["content"]}
            calls = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["args"]), "valid": chat.valid(json.loads(c["args"]), json.loads(*tools[c["name"]])) if len(tools.get(c["name"], ())) == 1 else False, "linked": c["id"] is not None and owner[c["id"]] == (i, c["k"]) and c["id"] in answer} for c in p["calls"]]
            results = [{"tool_call_id": x["id"], "content": json.loads(x["content"]), "linked": x["id"] in owner} for x in p["results"]]
            m |= ({"tool_calls": calls} if calls else {}) | ({"tool_results": results} if results else {})
            levels = [level[c["id"]] for c in calls if c["id"] is not None] + [level[x["tool_call_id"]] + 1 for x in results if x["linked"]]
            position = max([t, *levels], default=None) if t is not None else max(levels, default=None)
            out.append((conv, t, position, role, len(calls), sum(c["linked"] for c in calls), sum(c["valid"] is True for c in calls), len(results), sum(not x["linked"] for x in results), p["broken"], chat.canonical(m)))
    return out


def test_chat_against_a_plain_version(spark):
    rng, rows = random.Random(4), []
    for conv in [*range(25), -1, None]:
        ids = [f"c{k}" for k in range(8)]
        for turn in [*range(rng.randint(1, 9)), *([None] if rng.random() < 0.2 else [])]:
            role, text = rng.choice(["user", "assistant", "tool"]), rng.choice(["", "é words ", "<tools>[]</tools>"])
            if role == "tool":
                text = rng.choice([json.dumps({"content": rng.randint(0, 9), "tool_call_id": rng.choice(ids)}), "plain", "<tool_result>{}</tool_result>"])
            elif rng.random() < 0.7:
                text += "".join(call(rng.choice([*ids, None]), rng.choice(["add", "mul"]), a=rng.choice([1, "x", {"$ref": rng.choice(ids)}]), b=1) for _ in range(rng.randint(0, 3)))
            text += f"<tool_result>{json.dumps({'tool_call_id': rng.choice(ids), 'content': [1]})}</tool_result>" if rng.random() < 0.2 else ""
            rows += [(conv, turn, role, rng.choice([text, text, text, TOOLS + text, None]))] * (1 if rng.random() < 0.9 else 2)
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1).sortWithinPartitions("conv_id", "turn")).collect()
    # messages of one turn own by their place, which a table does not have: such conversations are compared by their counts
    alone = {c for c, *_ in rows if len({t for x, t, *_ in rows if x == c}) == sum(x == c for x, *_ in rows)}
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got if r.conv_id in alone), key=key) == sorted((r for r in plain_chat(rows) if r[0] in alone), key=key) and len(alone) > 10 and {None, -1} & alone
    assert len(got) == len(rows)


def test_levels_have_no_bound(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_DEPTH", 2, raising=False)
    calls = spark.createDataFrame([(1, f"c{k}", [f"c{k + 1}"] if k < 5 else [], 0) for k in range(6)], "conv_id long, id string, refs array<string>, at long")
    assert {(r.id, r.level, r.cyclic) for r in chat.levels(calls).collect()} == {(f"c{k}", 5 - k, False) for k in range(6)}
