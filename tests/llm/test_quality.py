import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from prismgrid.llm import quality
from prismgrid.sources.tables import table

WORDS = [{"lang": "en", "word": w} for w in "the a of to and is on in that it for with was".split()]
CASES = {
    "The report was sent to the team, and it is on the page that we use.": "prose",
    "The form was hidden in the first\nversion of the page, and it is\nshown to all of the members now.": "prose",
    "<p>The report was sent to the team, and it is on the page.</p>": "prose",
    "- one item\n- another item\n* third": "list",
    "1) First thing\n2) Second thing\n(3) Third thing": "list",
    "Billing – quote\ntoolbar: label\ndata table\nVault ticket 9": "list",
    "The list was made for the team in that week.\n• one\n• two\n• three": "list",
    "| a | b |\n|---|---|\n| 1 | 2 |": "table",
    "name,size,kind\nx,1,true\ny,2,": "table",
    "a\tb\n1\t\n\t2": "table",
    "<tr><td>a</td><td>b</td></tr>\n<tr><td>1</td><td>2</td></tr>": "table",
    "lorem " * 200: "junk",
    "x" * 300: "junk",
    "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5": "junk",
    "}{<>|/%$&=~^*}{<>|/%$&=~^*}{<>|/%$": "junk",
    "lzhpsrlgfkn rflvht vw htz wrxwbmpnzmnl cl twkhl tzswlf whnfrtcf": "junk",
    "c5 40 c6 8b b1 a6 08 4e 27 5b 64 c3 55 b3 46 1a": "junk",
    "function k(a,b){return k[a]||b&&!k.a};function m(c,d){return m[c]||d&&!m.c}": "junk",
}


def kinds(frame, rows, words=WORDS):
    out = quality.classify_texts(frame("documents", rows, ", kind string, n int, words string"), frame("common_words", words))
    return out.collect()


def test_kinds_and_reasons(frame):
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(CASES)]
    got = {r.doc_id: r for r in kinds(frame, rows)}
    assert {t: got[i].kind for i, t in enumerate(CASES)} == CASES
    assert all(bool(r.reasons) == (r.kind != "prose") for r in got.values())


def test_statistics(frame):
    (r,) = kinds(frame, [{"doc_id": 1, "text": "The cat is on it.\n\nGo, now"}])
    assert (r.n_words, r.n_lines) == (7, 2)
    assert r.mean_word_length == pytest.approx((3 + 3 + 2 + 2 + 2 + 2 + 3) / 7)
    assert r.symbol_ratio == pytest.approx(2 / 19)
    assert r.punctuated_lines == 0.5 and r.common_share == pytest.approx(4 / 7)


def test_published_rules_are_recorded(frame):
    texts = {
        1: "The report was sent to the team, and it is on the page that we have. " * 5,
        2: "- a\n- b\n- c",
        3: "Wait for it...\nAnd then that...",
        4: "# # # {x}",
        5: "the same line of the page\n" * 4,
        6: None,
    }
    got = {r.doc_id: set(r.published) for r in kinds(frame, [{"doc_id": i, "text": t} for i, t in texts.items()])}
    assert got[1] == set() and got[6] == set()
    assert {"bullet_lines_0.9", "two_stop_words", "punctuated_lines_0.12", "short_lines_0.67", "word_count_50_to_100000"} <= got[2]
    assert "ellipsis_lines_0.3" in got[3] and {"curly_bracket", "hash_or_ellipsis_per_word_0.1"} <= got[4]
    assert {"duplicate_lines_0.3", "duplicate_line_characters_0.2"} <= got[5]


PIECES = ["the", "Über", "don't", "a.b", " ", "  ", "\n", "\r\n", "\u2028", "https://x.example/a-b", "日本", "123", "...", "!", "|", "e\u0301"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=5))
def test_counts_against_patterns(texts):
    common = {"the", "über"}
    got = quality.measure(texts, quality._known(tuple(sorted(common))))
    word = regex.compile(r"[\p{L}\p{N}]+(?:['’.-][\p{L}\p{N}]+)*")
    for i, text in enumerate(texts):
        words = word.findall(regex.sub(r"https?://[^ \t\n\x0b\f\r]+", " ", text))
        lines = [x for x in regex.split(r"[\n\r\x0b\x0c\x85\u2028\u2029]", text) if regex.search(r"[^\s\p{Z}\p{C}]", x)]
        grams = [tuple(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 12 else []
        assert (got["n_words"][i], got["n_lines"][i]) == (len(words), len(lines))
        assert got["common_share"][i] == pytest.approx(sum(w.lower() in common for w in words) / max(1, len(words)))
        assert got["mean_word_length"][i] == pytest.approx(sum(map(len, words)) / max(1, len(words)))
        assert got["duplicate_lines"][i] == pytest.approx((len(lines) - len(set(lines))) / max(1, len(lines)))
        if grams:
            assert got["distinct_share"][i] == pytest.approx(len(set(grams)) / len(grams))


def test_slices_and_long_texts_give_the_same(monkeypatch):
    texts = ["- a\n- b", "", "The cat is on it. " * 40, "x" * 90, "a,b,c\nd,e,f"]
    whole = quality.measure(texts, quality._known(("the",)))
    monkeypatch.setattr(quality, "SLICE_POINTS", 50)
    parts = [quality.measure(t, quality._known(("the",))) for _, t in quality._slices(list(range(5)), texts)]
    for name, values in whole.items():
        assert np.array_equal(np.concatenate([p[name] for p in parts]), values, equal_nan=True), name


def test_null_blank_repeated_long_and_empty(frame):
    rows = [{"doc_id": 1}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": " \n\t"}, {"doc_id": 4, "text": "x"}, {"doc_id": 4, "text": "x"}, {"text": "The end of it is that."}]
    assert [r.kind for r in kinds(frame, rows)] == ["prose"] * 6
    long = " ".join(f"The part {i} of it was sent to team {i * 7}, and it is on page {i * 3}." for i in range(3000))
    assert kinds(frame, [{"doc_id": 1, "text": long}])[0].kind == "prose"
    assert kinds(frame, []) == []
    assert kinds(frame, [{"doc_id": 1, "text": "- a\n- b\n- c"}], words=[])[0].kind == "list"


def test_labelled_samples(spark, data):
    rows = table(spark, data, "text_labels").selectExpr("cast(sample_id as bigint) as doc_id", "text", "kind as truth")
    got = quality.classify_texts(rows.select("doc_id", "text"), table(spark, data, "common_words")).join(rows.select("doc_id", "truth"), "doc_id")
    assert got.where("kind = truth").count() >= 0.97 * rows.count()
