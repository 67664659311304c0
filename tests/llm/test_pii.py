import itertools

import numpy as np
import pytest

from prismgrid.llm import crf, pii
from prismgrid.sources.tables import table

NAMES = [(h + t, k) for k, heads, tails in (("given", ("Jor", "Mar", "Syl", "Dal"), ("pera", "wyn", "tol", "dane")), ("family", ("Mol", "Pell", "Lath", "Ombr"), ("moor", "berg", "akis", "etti"))) for h, t in itertools.product(heads, tails)]
SAMPLES = [
    (1, "Assigned to Jorpera Molmoor", "person_name", 12, 27),
    (2, "Lot 819-45-2082", None, None, None),
    (3, "SSN 844-53-6785", "id_number", 4, 15),
    (4, "Call 312.555.0182", "phone", 5, 17),
]


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(SAMPLES, NAMES)


CASES = {
    "Assigned to Sylwyn A. Pellberg-Lathakis, reachable on +33 1 99 00 32 63.": ["Sylwyn A. Pellberg-Lathakis", "+33 1 99 00 32 63"],
    "LATHETTI, DALTOL (you)": ["LATHETTI, DALTOL"],
    "Shared with Marwyn Ombrakis, Syltol Molberg and 3 others": ["Marwyn Ombrakis", "Syltol Molberg"],
    "contact M. Jordane Molakis": ["Jordane Molakis"],
    "Holder M. Pelletti; issued 12.04.2021": ["M. Pelletti"],
    "mailto:jorwyn.molmoor+crm@mail.example.org": ["jorwyn.molmoor+crm@mail.example.org"],
    "marpera at vellum-yard dot test": ["marpera at vellum-yard dot test"],
    "tel:(415) 555-0108": ["(415) 555-0108"],
    "Ticket 870-49-2021 was linked": [],
    "Ref. 41 901 224 107": [],
    "National ID 41 901 224 107": ["41 901 224 107"],
    "Passport no. G43654058": ["G43654058"],
    "Deliver to Flat 3, 47 Copperfield Rd, Westerby": ["Flat 3, 47 Copperfield Rd, Westerby"],
    "at Gerberweg 182 b, 63241 Neuwiesen; ring": ["Gerberweg 182 b, 63241 Neuwiesen"],
    "58 bis rue des Tilleuls, 31261 Saint-Aubrac": ["58 bis rue des Tilleuls, 31261 Saint-Aubrac"],
    "East Lane 9": [], "Build 2024.41.2 replaced ports 7071 7072": [], "logo@2x.png": [], "": [],
}


def test_items(tagger):
    for text, expect in CASES.items():
        (items,) = tagger.find([text])
        assert [text[a:b] for a, b, _ in items] == expect, text


def test_frame_rows_and_placeholders(frame, tagger):
    t, n = "Jorpera Molmoor called", "Ask Marwyn Pellberg"
    rows = [
        {"element_id": 1, "text": t, "accessible_name": n}, {"element_id": 1, "text": t, "accessible_name": n},
        {"element_id": 2, "text": None, "accessible_name": ""}, {"element_id": None, "text": t}, {"element_id": 3, "text": "Save"},
    ]
    e = frame("elements", rows, ", start_pos int, kind string")
    got = {tuple(r) for r in pii.find_items(e, tagger).collect()}
    assert got == {(1, "text", "person_name", 0, 15), (1, "accessible_name", "person_name", 4, 19)}
    clean = {(r.element_id, r.text, r.accessible_name) for r in pii.redact_fields(e, tagger).collect()}
    assert clean == {(1, "<PERSON_NAME> called", "Ask <PERSON_NAME>"), (2, None, ""), (None, "<PERSON_NAME> called", None), (3, "Save", None)}
    assert pii.find_items(frame("elements", []), tagger).count() == 0


def test_very_long_text_is_read_whole(tagger):
    text = "The page was loaded again. " * 3000 + "Call 312.555.0182 for Jorpera Molmoor."
    (items,) = tagger.find([text])
    assert [text[a:b] for a, b, _ in items] == ["312.555.0182", "Jorpera Molmoor"]


# Names, sentences and order that none of the rules, weights and labelled samples were made from.
UNSEEN = ["Okafor", "Nakamura", "Lindqvist", "Abernathy", "Castellanos", "Whitcombe", "Dragomir", "Sorensen", "Mbeki", "Fitzroy"]
FORMS = [
    "Dr. {0} opened the case on Monday. Much later the note was closed by {0} and sent to the team.",
    "We were told by Mrs. {0} that the import had failed twice; when asked again, {0} blamed the proxy.",
    "Prof. {0} is on leave until the audit ends. Anything that is urgent still goes to {0} first.",
    "Ask Ana {0} whether the queue is stuck before you restart it, or leave a message with {0} instead.",
]


@pytest.fixture(scope="module")
def fitted(spark, data):
    rows = table(spark, data, "pii_labels").orderBy("sample_id", "start_pos").collect()
    names = [(r.name_part, r.part_kind) for r in table(spark, data, "person_names").collect()]
    short = [("Ana", "given"), ("Bo", "given"), ("Kim", "family"), ("Li", "family")]
    return pii.Tagger([(r.sample_id, r.text, r.kind, r.start_pos, r.end_pos) for r in rows], [*names, *short])


def test_links_find_later_mentions_of_unseen_names(fitted):
    tagger, agree = fitted, fitted.field.agree.copy()

    def recall():
        tagger.memory.clear()
        hits = total = wrong = 0
        for form in FORMS:
            for name in UNSEEN:
                text = form.format(name)
                found = [text[a:b] for a, b, k in tagger.find([text])[0] if k == "person_name"]
                good = [f for f in found if f in (name, f"Ana {name}")]
                hits, total, wrong = hits + len(good), total + text.count(name), wrong + len(found) - len(good)
        return hits / total, wrong

    with_links, wrong = recall()
    assert with_links >= 0.9 and wrong == 0
    tagger.field.agree[:] = 0
    assert recall()[0] <= 0.5
    tagger.field.agree[:] = agree
    tagger.memory.clear()
    # A title alone is not enough: things are called so, too.
    for text in ("Mr. Import runs at night and skips what is open.", "Dr. Route Rechecks Each Batch And Route"):
        assert tagger.find([text]) == [[]]


def test_short_known_names(fitted):
    for text, name in {"Assigned to Ana Kim": "Ana Kim", "written by Bo Li, then closed": "Bo Li"}.items():
        assert [text[a:b] for a, b, _ in fitted.find([text])[0]] == [name]


def test_links_reach_over_a_long_text(fitted):
    text = "Dr. Nakamura was here. " + "The list was loaded again and is fine. " * 400 + "Then Nakamura left."
    (items,) = fitted.find([text])
    assert [text[a:b] for a, b, _ in items] == ["Nakamura"] * 2


def test_plain_texts_are_proven_outside(tagger):
    assert tagger.quiet
    token = tagger.field.weights[pii.FEATURES.index("token")]
    assert not tagger.field.stays_outside(token + np.array([0, 9, 9] + [0] * 8))
    rest = tagger.field.decode([[[0]] * 50], np.zeros((0, 3), np.int64))[0]
    assert not rest.any()


def test_without_samples_and_names(frame):
    bare = pii.Tagger([], [])
    assert [k for _, _, k in bare.find(["write to a.b@c.example"])[0]] == ["email"]


def brute(model, features, edges):
    unary, lengths = model.scores([features])
    n, k = lengths[0], len(model.labels)
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = unary[0, range(n), y].sum() + model.first[y[0]] + sum((model.steps + model.closed)[a, b] for a, b in zip(y, y[1:], strict=False))
        s += sum(model.bond()[y[a], y[b]] for _, a, b in edges)
        total[range(n), y] += np.exp(s)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("edges", "tolerance"), [([], 1e-9), ([(0, 0, 3)], 0.02)])
def test_marginals_against_enumeration(edges, tolerance):
    rng = np.random.default_rng(3)
    model = crf.SkipChain(["a", "b"], 4)
    model.weights, model.steps, model.agree = rng.normal(size=(4, 5)), rng.normal(size=(5, 5)), np.array([0.2, 0.8, 0.5])
    features = [[0], [1, 2], [3], [0, 3]]
    unary, lengths = model.scores([features])
    _, ahead, behind, _ = model.infer(unary, lengths, np.array(edges, np.int64).reshape(-1, 3))
    belief = ahead + behind
    belief = np.exp(belief - crf.logsumexp(belief, 2)[:, :, None])[0]
    assert np.abs(belief - brute(model, features, edges)).max() < tolerance


def test_held_out_accuracy(spark, data):
    rows = table(spark, data, "pii_labels").orderBy("sample_id", "start_pos").collect()
    names = [(r.name_part, r.part_kind) for r in table(spark, data, "person_names").collect()]
    ids = sorted({r.sample_id for r in rows})
    hits = found = held = 0
    for fold in range(4):
        out = set(ids[fold::4])
        model = pii.Tagger([(r.sample_id, r.text, r.kind, r.start_pos, r.end_pos) for r in rows if r.sample_id not in out], names)
        for i in out:
            mine = [r for r in rows if r.sample_id == i]
            truth = {(r.start_pos, r.end_pos, r.kind) for r in mine if r.kind}
            got = set(model.find([mine[0].text])[0])
            hits, found, held = hits + len(truth & got), found + len(got), held + len(truth)
    assert hits >= 0.95 * found and hits >= 0.95 * held
