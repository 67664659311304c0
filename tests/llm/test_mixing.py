import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismgrid.llm.mixing import apportion, mix_sources


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.5, 1.0, 2.0, 3.7]), st.integers(0, 25)), max_size=6), st.integers(0, 90))
def test_apportion_gives_seats_one_by_one(entries, seats):
    weights, caps = [w for w, _ in entries], [c for _, c in entries]
    given_ = [0] * len(entries)
    for _ in range(seats):
        open_ = [i for i in range(len(entries)) if weights[i] > 0 and given_[i] < caps[i]]
        if not open_:
            break
        given_[max(open_, key=lambda i: (weights[i] / (2 * given_[i] + 1), -i))] += 1
    got = apportion(weights, seats, caps)
    assert sum(got) == sum(given_)
    quotient = lambda g: sorted(round(w / (2 * n - 1), 9) for w, n in zip(weights, g, strict=True) if n)
    assert quotient(got) == quotient(given_)


def docs(frame, sizes):
    rows, n = [], 0
    for source, count in sizes.items():
        for i in range(count):
            n += 1
            rows.append({"doc_id": n, "source": source, "text": "word " * (20 + 7 * (i % 5))})
    return frame("documents", rows + [{"doc_id": 900, "source": "a", "text": None}, {"doc_id": 901, "source": "a", "text": ""}], ", shard int, n_tokens int")


def targets(frame, rows):
    return frame("mix_targets", [dict(zip(("mix_id", "source", "target_share", "max_repeats"), r, strict=True)) for r in rows])


def test_shares_repeats_and_missing_sources(frame):
    mixes = targets(frame, [(1, "a", 5.0, 2), (1, "b", 5.0, 4), (1, "none", 2.0, 9), (2, "a", 1.0, 1), (3, "none", 1.0, 1), (None, "a", 1.0, 1)])
    choice, shares = mix_sources(docs(frame, {"a": 200, "b": 20}), mixes)
    got = {(r.mix_id, r.source): r for r in shares.collect()}
    assert abs(got[1, "a"].actual_share - 0.5) < 0.02 and abs(got[1, "b"].actual_share - 0.5) < 0.02
    assert got[1, "none"].tokens == 0 and got[1, "none"].reachable_share == 0
    assert got[1, "b"].most_repeats == 4 and got[1, "a"].most_repeats <= 2
    assert got[2, "a"].documents == 200 and got[2, "a"].actual_share == 1
    assert got[3, "none"].actual_share == 0
    rows = choice.collect()
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows) and not {r.doc_id for r in rows} & {900, 901}


def test_fixed_size_uses_up_small_sources(frame):
    mixes = targets(frame, [(1, "a", 1.0, 9), (1, "b", 1.0, 2)])
    _, shares = mix_sources(docs(frame, {"a": 200, "b": 10}), mixes, total_tokens=8000)
    got = {r.source: r for r in shares.collect()}
    assert got["b"].most_repeats == 2 and got["b"].documents == 10
    assert got["a"].tokens == pytest.approx(4000, rel=0.03)


def test_seeded_and_empty(frame):
    mixes = targets(frame, [(1, "a", 1.0, 1), (1, "b", 1.0, 1)])
    d = docs(frame, {"a": 60, "b": 20})
    pick = lambda seed: sorted(map(tuple, mix_sources(d, mixes, seed)[0].collect()))
    assert pick(1) == pick(1) and pick(1) != pick(2)
    assert mix_sources(frame("documents", []), mixes)[0].count() == 0
    assert mix_sources(d, targets(frame, []))[1].count() == 0
