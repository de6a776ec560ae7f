import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doclake.operators.bitmaps import NONE, SPAN, Container, by_group


def some(kind, seed):
    rng = np.random.default_rng(seed)
    if kind == "values":
        return np.unique(rng.integers(0, SPAN, 300))
    if kind == "runs":
        return np.unique(np.concatenate([np.arange(a, a + 2_000) for a in rng.integers(0, SPAN - 2_000, 4)] + [[0, SPAN - 1]]))
    return np.unique(rng.integers(0, SPAN, 40_000))


KINDS = ("values", "runs", "bits")


@pytest.mark.parametrize("a", KINDS)
@pytest.mark.parametrize("b", KINDS)
def test_containers_of_all_kinds(a, b):
    x, y = some(a, 1), some(b, 2)
    cx, cy = Container.of(x), Container.of(y)
    assert (cx.kind, cy.kind) == (a, b)
    assert cx.values().tolist() == x.tolist()
    assert cx.or_(cy).values().tolist() == np.union1d(x, y).tolist()
    assert cx.and_not(cy).values().tolist() == np.setdiff1d(x, y).tolist()
    assert cx.has(y).tolist() == np.isin(y, x).tolist()
    assert cx.and_not(NONE).values().tolist() == x.tolist()
    assert NONE.or_(cx).values().tolist() == x.tolist()
    assert NONE.and_not(cx).values().tolist() == cx.and_not(cx).values().tolist() == []


def test_a_full_container_is_one_run():
    c = Container.of(np.arange(SPAN))
    assert c.kind == "runs" and c.data.nbytes == 4 and len(c.values()) == SPAN


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 500)), max_size=200))
def test_groups(rows):
    got = by_group(np.array([g for g, _ in rows], np.int64), np.array([v for _, v in rows], np.int64))
    assert {g: c.values().tolist() for g, c in got.items()} == {g: sorted({v for h, v in rows if h == g}) for g, _ in rows}
