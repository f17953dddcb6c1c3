"""Build plans, folds and gates: the published cases."""

import pytest

from tallyloom.plans.builds import Build, Facts, PlanError, check_plan, equal_edges, evaluate_gates, fold_edges, merge_equal, plan_builds, resolve_cutoff

SPLITS = {0: (1, 1000, 1000, 10), 1: (1001, 1500, 500, 5), 2: (1501, 2000, 500, 5)}
STARTS = {0: (1, 149), 1: (150, 399), 2: (400, 614), 3: (615, 899), 4: (900, 1000)}
FOLDS = {k: (a, b, b - a + 1, 2) for k, (a, b) in STARTS.items()}


@pytest.mark.parametrize("folds", [{}, {0: (1, 1000, 1000, 10)}])
def test_equal_rows(folds):
    assert fold_edges(Facts(SPLITS, folds), 5) == ("event_seq", [1, 201, 401, 601, 801, 1001])


def test_loader_folds():
    assert fold_edges(Facts(SPLITS, FOLDS), 5) == ("causal_fold", [1, 150, 400, 615, 900, 1001])
    windows = [(b.serves_from, b.serves_until, b.cutoff) for b in plan_builds(Facts(SPLITS, FOLDS), 5) if b.split_id == 0]
    assert windows == [(150, 400, 150), (400, 615, 400), (615, 900, 615), (900, 1001, 900)]


def broken(change):
    folds = dict(FOLDS)
    folds.update(change)
    return Facts(SPLITS, {k: v for k, v in folds.items() if v})


@pytest.mark.parametrize("facts,source", [
    (broken({4: None}), "auto"), (broken({1: (152, 399, 248, 2)}), "auto"), (broken({2: (140, 614, 215, 2)}), "auto"), (broken({4: (900, 1200, 301, 2)}), "auto"),
    (broken({0: (2, 149, 148, 2)}), "auto"), (Facts(SPLITS, {}), "causal_fold"), (Facts(SPLITS, FOLDS), "other"),
])
def test_refused(facts, source):
    with pytest.raises(PlanError):
        fold_edges(facts, 5, source)


def test_rounding_is_half_even():
    assert equal_edges(1, 5, 2) == [1, 3, 6]
    assert equal_edges(1, 7, 2) == [1, 5, 8]


def test_cutoffs():
    facts = Facts(SPLITS, FOLDS)
    assert [resolve_cutoff(x, facts) for x in (7, "val_boundary", "test_boundary", "end_of_data", "fold:2")] == [7, 1001, 1501, 2001, 400]


def test_plan_checks():
    with pytest.raises(PlanError):
        check_plan([Build("a", 11, 10, 20, 0)])
    with pytest.raises(PlanError):
        check_plan([Build("a", 10, 10, 20, 0), Build("b", 15, 15, 30, 0)])
    assert [b.build_id for b in merge_equal([Build("a", 10, 10, 20, 0), Build("b", 10, 20, 30, 0)])] == ["a", "a"]


def test_gates():
    good = {"x_MUST_BE_ZERO": 0, "y_MUST_BE_1": 1, "z_MUST_EQUAL_n": 4, "n": 4, "total": 9, "s_MUST_BE_BELOW_TOTAL": 8, "h_MUST_HAVE_NO_KEY_1": {2: 5}, "ABORT_big": False}
    assert evaluate_gates(good) == []
    bad = {"x_MUST_BE_ZERO": 1, "y_MUST_BE_1": 0, "z_MUST_EQUAL_n": 4, "s_MUST_BE_BELOW_TOTAL": 8, "h_MUST_HAVE_NO_KEY_1": {1: 5}, "ABORT_big": True}
    assert len(evaluate_gates(bad, expect=("gone",))) == 7
