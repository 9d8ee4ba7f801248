import pytest

from kinsheet.operators.scope import make_scope, parse_levels, require_groups, unique_in_order


def groups(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "group_id string")


def test_targets_are_trimmed_and_unique():
    assert unique_in_order(" B,C, B ,D ".split(",")) == ["B", "C", "D"]
    assert make_scope("cross", " A ", ["B", " C ", "B"]).targets == ("B", "C")


@pytest.mark.parametrize(
    ("mode", "anchor", "targets", "message"),
    [
        ("cross", "A", [" ", ""], "empty"),
        ("cross", " ", ["B"], "blank"),
        ("cross", "A", ["B", "A"], "must not contain"),
        ("cross", "A", None, "together"),
        ("cross", None, ["B"], "together"),
        ("within", "A", ["B"], "cross mode"),
        ("all", "A", ["B"], "cross mode"),
        ("other", None, None, "unknown"),
    ],
)
def test_scope_rules(mode, anchor, targets, message):
    with pytest.raises(ValueError, match=message):
        make_scope(mode, anchor, targets)


def test_no_direction_by_default():
    assert not make_scope("cross").directed


def test_groups_must_exist(spark):
    known = groups(spark, "A", "B", "A")
    with pytest.raises(ValueError, match="not in the input: X"):
        require_groups(make_scope("cross", "X", ["B"]), known)
    with pytest.raises(ValueError, match="X,Y"):
        require_groups(make_scope("cross", "A", ["B", "X", "Y"]), known)
    require_groups(make_scope("cross", "A", ["B"]), known)
    with pytest.raises(ValueError, match="two groups"):
        require_groups(make_scope("cross"), groups(spark, "A", "A"))
    require_groups(make_scope("within"), groups(spark, "A"))


def test_levels():
    assert parse_levels([" Module", "software", "module"]) == ["module", "software"]
    with pytest.raises(ValueError):
        parse_levels(["platform"])
