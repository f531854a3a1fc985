"""What a reused Python worker still holds."""

from exprlake.llm import common


def test_a_worker_lets_go_of_what_other_stages_kept(monkeypatch):
    monkeypatch.setattr("sys._exprlake_kept", {}, raising=False)
    stage = [1]
    monkeypatch.setattr(common, "_stage", lambda: stage[0], raising=False)
    first = common.kept("a", list)
    assert common.kept("a", list) is first and common.kept("b", list) is not None
    stage[0] = 2
    assert common.kept("a", list) is first and set(common.released("a")) == {"a"}
    stage[0] = 3
    common.released()
    assert common.kept("a", list) is not first
