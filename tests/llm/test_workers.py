"""What workers keep between tasks, and give back after them."""

from sitlake.llm import common


def test_other_work_drops_what_a_worker_keeps():
    common.held("a")["x"] = 1
    assert common.held("a") == {"x": 1}
    assert common.held("b") == {} and common.held("a") == {}


def test_memory_is_given_back_after_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))
    common.held("tokens")["x"] = 1
    out = common.lean(lambda batches: (b + 1 for b in batches), "tokens")(iter([1, 2]))
    assert next(out) == 2 and not told
    assert list(out) == [3] and told == [1] and common.held("tokens") == {"x": 1}
    assert list(common.lean(lambda batches: batches)(iter([]))) == [] and "tokens" not in common.sys.__dict__["_sitlake_held"]
    common.give_back()
