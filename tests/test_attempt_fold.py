"""What a candidate's batch costs its keyed state."""

from pyspark.sql import Row

from faultgrain.streaming import keyed_state


class State:
    """A value or a map that counts the calls it gets."""

    def __init__(self, calls):
        self.calls, self.values = calls, {}

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)

    def getValue(self, key):
        self.calls.append("get")
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls.append("update")
        self.values[key] = value


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_):
        return State(self.calls)

    getMapState = getValueState


def steps(runs, event, step=1):
    return iter([Row(candidate_id=1, run_id=run, step=step, event=event) for run in runs])


def fold(handle):
    made = keyed_state.AttemptFold(2, 3)
    made.init(handle)
    return lambda rows: tuple(next(made.handleInputRows((1,), rows, None)))


def test_a_batch_calls_the_state_by_block_not_by_run():
    handle = Handle()
    state = fold(handle)
    assert state(steps(range(1, 31), "audit_invalid")) == (1, "pending", 0, None)
    assert state(steps(range(1, 31), "audit_invalid", 2)) == (1, "pending", 0, None)
    assert state(steps(range(30, 0, -1), "audit_invalid", 3)) == (1, "rejected", 0, 1)
    assert len(handle.calls) <= 10


def test_blocks_in_any_order_are_judged_by_run():
    state, far = fold(Handle()), 3 * keyed_state.RUNS_A_BLOCK
    assert state(steps([far + 5], "true_positive")) == (1, "proven", 0, far + 5)
    assert state(steps([far - 1, 7], "setup_failure")) == (1, "proven", 2, far + 5)
    assert state(steps([far + 1], "setup_failure")) == (1, "inconclusive", 3, far + 1)
    assert state(steps([-4], "refused")) == (1, "rejected", 0, -4)
    assert state(steps([far + 9], "refused")) == (1, "rejected", 0, -4)
