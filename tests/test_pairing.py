"""The state of the live tolerance join, held by a plain stand-in: few entries for many rows, the answers of plain loops."""

import random
from types import SimpleNamespace

from pyspark.sql import Row

from rackpulse.streaming.joins import Pairing


class Store:
    def __init__(self):
        self.items, self.written, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: None, update=lambda v: None, clear=lambda: None)

    def get(self):
        return iter(self.items)

    def put(self, rows):
        self.items, self.written = list(rows), self.written + len(rows)

    def appendList(self, rows):
        self.items, self.written = self.items + list(rows), self.written + len(rows)

    def clear(self):
        self.items = []

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_rows_of_a_state_are_stored_together_and_answered_once():
    rng = random.Random(3)
    reach, shift = 2_000_000, 500_000
    rows = [Row(t=rng.randrange(100) * 400_000, side=rng.randrange(2), tie=n if n % 9 else None, payload=f'"{n}é') for n in range(5000)]
    pairing, store = Pairing(reach, shift), Store()
    pairing.init(store)
    assert list(pairing.handleInputRows(("h", 0), iter(rows), None)) == []
    assert store.written == 2
    found = []
    for passed in (0, 9_000, 20_000, 60_000):
        found += pairing.handleExpiredTimer(("h", 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), None)  # noqa: B023
    assert store.items == [] and store.written < 12
    hosts = sorted((r for r in rows if r.side == 1), key=lambda r: (r.t, r.tie is None, r.tie or 0))
    expected = []
    for r in rows:
        later = next((h for h in hosts if h.t > r.t), None)
        if r.side == 0 and later is not None and later.t < r.t + reach:
            expected.append(("h", r.t + shift, r.payload, later.t, later.payload))
    assert len(expected) > 1000
    assert sorted((r.host, r.bmc_t, r.bmc, r.host_t, r.sample) for r in found) == sorted(expected)
