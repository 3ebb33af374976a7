import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_streaming import at, feed

from tabwright.operators import logs
from tabwright.streaming import ordered

SCHEMA = "event_id long, ts timestamp, user_id long, level string, value double"


def run(df, folder):
    with ordered.state_store(df.sparkSession):
        q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append")
        q = q.trigger(availableNow=True).start()
        q.awaitTermination(300)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def beats(seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(240):
        level = rng.choice(["a", "b", None])
        out.append((i, at(rng.randrange(4000)), rng.choice([1, 2, None]), level, 1.0))
    return sorted(out, key=lambda r: r[1])


def cuts(rows):
    rng = random.Random(2)
    some = sorted(rng.sample(range(1, len(rows)), 5))
    return {"one": [rows], "few": [rows[a:b] for a, b in zip([0, *some], [*some, len(rows)], strict=True)]}


def test_changes_are_those_of_a_batch_for_any_cut(spark, tmp_path):
    rows = beats()
    end = at((max(r[1] for r in rows) - at(0)).total_seconds() - 30)
    end = at(int((end - at(0)).total_seconds()) // 60 * 60)
    want = logs.change_only(spark.createDataFrame([r for r in rows if r[1] < end], SCHEMA), ["user_id"], "level", ["ts", "event_id"])
    want = sorted((str(r["user_id"]), r["event_id"], str(r["level"])) for r in want.collect())
    for name, batches in cuts(rows).items():
        # rows of a batch come in any order
        batches = [random.Random(i).sample(b, len(b)) for i, b in enumerate(batches)]
        stream = feed(spark, str(tmp_path / name), batches)
        out = run(ordered.changes(stream, ["user_id"], "level", "ts", "event_id", "30 seconds"), tmp_path / f"{name}-run")
        assert out.columns == ["user_id", "ts", "event_id", "level"]
        assert sorted((str(r["user_id"]), r["event_id"], str(r["level"])) for r in out.collect()) == want, name


def plain_presence(times, limit, end):
    out, last = [], None
    for t in sorted(times):
        if last is None or t - last > limit:
            if last is not None:
                out.append(("offline", last + limit))
            out.append(("online", t))
        last = t
    if last is not None and last + limit < end:
        out.append(("offline", last + limit))
    return out


def test_presence_for_any_cut(spark, tmp_path):
    rows = beats(3)
    second = lambda t: int((t - at(0)).total_seconds())
    end = (max(second(r[1]) for r in rows) - 30) // 60 * 60
    want = []
    for who in (1, 2, None):
        times = [second(r[1]) for r in rows if r[2] == who and second(r[1]) < end]
        want += [(str(who), status, at(t)) for status, t in plain_presence(times, 90, end)]
    for name, batches in cuts(rows).items():
        stream = feed(spark, str(tmp_path / name), batches)
        out = run(ordered.presence(stream, ["user_id"], "ts", 90), tmp_path / f"{name}-run")
        assert sorted((str(r["user_id"]), r["status"], r["at"]) for r in out.collect()) == sorted(want), name


def test_keys_and_values_of_other_types(spark, tmp_path):
    schema = "a string, b date, ts timestamp_ntz, n int, v decimal(12,3)"
    day = datetime.date(2024, 2, 29)
    values = [Decimal("1.100"), Decimal("1.100"), None, None, Decimal("123456789.125"), None]
    rows = [("k", day, at(i), i, v) for i, v in enumerate(values)] + [(None, None, at(2), 9, Decimal("5.000")), ("k", None, at(3), 7, None), ("z", day, at(9999), 1, None)]
    rows += [("k", day, None, 100, Decimal("7.000"))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = run(ordered.changes(stream, ["a", "b"], "v", "ts", "n", "10 seconds"), tmp_path / "run")
    assert [t for _, t in out.dtypes] == ["string", "date", "timestamp_ntz", "int", "decimal(12,3)"]
    got = sorted(((r["a"], r["b"], r["n"], r["v"]) for r in out.collect()), key=repr)
    want = [("k", day, 0, Decimal("1.100")), ("k", day, 2, None), ("k", day, 4, Decimal("123456789.125")), ("k", day, 5, None), (None, None, 9, Decimal("5.000")), ("k", None, 7, None)]
    assert got == sorted(want, key=repr)


def test_state_store_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), ordered.state_store(spark):
        assert "RocksDB" in spark.conf.get(name)
        raise KeyError
    assert spark.conf.get(name, None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1


class _Store:
    """State of one key, with a count of the calls."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, set(), 0

    def getMapState(self, *a):
        return self

    def getValueState(self, *a):
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.value

            def update(self, v):
                store.calls += 1
                store.value = v

        return Value()

    def updateValue(self, k, v):
        self.calls += 1
        self.map[k] = v

    def getValue(self, k):
        self.calls += 1
        return self.map[k]

    def removeKey(self, k):
        self.calls += 1
        del self.map[k]

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)


class _At:
    def __init__(self, t):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: t


@pytest.mark.parametrize("chunk,batches", [(20_000, 1), (7, 1), (7, 4), (1, 2)])
def test_calls_to_the_state_follow_keys_not_buckets(chunk, batches):
    import random

    import pandas as pd

    from tabwright.streaming.ordered import Changes, Presence

    rng = random.Random(5)
    rows = [(rng.randrange(300_000) * 1000, i, rng.choice("ab")) for i in range(200)]
    whole = sorted(r for r in rows if r[0] < 290_000_000)
    for kind in (Changes(["k"], 1000), Presence(["k"], 1000, 3_000_000)):
        kind.chunk_rows = chunk
        store = _Store()
        kind.init(store)
        got = []
        for b in range(batches):
            kind.handleInputRows((1,), iter([pd.DataFrame(rows[b::batches], columns=["at", "tie", "code"])]), None)
        for mark in (100_500, 290_000):
            while due := [t for t in store.timers if t <= mark]:
                store.timers.remove(min(due))

                class Now(_At):
                    pass

                for out in kind.handleExpiredTimer((1,), _At(mark), Now(min(due))):
                    got += out.drop(columns="k").itertuples(index=False, name=None)
        expected, before, value = [], None, None
        for at, tie, code in whole:
            if isinstance(kind, Changes):
                if before is None or code != value:
                    expected.append((at, tie, code))
            else:
                if before is not None and at - before > 3_000_000:
                    expected.append(("offline", before + 3_000_000))
                if before is None or at - before > 3_000_000:
                    expected.append(("online", at))
            before, value = at, code
        if isinstance(kind, Presence) and before + 3_000_000 < 290_000_000 - 1_000_000:
            expected.append(("offline", before + 3_000_000))
        assert got == expected
        if chunk == 20_000:
            # about 150 buckets hold rows
            assert store.calls < 20
