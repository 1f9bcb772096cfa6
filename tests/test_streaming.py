import datetime as dt

import pandas as pd

from pairloom.params import Params
from pairloom.streaming.signals import arm, entry_signals

D = [dt.date(2020, 1, 2) + dt.timedelta(days=i) for i in range(12)]
Z = [1.0, 2.2, 3.0, 1.5, 4.5, 2.5, None, 2.6, 0.2, -2.1, -2.0, -1.0]


def frame(z, first=0):
    return pd.DataFrame({"session": D[first : first + len(z)], "z": z, "eligible": [True] * len(z)})


def test_arm():
    out, armed, last = arm(frame(Z), True, None, Params())
    assert [s for s, _ in out] == [D[1], D[5], D[9]] and armed and last == D[11]
    assert arm(frame(Z[:3]), True, D[1], Params())[0] == [(D[2], 3.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("P", D[i], z, True, dt.datetime.combine(D[i], dt.time())) for i, z in enumerate(Z)]
    schema = "pair_id string, session date, z double, eligible boolean, ts timestamp"
    src = tmp_path / "in"
    for k in range(0, 12, 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(str(src))
    z = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(src))
    q = entry_signals(z).writeStream.format("memory").queryName("signals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.session for r in spark.table("signals").orderBy("session").collect()] == [D[1], D[5], D[9]]
