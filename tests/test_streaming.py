"""Pages and player events as streams."""

import datetime as dt
import json

from lectern.streaming.pages import read_pages, write_utterances
from lectern.streaming.player import EMPTY, EVENT_SCHEMA, debounced, states, step

AT = dt.datetime(2024, 1, 1)


def test_pages_arrive(spark, tmp_path):
    text = "A sentence with enough words, and commas, to count as prose for the score. " * 4
    rows = [(k, f"https://x.example/{k}", f"<article><p>{text}{k}</p></article>") for k in range(3)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows[:2], "page_id long, url string, html string").write.parquet(folder)
    run = lambda: write_utterances(read_pages(spark, folder), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    run()
    spark.createDataFrame(rows[2:], "page_id long, url string, html string").write.mode("append").parquet(folder)
    run()
    assert {r.page_id for r in spark.read.parquet(f"{tmp_path}/out").select("page_id").collect()} == {0, 1, 2}


def test_steps():
    s = step(EMPTY, {"type": "load", "total": 9, "signature": "9:1:v:m"})
    assert s[:3] == ("buffering", 0, 9)
    s = step(s, {"type": "progress", "index": 3, "bytes_billed": 50})
    assert s[:5] == ("buffering", 3, 9, 50, 0)
    s = step(step(s, {"type": "play"}), {"type": "seek", "index": 99})
    assert s[:2] == ("playing", 8)
    assert step(s, {"type": "prev"})[1] == 7 and step(s, {"type": "next"})[1] == 8
    assert step(s, {"type": "load", "total": 9, "signature": "9:1:v:m"})[3] == 50
    assert step(s, {"type": "load", "total": 2, "signature": "other"})[3] == 0
    assert step(s, {"type": "error", "error": "no"})[6] == "no" and step(s, {"type": "navigate"}) == EMPTY


def test_states(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    out = []

    def put(name, *events):
        (folder / name).write_text("\n".join(json.dumps({"tab": t, "at": (AT + dt.timedelta(seconds=s)).isoformat(), **e}) for t, s, e in events))
        q = states(spark.readStream.schema(EVENT_SCHEMA).json(str(folder))).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()

    put("1.json", (1, 2, {"type": "play"}), (1, 1, {"type": "load", "total": 5, "signature": "s"}), (2, 1, {"type": "load", "total": 3}))
    put("2.json", (1, 3, {"type": "next"}), (2, 4, {"type": "close"}))
    last = {r.tab: r for r in out}
    assert (last[1].status, last[1]["index"], last[1].total) == ("playing", 1, 5)
    assert (last[2].status, last[2].total) == ("idle", 0)


PATCHES = [(0, "speed", "1"), (250, "speed", "2"), (400, "voice", "a"), (450, "speed", "3"), (450, "speed", "2"), (1500, "speed", "4"), (1500, None, "x"), (1801, "voice", "b")]
BURSTS = [(0, 750, {"speed": "3", "voice": "a"}), (1500, 1800, {"speed": "4"}), (1801, 2101, {"voice": "b"})]


def test_a_burst_is_one_patch(spark):
    """Each patch starts the wait anew, fields merge, and the last value of a field counts."""
    rows = [(AT + dt.timedelta(milliseconds=m), k, v) for m, k, v in PATCHES]
    got = debounced(spark.createDataFrame(rows, "at timestamp, key string, value string")).collect()
    ms = lambda t: round((t - AT).total_seconds() * 1000)
    assert sorted((ms(r.began), ms(r.ended), r.patch) for r in got) == BURSTS
    assert debounced(spark.createDataFrame([], "at timestamp, key string, value string")).collect() == []


def test_bursts_of_a_stream(spark, tmp_path):
    """A burst is given out once, when the watermark has passed it."""
    folder, out = tmp_path / "patches", []
    folder.mkdir()

    def put(name, rows):
        (folder / name).write_text("\n".join(json.dumps({"at": (AT + dt.timedelta(milliseconds=m)).isoformat(), "key": k, "value": v}) for m, k, v in rows))
        stream = spark.readStream.schema("at timestamp, key string, value string").json(str(folder))
        q = debounced(stream, late="1 second").writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        q.awaitTermination()

    put("1.json", PATCHES[:3])
    assert out == []
    put("2.json", PATCHES[3:])
    put("3.json", [(60_000, "end", "1")])
    assert [r.patch for r in sorted(out, key=lambda r: r.began)] == [p for *_, p in BURSTS]
