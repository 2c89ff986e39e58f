"""Places, points and results against plain versions; runs, leases, the landed stream and the export sink over several batches."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import places, research
from factloom.operators.address import read_addresses
from factloom.session import ship
from factloom.sources import export, landed
from factloom.streaming import incremental, leases


# -- places, points, results


def plain_nearest(points, found, km=places.NEAR_KM, most=places.PER_CATEGORY):
    def distance(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(x)))

    out = Counter()
    for i, lat, lng in points:
        groups = defaultdict(dict)
        for n, category, name, a, b in sorted(found):
            if None not in (lat, lng, a, b, category, name) and name.strip() and distance(lat, lng, a, b) <= km:
                groups[category].setdefault(name.strip().lower(), (round(distance(lat, lng, a, b), 2), n, name))
        for category, named in groups.items():
            for place, (d, _, name) in enumerate(sorted(named.values())[:most], 1):
                out[i, category, place, name, d] += 1
    return out


@pytest.mark.parametrize("lat,lng", [(43.6, -79.4), (0.0, 0.0), (-89.99, 10.0), (89.995, 0.0), (51.0, 179.995), (-36.8, -179.999)])
def test_nearest_places_everywhere(spark, lat, lng):
    """At the poles and at 180 degrees too; repeated points, names and rows; nulls."""
    r = random.Random(7)
    wide = min(180.0, 0.02 / max(0.0005, math.cos(math.radians(lat))))
    around = lambda: (max(-90.0, min(90.0, lat + r.uniform(-0.02, 0.02))), (lng + r.uniform(-wide, wide) + 180) % 360 - 180)
    points = [(i, *around()) for i in range(25)] + [(90, lat, lng), (91, lat, lng), (92, None, lng), (93, lat, None)]
    found = [(n, "ab"[n % 2], f"{'Nn'[n % 3 % 2]}ame {n % 40}", *around()) for n in range(160)] + [(500, "a", "Here", lat, lng), (501, "a", "here ", lat, lng), (502, None, "x", lat, lng), (503, "a", " ", lat, lng), (504, "a", None, lat, lng), (505, "b", "y", None, lng)]
    p = spark.createDataFrame(points, "listing_id int, lat double, lng double").withColumn("cell", F.lit(1))
    f = spark.createDataFrame(found, "ordinal int, category string, name string, lat double, lng double")
    got = places.nearest_places(p, f).collect()
    want = plain_nearest(points, found)
    assert Counter((x.listing_id, x.category, x.place, x.name, x.distance_km) for x in got) == want and want


def test_substring_area(spark, monkeypatch):
    texts = [(1, "Near HARBOURFRONT"), (2, "old mill"), (3, None), (4, ""), (5, "x"), (6, "mill harbour"), (7, "é漢字 straße")]
    areas = [(3, "front", "Front"), (0, "harbour", "harbour"), (2, "mill", "MILL"), (9, "mill2", "mill"), (4, "s", "ss"), (5, "kanji", "漢"), (6, "x", "X"), (0, "none", None)]
    ship(spark)
    t = spark.createDataFrame(texts, "id int, text string").withColumn("key", F.lit("other"))
    k = spark.createDataFrame(areas, "ordinal int, key string, keyword string")
    want = {1: "harbour", 2: "mill", 3: None, 4: None, 5: "x", 6: "harbour", 7: "kanji"}
    get = lambda k: {r.id: r.area_key for r in places.substring_area(t, k).collect()}
    assert get(k) == want and get(k.limit(0)) == dict.fromkeys(want)
    first = k.union(spark.createDataFrame([(1, "all", "")], k.schema))
    assert get(first) == {1: "harbour", 2: "all", 3: None, 4: None, 5: "all", 6: "harbour", 7: "all"}
    monkeypatch.setattr(places, "AUTOMATON_BYTES", 0)
    assert get(k) == want


def test_page_point(spark):
    ship(spark)
    block = lambda *x: "".join(f'<script type="application/ld+json">{json.dumps(y) if not isinstance(y, str) else y}</script>' for y in x)
    meta = '<meta name="geo.position" content="45.5;-75">'
    good = {"latitude": 1, "longitude": "2.5"}
    deep: dict = good
    for _ in range(200):
        deep = {"a": [deep]}
    cases = [
        (block(good) + meta, (1, 2.5)),
        (block({"z": {"latitude": "x", "longitude": 1, "in": good}, "a": [0, good]}), (1, 2.5)),
        (block({"z": {"latitude": 5, "longitude": 6}, "a": good}), (5, 6)),
        (block({"latitude": 91, "longitude": 0, "in": good}), None),
        (block("{", [], deep), (1, 2.5)),
        (block({"latitude": 1}) + meta, (45.5, -75)),
        (meta.replace(";", ","), None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r.i: r.p and (r.p.lat, r.p.lng) for r in df.select("i", places.page_point(F.col("html")).alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(cases)}


def test_changes_only(spark):
    r = random.Random(3)
    rows = [(n, r.randrange(3), r.choice([1.0, 2.0, None]), f"2024-01-{1 + r.randrange(6):02d} {r.randrange(24):02d}:00:00") for n in range(300)]
    df = spark.createDataFrame(rows, "n int, k int, v double, at string").withColumn("at", F.col("at").cast("timestamp"))
    want, last = set(), {}
    for n, k, v, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        if k not in last or last[k] != v:
            want.add(n)
        last[k] = v
    assert {x.n for x in places.changes_only(df, ["k"], "v", "at", "n").collect()} == want


def test_addresses_by_words():
    ids = lambda t: [(a["number"], a["prefix"], a["name"], a["type"], a["suffix"]) for a in read_addresses(t)]
    assert ids("12 W. Main Street, near 34 Queen St East.") == [("12", "West", "main", "Street", None), ("34", None, "queen", "Street", "East")]
    assert ids("100 West Street") == [("100", None, "west", "Street", None)] and ids("12-16 King St, 7, Bay St") == []
    assert ids("unit 5, 1 St Clair Ave. W") == [("1", None, "st clair", "Avenue", "West")] and ids("1234567 King St") == [] and ids("") == []
    assert ids("9 " + "word " * 20 + "8 Bay Street") == [("8", None, "bay", "Street", None)]


def test_outcomes_are_counted_as_they_are_read(spark):
    ship(spark)
    at, city = "10 King St W", "Toronto"
    row = lambda n, url, title="t", excerpt=f"{at}, Toronto", published="2024-01-01": (at, city, n // 8, n % 8, url, title, excerpt, published)
    found = [row(n, f"https://x/{n}") for n in range(24)] + [row(24, "https://x/0"), row(25, "mailto:x"), row(26, "https://y", published="soon"), row(27, "https://z", excerpt="12 Bay St, Toronto"), row(28, None), row(29, "http://q", title=None)]
    df = spark.createDataFrame(found, "subject string, city string, search int, place int, url string, title string, excerpt string, published string")
    judged = research.outcomes(df, "2024-01-15")
    want = Counter(r.outcome for r in judged.collect())
    rows, seen = research.counted(judged)
    assert rows.count() == 20 and {k: v for k, v in seen.get.items() if v} == dict(want)
    assert want["accepted"] == 20 and want["unread"] > 0
    assert research.outcomes(df.limit(0), "2024-01-15").count() == 0


# -- runs


def fold(runs):
    """Row by row: id, sig, at, ok. What is seen: id to [sig, first run, last run]."""
    seen: dict = {}
    outs = []
    for n, rows in enumerate(runs):
        ids, sigs, mine, out = set(seen), {s: i for i, (s, *_) in sorted(seen.items(), key=lambda x: (x[1][1], x[0]))}, set(), {}
        for i, s, at, ok in sorted(rows, key=lambda r: (r[2], r[0] or "")):
            if not i:
                continue
            if i in ids:
                out[i, at] = "refresh"
                seen[i][2] = n
            elif s in sigs:
                out[i, at] = "touch"
                seen[sigs[s]][2] = n
            elif s in mine:
                out[i, at] = "repeat"
            elif not ok:
                out[i, at] = "exclude"
            else:
                out[i, at] = "accept"
                mine.add(s)
                seen[i] = [s, n, n]
        outs.append(out)
    return outs, seen


def test_ids_that_change_their_signature(spark, tmp_path):
    """Three runs: by tables, by a stream of micro-batches, and by a plain fold."""
    r = random.Random(5)
    runs = [[(f"i{r.randrange(60)}", f"s{r.randrange(25)}", 1000 * n + k, r.random() < 0.6) for k in range(120)] + [(None, "s1", 1000 * n + 500, True), ("", "s1", 1000 * n + 501, True)] for n in range(3)]
    runs[1] += [("i1", "new", 1900, True), ("other", "new", 1901, True)]
    outs, seen = fold(runs)
    assert {o for out in outs for o in out.values()} == {"accept", "exclude", "refresh", "touch", "repeat"}
    ship(spark)
    now = lambda n: f"2024-01-0{n + 1} 00:00:00"
    schema, state = "id string, sig string, at long, ok boolean", None
    for n, rows in enumerate(runs):
        df = spark.createDataFrame(rows, schema)
        got = incremental.dedupe(df, state)
        assert {(x.id, x.at): x.outcome for x in got.collect()} == outs[n]
        state = spark.createDataFrame(incremental.seen_after(got, state, now(n)).collect(), "id string, sig string, first_seen timestamp, last_seen timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.run_available(spark, schema, str(tmp_path / "in"), str(tmp_path / "cp"), incremental.dedupe_batch(str(tmp_path / "state"), now))
        assert {(x.id, x.at): x.outcome for x in spark.read.parquet(str(tmp_path / f"state/outcomes/{n}")).collect()} == outs[n]
    day = lambda t: t.day - 1
    for table in (state, spark.read.parquet(str(tmp_path / "state/seen/2"))):
        assert {x.id: [x.sig, day(x.first_seen), day(x.last_seen)] for x in table.collect()} == seen
    incremental.dedupe_batch(str(tmp_path / "state"), now)(spark.createDataFrame(runs[2], schema), 2)  # tried again
    assert {(x.id, x.at): x.outcome for x in spark.read.parquet(str(tmp_path / "state/outcomes/2")).collect()} == outs[2]


def test_late_rows_are_counted(spark, tmp_path):
    """Three batches; rows behind the watermark are dropped, and the query says how many. Repeats of a key go without being late."""
    batches = [[(1, "10:00"), (2, "10:30"), (2, "10:30")], [(3, "11:30"), (1, "10:25")], [(4, "10:40"), (5, "11:10"), (6, "11:25"), (3, "11:30")]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(k, f"2024-01-01 {t}:00") for k, t in rows], "k int, at string").select("k", F.col("at").cast("timestamp").alias("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, at timestamp").parquet(str(tmp_path / "in"))
        q = incremental.arrivals(stream, "k", "at", "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        late = incremental.dropped_late(q.recentProgress)
        assert late == [0, 0, 1][n]  # 10:40 is behind 11:30 less 30 minutes
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 5, 6]


# -- leases

T = 1_704_067_200_000
MIN = 60_000


def jobs_data():
    """(job, seq, kind, token, ms) of three batches: leases that run out between batches, reports with another's token, all attempts."""
    e = [("a", "queued", None, 0), ("a", "claimed", "w1", 1), ("b", "queued", None, 0), ("b", "claimed", "w1", 2), ("b", "done", "w1", 4), ("c", "queued", None, 1), ("c", "cancelled", None, 3), ("d", "claimed", "w1", 0), ("d", "failed", "w1", 1)]
    e += [("a", "done", "w2", 20), ("a", "claimed", "w2", 21), ("d", "claimed", "w2", 22), ("d", "failed", "w1", 23), ("d", "failed", "w2", 24), ("e", "claimed", "w9", 20), ("x", "queued", None, 40)]
    e += [("a", "claimed", "w3", 60), ("a", "done", "w2", 61), ("d", "claimed", "w3", 60), ("y", "queued", None, 90)]
    rows = [(j, n, k, t, T + m * MIN) for n, (j, k, t, m) in enumerate(e)]
    return [rows[:9], rows[9:16], rows[16:]]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "job string, seq long, kind string, token string, ms long")
    return df.select("job", "seq", "kind", "token", F.timestamp_millis("ms").alias("at"))


def test_leases_by_table_and_by_stream(spark, tmp_path):
    ship(spark)
    batches = jobs_data()
    every = [x for b in batches for x in b]
    jobs, moves = leases.plain(every, T + 90 * MIN)
    assert (jobs["a"].state, jobs["b"].state, jobs["c"].state, jobs["d"].state, jobs["e"].attempts) == ("failed", "succeeded", "cancelled", "failed", 1)
    got = {r.job: (r.state, r.attempts) for r in leases.leased_states(frame(spark, every), "2024-01-01 01:30:00").collect()}
    assert got == {k: (j.state, j.attempts) for k, j in jobs.items()}
    for b in batches:
        frame(spark, b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job string, seq long, kind string, token string, at timestamp").parquet(str(tmp_path / "in"))
        before = spark.conf.get(leases._PROVIDER[0], None)
        with leases.rocksdb(spark):
            q = leases.transitions(stream, late="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        assert q.exception() is None and spark.conf.get(leases._PROVIDER[0], None) == before
    seen = Counter((r.job, round(r.at.timestamp() * 1000), r.state, r.attempts, r.why) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert seen == Counter((k, at, j.state, j.attempts, why) for k, at, j, why in moves)


def test_claims(spark):
    jobs = spark.createDataFrame([("a", "queued", 0, "10:00", "10:00"), ("b", "queued", 3, "09:00", "09:00"), ("c", "running", 1, "08:00", "08:00"), ("d", "queued", 1, "09:30", "12:00"), ("e", "queued", 1, "09:40", "09:50")], "job string, state string, attempts int, requested_at string, due_at string")
    jobs = jobs.withColumns({c: F.concat(F.lit("2024-01-01 "), c, F.lit(":00")).cast("timestamp") for c in ("requested_at", "due_at")})
    got = leases.claimed(jobs, "w", "2024-01-01 11:00:00", 5).collect()
    assert [r.job for r in got] == ["e", "a"] and len({r.token for r in got}) == 2


def test_a_worker_reports_each_job(spark):
    """Gone, done, failed, without a record, of another source: what is reported moves the jobs as it should."""
    ship(spark)
    claims = spark.createDataFrame([(j, "w1") for j in "abcdef"], "job string, token string")
    record = [(j, "ads" if j != "e" else "post", j, f"https://x/{j}", "{}") for j in "abcde"]

    def fetch(r):
        if r["source_id"] == "d":
            raise TimeoutError("no answer\n" + "x" * 500)
        return {"a": {"status": "complete", "payload": {"rent": 1}}, "b": {"status": "removed"}, "c": {"status": "odd"}}[r["source_id"]]

    out = leases.worked(claims, spark.createDataFrame(record, "job string, source string, source_id string, url string, payload string"), fetch, ["ads"], "2024-01-01 00:02:00")
    got = {r.job: r for r in out.collect()}
    assert {j: (r.kind, r.outcome) for j, r in got.items()} == {"a": ("done", "complete"), "b": ("refused", "removed"), "c": ("failed", "failed"), "d": ("failed", "failed"), "e": ("refused", "source_unavailable"), "f": ("refused", "record_missing")}
    assert got["a"].payload == '{"rent": 1}' and got["d"].error == "TimeoutError: detail update failed"
    before = [(j, 0, "claimed", "w1", T) for j in "abcdef"]
    events = frame(spark, before).unionByName(out.select("job", F.lit(1).cast("long").alias("seq"), "kind", "token", "at"))
    states = {r.job: (r.state, r.attempts) for r in leases.leased_states(events, "2024-01-01 00:03:00").collect()}
    assert states == {"a": ("succeeded", 1), "b": ("failed", 1), "c": ("queued", 1), "d": ("queued", 1), "e": ("failed", 1), "f": ("failed", 1)}


# -- the landed stream


def land(folder, source, area, stamp, texts):
    lines = [json.dumps({"source_id": str(i), "url": f"https://x/{i}", "payload": {"title": t}}) for i, t in enumerate(texts)]
    (folder / f"{source}__{area}__{stamp}__{len(texts)}.jsonl").write_text("\n".join(lines) + "\n")


def test_landed_stream(spark, tmp_path):
    """Each file is read once, over restarts; a weak run holds its source back until a healthy one comes."""
    ship(spark)
    spark.dataSource.register(landed.LandedSource)
    folder = tmp_path / "in"
    folder.mkdir()

    def run(**options):
        got = []
        s = spark.readStream.format("landed_records").option("path", str(folder)).option("bands", json.dumps({"ads": 3}))
        for k, v in options.items():
            s = s.option(k, v)
        take = lambda df, n: got.extend((r.source, json.loads(r.payload)["title"]) for r in df.collect())
        q = s.load().writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / f"cp{sorted(options.items())}".replace("'", ""))).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(got)

    land(folder, "ads", "east", "20240101", ["a1", "a2"])
    land(folder, "ads", "west", "20240101", ["a3"])
    land(folder, "market", "east", "20240101", ["m1"])
    assert run() == [("ads", "a1"), ("ads", "a2"), ("ads", "a3"), ("market", "m1")]
    assert run() == []
    land(folder, "ads", "east", "20240102", ["a4"])  # one record of three: the page was broken
    land(folder, "market", "west", "20240102", ["m2"])
    assert run() == [("market", "m2")]
    land(folder, "ads", "east", "20240103", ["a5", "a6", "a7"])
    assert run() == [("ads", "a4"), ("ads", "a5"), ("ads", "a6"), ("ads", "a7")] and run() == []
    assert run(sources="ads", areas="west,north", keywords="a3,zz") == [("ads", "a3")]
    assert run(sources="market", keywords="M2") == [("market", "m2")] and run(sources="broker") == []


# -- the export sink


def test_export_shows_all_or_nothing(spark, tmp_path):
    spark.dataSource.register(export.Export)
    path = str(tmp_path / "out")
    put = lambda df, mode: df.write.format("whole_export").option("path", path).mode(mode).save()
    ids = lambda: sorted(r.id for r in export.read_export(spark, path, "id long, t string").collect())
    put(spark.range(10).withColumn("t", F.lit("x")).repartition(3), "append")
    assert ids() == list(range(10))
    put(spark.range(10, 12).withColumn("t", F.lit(None).cast("string")), "append")
    assert ids() == list(range(12))
    bad = F.udf(lambda i: 1 // (i - 5) and str(i), "string")
    with pytest.raises(Exception, match="(?i)zero"):
        put(spark.range(10).repartition(4).withColumn("t", bad("id")), "overwrite")
    assert ids() == list(range(12))
    put(spark.range(3).withColumn("t", F.lit("y")).coalesce(1), "overwrite")
    assert ids() == [0, 1, 2] and len(list((tmp_path / "out").glob("part-*.jsonl"))) == 1


def test_export_of_retried_tasks_and_batches(spark, tmp_path):
    from pyspark.sql import Row

    path = str(tmp_path / "out")
    w = export.ExportWriter(path, False)
    w.write(iter([Row(id=1)]))  # a task that was lost after it wrote
    w.commit([w.write(iter([Row(id=1), Row(id=2)]))])
    assert sorted(r.id for r in export.read_export(spark, path, "id long").collect()) == [1, 2] and len(list((tmp_path / "out").glob("part-*"))) == 1
    for _ in range(2):  # the batch is committed again after a restart
        s = export.ExportStream(path)
        s.commit([s.write(iter([Row(id=3)])), None], 7)
    assert sorted(r.id for r in export.read_export(spark, path, "id long").collect()) == [1, 2, 3] and len(list((tmp_path / "out").glob("part-*"))) == 2
    s = export.ExportStream(path)
    s.write(iter([Row(id=4)]))
    s.abort([], 8)
    assert len(list((tmp_path / "out").glob("part-*"))) == 2


@pytest.mark.parametrize("name", ["ad_pages", "broker_pages", "broker_cards"])
def test_pages_of_one_row_group_are_read_by_many_tasks(spark, sf, name):
    """A small file is one task's to scan; the pages made of its rows are not one task's to read."""
    import __spark_entry__ as entry

    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1
    shares = entry.queries()[name](spark, sf).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(shares) >= 4 and max(x["count"] for x in shares) <= sum(x["count"] for x in shares) / 2
