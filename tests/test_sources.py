from __future__ import annotations

import json

from pyspark.sql import functions as F

from zonetide.sources import payloads as PL
from zonetide.sources import readers as R
from zonetide.sources import schemas as SCH
from zonetide.sources import writers as WR


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_zone_types_are_filled_by_name(spark, tmp_path):
    p = _write(tmp_path / "zones.csv", "zone_id,zone_name,region,lat,lon\n1,Orchard,Central,1.3,103.8\n2,Nowhere,West,1.4,103.7\n")
    assert {r["zone_name"]: r["zone_type"] for r in R.read_zones(spark, p).collect()} == {"Orchard": "CBD", "Nowhere": "mixed"}


def test_pings_headers_times_and_box(spark, tmp_path):
    p = _write(tmp_path / "pings.csv", " Latitude , LONGITUDE,timestamp\n1.30,103.80,2024-01-01T00:00:00Z\n9.0,103.8,2024-01-01T00:00:00Z\n,103.8,2024-01-01T00:00:00Z\n1.15,104.10,2024-01-01T08:00:00+08:00\n")
    rows = R.read_pings(spark, p).collect()
    assert len(rows) == 2 and len({r["timestamp"] for r in rows}) == 1


def test_snapshots_newest_and_file_times(spark, tmp_path):
    for m in (0, 5, 10):
        _write(tmp_path / f"2026-04-17_08-{m:02d}.csv", f"zone_id,zone_name,region,zone_type,taxi_count,timestamp\n1,a,East,CBD,{m},2026-04-17T00:{m:02d}:00Z\n")
    _write(tmp_path / "notes.csv", "zone_id,zone_name,region,zone_type,taxi_count,timestamp\n")
    snaps = R.read_snapshots(spark, str(tmp_path))
    assert snaps.count() == 3 and sorted(r["taxi_count"] for r in R.newest_snapshots(snaps, 2).collect()) == [5, 10]
    stamped = R.read_timed_files(spark, str(tmp_path))
    assert stamped.count() == 3 and {str(r["snap_ts"]) for r in stamped.collect()} == {"2026-04-17 00:00:00"}


def test_json_lines_skip_malformed(spark, tmp_path):
    p = _write(tmp_path / "runs.jsonl", '{"run_id":"a","timestamp":"2024-01-01T00:00:00"}\nnot json\n{"run_id":"b","timestamp":"2024-01-02T00:00:00","rows_scored":5}\n')
    log = R.read_json_lines(spark, p, SCH.RUN_LOG)
    assert log.count() == 2 and R.newest_lines(log, 1).first()["run_id"] == "b"


def test_score_history_survives_bad_keys(spark, tmp_path):
    lines = [{"timestamp": "2024-01-01T00:00:00+00:00", "zones": {"1": 0.5, "bad": "oops", "2": "oops"}, "taxi_counts": {"1": 7}}, {"timestamp": "?", "zones": {"1": 0.4}}]
    p = _write(tmp_path / "h.jsonl", "\n".join(map(json.dumps, lines)) + "\n{broken")
    rows = {r["zone_id"]: (r["score"], r["taxi_count"]) for r in R.read_score_history(spark, p).collect()}
    assert rows == {1: (0.5, 7), 2: (0.0, 0)}


def test_cards_keep_text_na(spark, tmp_path):
    p = _write(tmp_path / "cards.csv", 'zone_id,recommendation,intervention_window\n1,N/A,\n2,"say ""go""",x\n')
    rows = {r["zone_id"]: r for r in R.read_cards(spark, p).collect()}
    assert rows["1"]["recommendation"] == "N/A" and rows["1"]["intervention_window"] is None and rows["2"]["recommendation"] == 'say "go"'


def test_adjacency_forms(spark, tmp_path):
    p = _write(tmp_path / "adj.jsonl", '{"zone":"a","neighbors":["b","c"]}\n{"zone":"d","neighbors":null}\n')
    assert R.read_adjacency(spark, p).count() == 2
    q = _write(tmp_path / "adj.yaml", "# map\nAng Mo Kio:\n  - Bishan\n  - Yishun\nBedok: [Changi, 'Tampines']\nEmpty:\n")
    got = {(r["zone"], r["neighbor"]) for r in R.read_adjacency_text(spark, q).collect()}
    assert got == {("Ang Mo Kio", "Bishan"), ("Ang Mo Kio", "Yishun"), ("Bedok", "Changi"), ("Bedok", "Tampines")}


def test_holidays(spark, tmp_path):
    p = _write(tmp_path / "h.json", json.dumps({"result": {"records": [{"date": "2024-05-01", "holiday_name": "x"}, {"date": "junk"}]}}))
    assert [str(r["day"]) for r in R.read_holidays(spark, p).collect()] == ["2024-05-01"]
    q = _write(tmp_path / "l.json", json.dumps([{"date": "2024-05-01"}, {"date": "2024-12-25"}]))
    assert R.read_holidays(spark, q).count() == 2 and R.read_holidays(spark, None).count() == 33


def test_carpark_payload(spark, tmp_path):
    body = {"value": [{"CarParkID": "1", "Location": " 1.29  103.85 ", "AvailableLots": 12, "LotType": "C"}, {"CarParkID": "2", "Location": "", "AvailableLots": 3},
                      {"CarParkID": "3", "Location": "x y"}, {"CarParkID": "4", "Location": "1.3 103.8"}]}
    rows = PL.carparks(PL.read_payload(spark, _write(tmp_path / "c.json", json.dumps(body)), SCH.CARPARK_PAYLOAD)).orderBy("carpark_id").collect()
    assert [(r["carpark_id"], r["lat"], r["available_lots"], r["lot_type"]) for r in rows] == [("1", 1.29, 12, "C"), ("4", 1.3, 0, "C")]


def test_travel_weather_and_station_payloads(spark, tmp_path):
    t = PL.travel_times(PL.read_payload(spark, _write(tmp_path / "t.json", json.dumps({"value": [{"Name": "A", "StartPoint": "p", "EstTime": 4}]})), SCH.TRAVEL_PAYLOAD)).first()
    assert (t["expressway"], t["direction"], t["est_time"], t["end_point"]) == ("A", 1, 4.0, "")
    body = {"hourly": {"time": ["2024-01-01T08:00", "2024-01-01T09:00"], "temperature_2m": [28.0, 29.0], "precipitation": [0.0, 1.5], "weathercode": [0, 61], "windspeed_10m": [1.0, 2.0]}}
    w = PL.hourly_weather(PL.read_payload(spark, _write(tmp_path / "w.json", json.dumps(body)), SCH.WEATHER_PAYLOAD)).orderBy("timestamp").collect()
    assert str(w[0]["timestamp"]) == "2024-01-01 00:00:00" and [r["is_raining"] for r in w] == [False, True]
    s = PL.station_readings(PL.read_payload(spark, _write(tmp_path / "s.json", json.dumps({"items": [{"readings": [{"station_id": "S1", "value": 2.0}, {"station_id": "S2"}]}]})), SCH.STATION_PAYLOAD))
    assert PL.reading_of(s, "S1").first()[0] == 2.0 and PL.reading_of(s, "S9").first()[0] == 0.0


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "zone_id int")
    WR.write_failed_rows(empty, str(tmp_path / "failed"))
    df = spark.createDataFrame([(1, 'a "b", c', float("nan"))], "zone_id int, note string, v double")
    WR.write_csv(df.select("zone_id", "note"), str(tmp_path / "csv"), quote_all=True)
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert '"1","a ""b"", c"' in text
    WR.append_log(df.select("zone_id", "note"), str(tmp_path / "log"), F.lit("2024-01-01").cast("timestamp"))
    WR.append_log(df.select("zone_id", "note"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert json.loads(WR.json_text(df, ["zone_id", "v"]).first()["json"]) == {"zone_id": 1, "v": None}
    WR.write_predictions(df.withColumn("timestamp", F.lit("2024-01-01 05:00:00").cast("timestamp")), str(tmp_path / "pred"), "run1")
    assert R.parquet(spark, str(tmp_path / "pred")).filter("run_date = date'2024-01-01'").count() == 1
    WR.write_table(df, str(tmp_path / "t"))
    assert R.parquet(spark, str(tmp_path / "t")).count() == 1
    assert WR.audit_event(spark, "rollback", "v2", None, "why", "r", "2024-01-01").first()["to_version"] is None


def test_timed_files_come_back_and_other_names_are_passed_over(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:30:00", 5), (2, "2024-01-01 00:30:00", 6), (1, "2024-01-02 04:45:00", 7)], "zone_id long, t string, lots int")
    at = str(tmp_path / "timed")
    WR.write_timed_files(rows.select("zone_id", F.col("t").cast("timestamp").alias("snap_ts"), "lots"), at)
    (tmp_path / "timed" / "notes.csv").write_text("zone_id,lots\n9,9\n")
    assert {p.name for p in (tmp_path / "timed").glob("2024*")} == {"2024-01-01_08-30.csv", "2024-01-02_12-45.csv"}
    got = sorted((r["zone_id"], str(r["snap_ts"]), r["lots"]) for r in R.read_timed_files(spark, at, schema="zone_id long, lots int").collect())
    assert got == [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-02 04:00:00", 7), (2, "2024-01-01 00:00:00", 6)]
