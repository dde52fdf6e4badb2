"""A vessel that names a port again keeps what it declared before."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidewater.plans import gold

T = datetime(2016, 1, 1)


def test_earlier_calls_of_a_port_named_again_are_kept(spark):
    at = lambda days: T + timedelta(days=days)
    decl = spark.createDataFrame(
        [
            (1, 7, "ROTTERDAM", "ROTTERDAM", at(2), at(0), "NLRTM", "Rotterdam", 52.0, 4.0),
            (2, 7, "ROTTERDAM", "ROTTERDAM", at(2), at(1), "NLRTM", "Rotterdam", 52.0, 4.0),
            (3, 7, "ROTTERDAM", "ROTTERDAM", at(42), at(40), "NLRTM", "Rotterdam", 52.0, 4.0),
            (4, 7, "NL RTM", "ROTTERDAM", at(42), at(38), "NLRTM", "Rotterdam", 52.0, 4.0),
            (5, 7, "ROTTERDAM", "ROTTERDAM", None, at(60), "NLRTM", "Rotterdam", 52.0, 4.0),
        ],
        "decl_id long, mmsi long, dest_raw string, dest_clean string, eta timestamp, static_ts timestamp, port_lo string, port_name string, port_lat double, port_lon double",
    )
    fixes = spark.createDataFrame([(1, 7, at(3), 52.0, 4.0, 0.2), (2, 7, at(41), 52.0, 4.0, 0.2)], "row_id long, mmsi long, ts timestamp, lat double, lon double, sog double")
    d = gold.declarations_by_eta(decl)
    assert sorted((r.eta, r.static_ts) for r in d.collect()) == [(at(2), at(1)), (at(42), at(38)), (at(42), at(40))]
    span = gold.span_of(fixes)
    w = gold.positions_in_window(fixes, d, span)
    assert sorted(r.row_id for r in w.collect()) == [1, 2, 2]
    (call,) = gold.port_calls(w, fixes, span).collect()
    assert call.arrival_ts == at(3)


def test_stops_without_a_row_for_each_declaration(spark, data):
    m, decl = (spark.read.parquet(f"{data}/{k}.parquet") for k in ("messages", "matched_decl"))
    fixed, span = gold.fixes(m), gold.span_of(m)
    for d in (gold.declarations_by_eta(decl), gold.declarations_by_eta(decl.where("decl_id % 3 = 0"))):
        calls = [sorted(map(repr, gold.geofenced(w).collect())) for w in (gold.positions_in_window(fixed, d, span), gold.first_slow(fixed, d, span))]
        assert calls[0] == calls[1] != []
        want = gold.stop_events(gold.positions_in_window(fixed, d, span))
        got = gold.stop_events_of(fixed, d).select(want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
