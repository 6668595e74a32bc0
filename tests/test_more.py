"""Loaders, search, exports, incremental state and resampling on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from backline.functions import text as T
from backline.operators import boxoffice as B
from backline.operators import categorise as G
from backline.operators import events as E
from backline.operators import market as M
from backline.operators import models as X
from backline.operators import search as Q
from backline.operators import venues as V
from backline.sources import ingest
from backline.sources import loaders as L
from backline.streaming import upserts


def test_loaders_refuse_what_lacks_columns(spark, tmp_path):
    (tmp_path / "runs.csv").write_bytes("﻿Start Date,Headliner,Venue,Number of Shows\n3/4/2021,\"The Act\nagain\",Hall,\n,Act,Hall,3\n13/12/2020,X,,2\n".encode())
    rows = L.box_office(L.sheet(spark, str(tmp_path / "runs.csv"))).orderBy("start_iso").collect()
    assert [(r.start_iso, r.end_iso, r.n_shows, r.headliner_norm, r.venue) for r in rows] == [("2020-12-13", "2020-12-13", 2, "x", ""), ("2021-03-04", "2021-03-04", 1, "act again", "Hall")]
    with pytest.raises(ValueError, match="venue"):
        L.box_office(spark.createDataFrame([("a", "b")], "headliner string, `start date` string"))
    with pytest.raises(ValueError):
        L.arenas(spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(ValueError, match="incomplete"):
        L.best_ranks(spark.createDataFrame([("a", 1, 2)], "artist_key string, rank int, listeners int"))
    assert L.safe_headers([" Name ", "name", "Cap. (max)", "", None]) == ["name", "name_2", "cap_max", "col", "col_2"]
    assert L.newest(["x/a_2024-01.csv", "y/a_2025-01.csv"]).startswith("y")
    with pytest.raises(ValueError):
        L.newest([])


def test_csv_and_reports(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a,\"b\"\nc"), (2, None)], "id int, v string")
    ingest.write_report({"one": frame}, str(tmp_path / "r"), {"what": "why"})
    assert {r.id for r in ingest.read_csv(spark, str(tmp_path / "r" / "one"), "id int, v string").collect()} >= {1, 2}
    assert spark.read.json(str(tmp_path / "r" / "methodology")).first().text == "why"


def test_export_is_sorted_text(spark, tmp_path):
    e = spark.createDataFrame([("2024-02-01", "b", "B", None), ("2024-01-01", "z", "A", 3), ("2024-01-01", "a", "C", 4)], "date_iso string, venue_key string, event_id string, n_artists int")
    E.write_export(e, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*.csv")) for x in f.read_text().splitlines() if not x.startswith("source,")]
    at = E.EXPORT_COLUMNS.index("event_id")
    assert [x.split(",")[at] for x in lines] == ["C", "A", "B"] and len(E.EXPORT_COLUMNS) == 44
    assert lines[0].split(",")[2] == "01-01-2024" and lines[2].split(",")[6] == ""


def test_names_of_places(spark):
    places = spark.createDataFrame([("IT", "Milan", 9), ("GB", "London", 8), ("CA", "london", 3), ("GB", "Londonderry", 1)], "country string, city string, events int")
    assert Q.resolve(places, " MILAN ") == ("IT", "Milan")
    assert Q.resolve(places, "london", "ca") == ("CA", "london")
    with pytest.raises(Q.Ambiguous, match="GB, CA"):
        Q.resolve(places, "London")
    with pytest.raises(Q.Unknown, match="London, GB"):
        Q.resolve(places, "ondon")
    members = spark.createDataFrame([("IT", "Assago", "Milan")], "country string, city string, market string")
    assert Q.resolve(places, "assago", members=members) == ("IT", "Milan")
    assert Q.categories() == ["Category A", "Category B", "Category C"] and len(Q.categories(["all"])) == 8
    with pytest.raises(ValueError):
        Q.categories(["Z"])


def test_functions_for_sql(spark):
    T.register(spark)
    row = spark.sql("SELECT norm_key('The Beyoncé & Co'), genre_class('rock, Basketball'), event_type_for_genre('Comedy'), event_type_for_genre('Pop')").first()
    assert tuple(row) == ("beyonce and co", "Sport", T.OTHER_TYPE, None)


def test_scraped_tables(spark):
    html = "<table><TR><th>Artist</th><th>#</th><th>Listeners</th></TR><tr><td><a href='q'>A&amp;B</a></td><td>1</td><td>1,200</td></tr><tr><td> </td><td>2</td><td>x</td></tr></table><p>no</p>"
    rows = L.listeners_table(L.html_table(spark.createDataFrame([(1, html), (2, "<tr><td>no header</td></tr>"), (3, None)], "page_id int, html string"))).collect()
    assert [(r.page_id, r["rank"], r.artist, r.listeners) for r in rows] == [(1, 1, "A&B", 1200)]


def test_sync_log(spark, tmp_path):
    log = str(tmp_path / "log")
    upserts.logged_sync(spark, log, "one", lambda: None)
    with pytest.raises(ZeroDivisionError):
        upserts.logged_sync(spark, log, "two", lambda: 1 / 0)
    runs = {r.run: r for r in upserts.read_log(spark, log).collect()}
    assert runs["one"].completed_at is not None and runs["two"].completed_at is None
    seen = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "last_updated timestamp")
    assert upserts.sync_from(upserts.read_log(spark, log), seen) == runs["one"].started_at - dt.timedelta(hours=1)
    none = spark.createDataFrame([], "started_at timestamp, completed_at timestamp")
    assert upserts.sync_from(none, seen) == dt.datetime(2024, 1, 1)
    assert upserts.sync_from(none, seen.limit(0)) is not None


def test_upserts_touch_their_buckets(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "key string, version int, source string"
    put = lambda n, rows: upserts.merge_batch(spark.createDataFrame(rows, schema), n, root, schema, "key", "version", "source", buckets=4)
    put(0, [(f"k{i}", 1, "csv") for i in range(40)])
    before = upserts._folders(spark, root, upserts._versions(spark, root)[-1])
    put(1, [("k3", 2, "csv")])
    after = upserts._folders(spark, root, upserts._versions(spark, root)[-1])
    assert sum(before[b] != after[b] for b in before) == 1
    put(2, [("k3", 3, "csv"), ("k4", 0, "csv")])
    put(2, [("k3", 3, "csv"), ("k4", 0, "csv")])
    got = {r.key: r.version for r in upserts.current(spark, root, schema).collect()}
    assert len(got) == 40 and got["k3"] == 3 and got["k4"] == 1
    assert len(upserts._versions(spark, root)) == upserts.KEPT_VERSIONS
    assert upserts.current(spark, str(tmp_path / "none"), schema).count() == 0


def test_discovery_goes_by_venues(spark):
    bills = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (3, "d"), (5, "d")], "artist int, venue string")
    got = {r.artist: r.found_in for r in Q.discover(bills, bills.where("artist = 1"), rounds=5).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 5: 3}


def test_quantile_bins_and_residuals(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(5.0,)] * 30, "x double")
    bins = {r.x: r.bin for r in B.quantile_bin(rows, "x", 4).collect()}
    assert bins[1.0] == 0 and bins[10.0] == max(bins.values()) and len(set(bins.values())) <= 4
    rated = B.performance(spark.createDataFrame([(f"v{i}", 600 + i, float(i), 9) for i in range(20)] + [("small", 10, 50.0, 9), ("over", 900, 120.0, 9)], "venue string, capacity int, pct double, events int")).collect()
    assert len(rated) == 20 and {r.band for r in rated} >= {"bottom 10%", "top 10%"}
    assert max(rated, key=lambda r: r.residual_pp).percentile == 0.975


def test_bootstrap_spreads_around_the_effect(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(f"u{u}", t, float(10 + r.normal(0, 1) + (4 if u % 2 and t >= 2018 else 0)), 2018 if u % 2 else 0) for u in range(80) for t in range(2014, 2022)]
    panel = spark.createDataFrame(rows, "unit string, time int, y double, cohort int")
    draws = [x.att for x in X.bootstrap(panel, draws=40).collect()]
    assert len(draws) == 40 and abs(sum(draws) / 40 - X.overall_att(X.att_gt(panel)).first()["att"]) < 0.2 and 0.02 < np.std(draws) < 0.6


def test_markets_meet_across_the_date_line(spark):
    points = spark.createDataFrame([(1, "FJ", -17.0, 179.9, 5), (2, "FJ", -17.0, -179.95, 7), (3, "FJ", 40.0, 0.0, 9), (4, "FJ", 89.9, 10.0, 1)], "point int, country string, lat double, lon double, population int")
    markets = spark.createDataFrame([("FJ", "west", -17.0, 179.5), ("FJ", "east", -17.0, -179.5), ("FJ", "pole", 89.9, -170.0)], "country string, city string, lat double, lon double")
    assert {r.point: r.market for r in M.nearest_market(points, markets).collect()} == {1: "west", 2: "east", 4: "pole"}


def test_suspects_and_verify(spark):
    nights = spark.createDataFrame([("a", 1)] * 6 + [("b", 1), ("b", 2), ("c", 3)], "artist_key string, venue_no int")
    assert {r.artist_key: (r.nights, r.venues) for r in G.suspects(nights, 5, 1).collect()} == {"a": (6, 1), "b": (1, 1)}
    artists = spark.createDataFrame([("a", "Category A"), ("b", "Category B"), ("c", None)], "artist_key string, category string")
    sheet = spark.createDataFrame([("a", "Category A"), ("b", "Category C"), ("c", None)], "artist_key string, category string")
    assert [tuple(r) for r in G.verify(artists, sheet).collect()] == [("b", "Category B", "Category C")]


def test_aliases_and_clashes(spark):
    rows = spark.createDataFrame([("x", 1, "Rome", "identity"), ("x", 1, "Rome", "name"), ("x", 2, "Oslo", "manual"), ("y", 3, "A", "name"), ("", 4, "A", "name")], "alias_norm string, arena_id int, city string, source string")
    got = {(r.alias_norm, r.arena_id): (r.source, r.ambiguous) for r in V.arena_aliases(rows).collect()}
    assert got == {("x", 1): ("name", 1), ("x", 2): ("manual", 1), ("y", 3): ("name", 0)}
    edges = spark.createDataFrame([("a", "p", 2), ("a", "q", 1), ("b", "p", 0), ("b", "p", 3)], "alias string, canonical string, trust int")
    assert [tuple(r) for r in V.clashes(edges).collect()] == [("a", "q", 1, 1)]
    assert [r.k for r in V.remap(spark.createDataFrame([(1,), (2,)], "k int"), "k", spark.createDataFrame([(1, 9)], "alias int, survivor int")).orderBy("k").collect()] == [2, 9]
    folds = V.fold_table(spark.createDataFrame([("a", "m", "IT", "a"), ("b", "m", "IT", "a")], "alias_norm string, city_norm string, countryCode string, canonical_norm string"))
    assert folds.count() == 1


def test_slugs_and_days(spark):
    from backline.functions import scalar as S

    row = spark.createDataFrame([(" Cap. (max) ", 60, 366)], "s string, d int, e int").select(T.slug(F.col("s")), S.first_of_year_day(F.col("d")), S.first_of_year_day(F.col("e"))).first()
    assert tuple(row) == ("cap_max", "29 Feb", "31 Dec")
