"""Fixtures with known answers, parameter recovery and invariants."""

import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from backline.functions import scalar as S
from backline.functions import text as T
from backline.operators import categorise as G
from backline.operators import choice as C
from backline.operators import events as E
from backline.operators import identity as I
from backline.operators import market as M
from backline.operators import models as X
from backline.operators import reports as R
from backline.operators import venues as V
from backline.plans import choice_queries
from backline.plans.domain import Domain
from backline.sources import ingest
from backline.streaming import upserts

ROOT = Path(__file__).resolve().parents[1]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_names(spark):
    names = ["  The Beyoncé & JAY-Z ", "A$AP  Rocky", "Ｆｕｌｌ ﬁ", None, "", "Øya—Festival", "the the"]
    assert column(spark, names, T.norm_key) == ["beyonce and jay z", "asap rocky", "full fi", None, "", "øya festival", "the"]
    assert column(spark, ["PalaAlpitour", "Palazzo Te", "Palazzo dello Sport", "Hyde Park", "Teatro Antico", "Blue Note Club", "Nowhere", None], T.io_from_name) == ["inside", "inside", "inside", "outside", "outside", "inside", None, None]
    assert column(spark, ["rock, Basketball", "Sports Entertainment", None, "Comedy, Family Entertainment"], T.genre_class) == ["Sport", "Entertainment", "Music", "Comedy"]
    assert column(spark, ["academy 2", "ao arena", "music lounge", "hall iii"], T.is_subroom) == [True, False, True, True]
    assert column(spark, ["‘x’  y ", None], T.harvest_name) == ["'x' y", None]
    assert T.ratio("lewenstein", "levenshtein") == pytest.approx(85.714, abs=1e-3)
    assert T.token_set_ratio("ao arena", "arena ao manchester") == 100.0 and T.token_set_ratio("", "x") == 0.0


def test_scalars(spark):
    assert column(spark, ["3/4/2021", "2021-03-04", "31/12/2020", "3/4/21", "soon", None, "1/2/99"], S.parse_date) == ["2021-03-04", "2021-03-04", "2020-12-31", "2021-03-04", "", "", "1999-01-02"]
    assert column(spark, ["05-04-2021", "2021", None], S.flip_date)[:2] == ["2021-04-05", ""]
    assert column(spark, ["$1,200", "45%", "N/A", "-"], S.parse_number) == [1200.0, 45.0, None, None]
    assert column(spark, [0, 999, 1000, 59_999, 60_000, None], lambda c: S.band(c, S.CAPACITY_BANDS), "bigint") == ["under 1,000", "under 1,000", "1,000-2,499", "40,000-59,999", "60,000+", "capacity unknown"]
    assert column(spark, [500, 501, 1500, 200_001], lambda c: S.right_closed(c, S.GROSS_BANDS), "bigint") == [None, "(500, 1500]", "(500, 1500]", None]
    tiers = spark.createDataFrame([(None, None, "E"), (40_000_000, None, "A"), (5, 50, "A"), (10_000_000, None, "B"), (1_000_000, 101, "C"), (None, 101, "D")], "l long, r int, t string")
    assert [r[0] for r in tiers.select(S.classify_tier(F.col("l"), F.col("r"))).collect()] == [r.t for r in tiers.collect()]
    assert column(spark, ["GB", "TR", "US", "ZZ"], S.continent) == ["Europe", "Asia", "North America", None]
    near = spark.range(1).select(S.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278))).first()[0]
    assert near == pytest.approx(343.6, abs=0.5)
    d = lambda x: F.lit(x).cast("date")
    spans = spark.range(1).select(S.overlap_fraction(d("2020-01-01"), d("2020-01-11"), d("2020-01-06"), d("2020-02-01")), S.gap_days(d("2020-01-01"), d("2020-01-05"), d("2020-01-15"), d("2020-02-01"))).first()
    assert tuple(spans) == (0.5, 10.0)
    grades = spark.createDataFrame([(10.0, 1.1, 30.0, "high"), (10.0, 1.1, 0.0, "low"), (10.0, 2.0, 30.0, "medium"), (90.0, 1.0, 30.0, "low"), (10.0, None, None, "low"), (10.0, 1.0, None, "medium")], "m double, r double, g double, e string")
    assert all(r[0] == r.e for r in grades.select(S.rename_grade(F.col("m"), F.col("r"), F.col("g")), "e").collect())


def test_country_backfill(spark):
    rows = [(f"s{i}", "United States", "US") for i in range(10)] + [("sX", "United States", "XX"), ("s20", "Czechia", "CZ"), ("t1", "Ruritania", "RU"), ("t2", "Ruritania", "RT")]
    rows += [("p1", "United States", None), ("p2", "Czech Republic", None), ("p3", "Hong Kong", ""), ("p4", "Atlantis", None), ("p5", "Ruritania", None)]
    fallbacks = spark.createDataFrame([("Czech Republic", "CZ"), ("Hong Kong", "HK"), ("United States", "ZZ")], "country string, code string")
    out = E.backfill(spark.createDataFrame(rows, "id string, country string, code string"), "country", "code", fallbacks)
    got = {r.id: r.code for r in out.collect()}
    assert [got[k] for k in ("s0", "sX", "s20", "t1", "p1", "p2", "p3", "p4", "p5")] == ["US", "XX", "CZ", "RU", "US", "CZ", "HK", None, None]


def test_aliases_stay_in_their_city(spark):
    aliases = spark.createDataFrame([("festhalle", "frankfurt", "Germany", "A-FFM", 1), ("festhalle messe frankfurt", "frankfurt", "Germany", "A-FFM", 0), ("o2 arena", "london", "United Kingdom", "A-O2", 0), ("motorpoint arena", "nottingham", "United Kingdom", "A-NOT", 1)], "norm string, city string, country string, arena_id string, generic int")
    events = [("e1", "festhalle", "frankfurt", "Germany"), ("e2", "festhalle", "bad urach", "Germany"), ("e4", "festhalle", "bern", "Switzerland"), ("e6", "o2 arena", "london", "United Kingdom"), ("e7", "motorpoint arena", "nottingham", "United Kingdom"), ("e8", "motorpoint arena", "sheffield", "United Kingdom"), ("e9", "festhalle", "frankfurt am main", "Germany")]
    got = {r.event_id: r.arena_id for r in I.alias_passes(spark.createDataFrame(events, "event_id string, norm string, city string, country string"), aliases).collect()}
    assert got == {"e1": "A-FFM", "e2": None, "e4": None, "e6": "A-O2", "e7": "A-NOT", "e8": None, "e9": "A-FFM"}


def test_merge_and_chains(spark):
    edges = spark.createDataFrame([(1, 2, 0), (3, 2, 1), (5, 6, 0), (6, 7, 2)], "alias bigint, canonical bigint, trust int")
    c = {r.node: r.component for r in I.connected_components(edges, "alias", "canonical").collect()}
    assert c == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    weights = spark.createDataFrame([(1, 5), (2, 5), (3, 1), (5, 0), (6, 9), (7, 1)], "node bigint, weight int")
    s = {r.node: r.survivor for r in I.survivors(I.connected_components(edges, "alias", "canonical"), weights).collect()}
    assert s == {1: 1, 2: 1, 3: 1, 5: 6, 6: 6, 7: 6}
    chains = {r.alias: r.survivor for r in I.resolve_chains(edges).collect()}
    assert chains == {1: 2, 3: 2, 5: 6, 7: 6}
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in I.connected_components(path).collect()} == {0}


def test_dedup_verdict(spark):
    cols = "keep_norm string, fold_norm string, city string, keep_capacity long, fold_capacity long, overlap double, starts string"
    rows = [
        ("club", "club 11", "amsterdam", 10, 10, -1.0, "separate: a name too"), ("fillmore", "fillmore west", "sf", 10, 10, -1.0, "separate: a word"), ("o2 academy 2", "academy", "liverpool", 10, 10, -1.0, "separate: a number"),
        ("paramount", "paramount lounge", "x", 10, 10, 0.9, "separate: a smaller room, in"), ("ao dome", "men dome", "x", 100, 10, 0.9, "separate: in use at the same time, one"), ("ao dome", "men dome", "x", 100, 99, -0.5, "merge: a new sponsor"),
        ("paramount", "paramount theatre", "x", 1, None, None, "merge: descriptive"), ("garage ludlow", "garage ludlow cincinnati", "cincinnati", 1, None, -1.0, "merge: descriptive"), ("aa bb", "aa cc", "x", 100, 120, -1.0, "merge: spans apart"), ("aa bb", "aa dd", "x", None, 120, -1.0, "review: spans"), ("aa bb", "aa ee", "x", 100, 300, -1.0, "review: unclear"),
    ]
    frame = spark.createDataFrame(rows, cols)
    assert all(r.verdict.startswith(r.starts) for r in I.dedup_verdict(frame).collect())
    hand = spark.createDataFrame([("aa ee", "aa bb", True, "same hall")], "one string, two string, merge boolean, why string")
    assert [r.verdict for r in I.dedup_verdict(frame, hand).where("fold_norm = 'aa ee'").collect()] == ["merge: by hand, same hall"]


def test_trim_and_tenants(spark):
    caps = spark.createDataFrame([("a", v) for v in (1000, 1100, 1200, 1000, 90000)] + [("b", 5), ("b", 500)], "k string, v bigint")
    got = {r.k: (r.capacity, r.rejected) for r in E.trimmed_capacity(caps, "k", "v").collect()}
    assert got == {"a": (1200, 90000), "b": (500, None)}


def test_routes_keep_the_traps(spark):
    rows = spark.createDataFrame([("t", "1", "Rome"), ("t", "2", None), ("t", "3", "Bari"), ("", "4", "Oslo")], "tour string, day string, city string")
    got = {r.day: (r.previous_city, r.next_city) for r in E.route(rows, ["tour"], ["day"]).collect()}
    # A missing city in mid-tour reads as the first or final show.
    assert got == {"1": ("First Show", "Final Show"), "2": ("Rome", "Bari"), "3": ("First Show", "Final Show"), "4": ("", "")}


def test_upserts_in_any_order(spark):
    rows = [("k", 1, "api", "x"), ("k", 9, "csv", "y"), ("k", 2, "api", "z"), ("m", 1, "csv", "p"), ("m", 3, "csv", "q")]
    random.Random(1).shuffle(rows)
    frames = [spark.createDataFrame([r], "key string, version int, source string, v string") for r in rows]
    table = frames[0].limit(0)
    for f in frames + frames[:2]:
        table = E.upsert(table, f, "key", "version", "source")
    assert sorted((r.key, r.v) for r in table.collect()) == [("k", "z"), ("m", "q")]


def test_stream(spark, tmp_path):
    schema = "key string, version int, source string"
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[("a", 1, "csv"), ("b", 1, "api")], [("a", 2, "csv"), ("b", 5, "csv")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in{i}"))
        for f in (tmp_path / f"in{i}").glob("part*"):
            shutil.copy(f, tmp_path / "in" / f"{i}.json")
        q = upserts.upsert_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), schema, "key", "version", "source")
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in upserts.current(spark, str(tmp_path / "t"), schema).collect()) == [("a", 2, "csv"), ("b", 1, "api")]


def test_ingest(spark, tmp_path):
    item = {"id": "s1", "eventDate": "05-04-2021", "artist": {"name": "A", "mbid": "m"}, "venue": {"id": "v", "name": "Hall", "city": {"name": "Rome", "country": {"code": "IT", "name": "Italy"}, "coords": {"lat": 1.5, "long": 2.5}}}, "sets": {"set": [{"song": [{"name": "x"}, {"name": "y", "tape": True}]}, {"encore": 1, "song": [{"name": "z", "cover": {"name": "B"}}]}]}}
    raw = spark.createDataFrame([(json.dumps(item),), ("{}",), (None,)], "json string")
    flat = ingest.flatten_setlists(raw).collect()
    assert [(r.setlist_id, r.date_iso, r.num_songs, r.countryCode, r.latitude, r.tour) for r in flat] == [("s1", "2021-04-05", 3, "IT", 1.5, "")]
    assert [(r.position, r.set_no, r.name, r.tape, r.cover_of) for r in ingest.explode_songs(raw).orderBy("position").collect()] == [(1, 1, "x", 0, None), (2, 1, "y", 1, None), (3, 2, "z", 0, "B")]
    pages = {"2021-04-05": [[item], [item, item], []], "2021-04-06": [[item]]}
    (tmp_path / "pages.json").write_text(json.dumps(pages))
    spark.dataSource.register(ingest.PagedDates)
    read = spark.read.format("paged_dates").option("pages", str(tmp_path / "pages.json"))
    assert sorted((r.day, r.page) for r in read.load().collect()) == [("2021-04-05", 1), ("2021-04-05", 2), ("2021-04-05", 2), ("2021-04-06", 1)]
    assert {r.day for r in read.option("done", "2021-04-05").load().collect()} == {"2021-04-06"}
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert ingest.append_new(one, str(tmp_path / "sink"), "id") == 2 and ingest.append_new(one.union(one.limit(0)), str(tmp_path / "sink"), "id") == 0
    ingest.write_snapshot({"one": one}, str(tmp_path / "snap"), "2026-01")
    assert ingest.read_snapshot(spark, str(tmp_path / "snap"))["one"].count() == 2


def test_categorise(spark):
    artists = spark.createDataFrame([("beyoncé", "Beyoncé", 3, 3, 1), ("hawks", "Hawks", 20, 5, 9), ("jokes", "Jokes", 2, 2, 1), ("nobody", "Nobody", 1, 1, 1), ("queen b", "Queen B", 1, 1, 1)], "artist_key string, name string, shows int, venues int, most_at_one int")
    audience = spark.createDataFrame([("beyonce", 50_000_000, 1)], "artist_key string, listeners long, place int")
    charts = spark.createDataFrame([("jokes", 10, 1)], "artist_key string, chart_rank int, place int")
    genres = spark.createDataFrame([("hawks", "Basketball", 1), ("jokes", "Comedy", 2)], "artist_key string, genre string, place int")
    aliases = spark.createDataFrame([("Queen B", "beyonce")], "name string, artist_key string")
    got = {r.artist_key: (r.category, r.match_method) for r in G.categorise(artists, audience, charts, genres, aliases).collect()}
    assert got == {"beyoncé": ("Category A", "norm"), "hawks": ("Tenant Sporting Event", "none"), "jokes": (T.OTHER_TYPE, "exact"), "nobody": ("Category E", "none"), "beyonce": ("Category A", "manual")}


def test_geo(spark):
    r = random.Random(3)
    towns = [("X", f"t{i}", 45 + r.random(), 5 + r.random(), r.randint(1, 50)) for i in range(30)]
    points = [(i, "X", 45 + r.random(), 5 + r.random(), r.randint(1, 9)) for i in range(200)]
    c = spark.createDataFrame(towns, "country string, city string, lat double, lon double, events int")
    p = spark.createDataFrame(points, "point int, country string, lat double, lon double, population bigint")

    def km(a, b, x, y):
        a, b, x, y = map(np.radians, (a, b, x, y))
        return 2 * 6371 * np.arcsin(np.sqrt(np.sin((x - a) / 2) ** 2 + np.cos(a) * np.cos(x) * np.sin((y - b) / 2) ** 2))

    got = {r.city: r.pop_30 for r in M.radius_catchment(c, p).collect()}
    assert got == {t[1]: sum(q[4] for q in points if km(t[2], t[3], q[2], q[3]) <= 30) for t in towns}
    near = {r.point: r.market for r in M.nearest_market(p, c).collect()}
    assert near == {q[0]: min(towns, key=lambda t: km(t[2], t[3], q[2], q[3]))[1] for q in points}
    folded = {r.city: r.market for r in M.fold_markets(c, 15.0).collect()}
    where = {t[1]: t for t in towns}
    founders = [t for t in towns if folded[t[1]] == t[1]]
    assert all(km(*where[a][2:4], *where[b][2:4]) <= 15 for a, b in folded.items())
    assert all(km(*a[2:4], *b[2:4]) > 15 for a in founders for b in founders if a != b)
    rows = spark.createDataFrame([(i, "X", 45.0 + i * 0.0001, 5.0) for i in range(10)], "venue_no int, country string, lat double, lon double")
    assert {(r.venue_no, r.other) for r in I.colocated(rows).collect()} == {(a, b) for a in range(10) for b in range(10) if a < b and (b - a) * 11.12 <= 25}


def test_logit_recovers_its_parameters(spark):
    draw, true = np.random.default_rng(0), np.array([1.5, -0.8, 0.4])
    x = draw.normal(size=(1500, 12, 3))
    v = x @ true + draw.gumbel(size=(1500, 12))
    pick = v.argmax(1)
    rows = [(o, a, *map(float, x[o, a]), int(pick[o] == a)) for o in range(1500) for a in range(12)]
    frame = spark.createDataFrame(rows, "occasion int, alt int, a double, b double, c double, y int").cache()
    fit = X.fit_logit(frame, ["a", "b", "c"], "occasion", "y", "occasion")
    assert np.abs(fit.beta - true).max() < 0.2 and 0 < fit.pseudo_r2 < 1
    s = fit.summary()
    assert (np.abs(s["beta"] - true) <= 1.5 * (s["high"] - s["low"]) / 2).all()


def test_logit_leaves_out_what_the_rows_do_not_tell(spark):
    """A variable that is the same for a group's rows, or made up of others, takes no effect and doesn't fail the fit."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 6, 2))
    pick = (x @ np.array([1.0, -0.5]) + draw.gumbel(size=(400, 6))).argmax(1)
    rows = [(o, *map(float, x[o, a]), float(2 * x[o, a, 0] + 1), 3.3 + o % 5, 0.0, int(pick[o] == a)) for o in range(400) for a in range(6)]
    frame = spark.createDataFrame(rows, "occasion int, a double, b double, twice double, fixed double, none double, y int").cache()
    fit = X.fit_logit(frame, ["none", "a", "fixed", "b", "twice"], "occasion", "y", "occasion")
    plain = X.fit_logit(frame, ["a", "b"], "occasion", "y", "occasion")
    assert np.allclose(fit.beta, [0, plain.beta[0], 0, plain.beta[1], 0]) and fit.loglik == pytest.approx(plain.loglik)
    s = fit.summary().set_index("name")
    assert s.loc[["none", "fixed", "twice"]].isna().all(axis=None) and np.allclose(s.loc[["a", "b"]], plain.summary().set_index("name"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def bands(frame, fit, draws=300):
    """Mean, 5 % and 95 % of expected visits by city, an occasion at a time."""
    drawn = np.random.default_rng(0).multivariate_normal(fit.beta, fit.covariance, size=draws)
    sums = {}
    for _, menu in frame.groupby("occasion"):
        e = np.exp(menu[fit.names].to_numpy(float) @ drawn.T)
        for city, p in zip(zip(menu["country"], menu["city"], strict=True), e / e.sum(0), strict=True):
            sums[city] = sums.get(city, 0) + p
    return {c: (s.mean(), np.percentile(s, 5), np.percentile(s, 95)) for c, s in sums.items()}


def found(out):
    return {(r.country, r.city): (r["mean"], r.p5, r.p95) for r in out.collect()}


def same(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[c], b[c], rtol=1e-9) for c in a)


def test_expected_bands_take_every_draw(spark, monkeypatch):
    """The query's bands rest on 300 draws of the coefficients."""
    fit = X.LogitFit(C.NAMES, C.BETA_A, np.diag(np.square(C.BETA_A)) / 4, -1.0, -2.0, 1)
    monkeypatch.setattr(X, "fit_logit", lambda *args: fit)
    d = Domain(spark, "/root/testdata/sf0.001")
    want = bands(choice_queries.designed(d, C.NAMES)[0].toPandas(), fit)
    got = found(choice_queries.expected_bands(d))
    assert got and same(got, want)


def test_bands_of_menus_of_any_length(spark):
    """Menus of 1 to 1,200 alternatives, some longer than what is taken at a time, and more cities than are kept between sums."""
    draw = np.random.default_rng(3)
    lengths = [1, 2, 3, 3, 40, 1000, 1200, 2, 1200, 40] * 2
    rows = [(f"o{o}", f"X{o % 3}", f"c{a if o % 2 else 5000 - a}", *map(float, draw.normal(size=2) * 5)) for o, n in enumerate(lengths) for a in range(n)]
    frame = spark.createDataFrame(rows, "occasion string, country string, city string, a double, b double")
    fit = X.LogitFit(["a", "b"], [1.0, -0.5], [[0.04, 0.01], [0.01, 0.09]], -1.0, -2.0, 1)
    assert same(found(C.simulate(frame.coalesce(1), fit, ["country", "city"])), bands(frame.toPandas(), fit))
    assert found(C.simulate(frame.where("false"), fit, ["country", "city"])) == {}


def panel(spark, seed, effect, trend=0.0):
    r = np.random.default_rng(seed)
    rows = []
    for u in range(120):
        g = int(r.choice([0, 2016, 2018, 2020, 2022], p=[0.35, 0.16, 0.16, 0.16, 0.17]))
        base = r.normal(20, 6)
        for t in range(2012, 2027):
            y = base + 0.4 * (t - 2012) + r.normal(0, 1.5) + (effect(t - g) if g and t >= g else 0) + (trend * (t - g) if g else 0)
            rows.append((f"u{u}", t, float(y), g))
    return spark.createDataFrame(rows, "unit string, time int, y double, cohort int")


def test_differences(spark):
    steady = X.att_gt(panel(spark, 1, lambda k: 4.0))
    assert abs(X.overall_att(steady).first()["att"] - 4) < 0.6
    assert abs(X.overall_att(X.att_gt(panel(spark, 3, lambda k: 0.0))).first()["att"]) < 0.6
    growing = {r.event_time: r.effect for r in X.event_study(X.att_gt(panel(spark, 2, lambda k: 4.0 + k))).collect()}
    assert abs(growing[0] - 4) < 0.9 and growing[4] > growing[0] + 2
    leaning = X.att_gt(panel(spark, 4, lambda k: 0.0, 1.2))
    assert X.overall_att(leaning).first()["pretrend"] > 1.0
    flat = [r.detrended for r in X.detrend(X.event_study(leaning)).collect()]
    assert max(map(abs, flat)) < 3


def test_rooms_move_visits_the_right_way(spark):
    from backline.plans import choice_queries as Q
    from backline.plans.domain import Domain

    d = Domain(spark, "/root/testdata/sf0.001")
    rows, constants = Q.designed(d, C.NAMES)
    rows = rows.cache()
    city = rows.groupBy("city").count().orderBy(F.desc("count"), "city").first()["city"]
    here = F.col("city") == city
    gain = {r.city: r.gain for r in C.impact(rows, constants, C.BETA_A, here, 1, ["city"], "either").collect()}
    assert all(abs(g) < 1e-9 for g in gain.values())
    large = {r.city: r for r in C.impact(rows, constants, C.BETA_A, here, 20_000, ["city"]).collect()}
    assert sum(r.before for r in large.values()) == pytest.approx(sum(r.after for r in large.values()))
    swept = {r.size: r.expected for r in C.sweep(rows, constants, C.BETA_A, here, [1, 20_000]).collect()}
    assert swept[20_000] == pytest.approx(large[city].after) and swept[1] == pytest.approx(large[city].before)
    # A market never gains by the loss of its largest room.
    lost = C.without_largest(rows, constants, C.BETA_A, here, Q.menu(d)).where(here).agg(F.sum("p").alias("before"), F.sum("p_after").alias("after")).first()
    assert lost.after <= lost.before + 1e-9
    rows.unpersist()


def test_nearest_rooms(spark):
    ladder = spark.createDataFrame([("indoor", 2000.0, [500, 1000, 4000], [2100], 1000), ("outdoor", 2000.0, [500], [], 2100), ("either", 10.0, [], [], 500), ("indoor", None, [1], [1], None)], "plays string, need double, rin array<bigint>, rout array<bigint>, best bigint")
    rooms = F.array(*[F.lit(x).cast("bigint") for x in (500, 1000, 2100, 4000)])
    got = ladder.select(C.nearest_room(F.col("plays"), F.col("need"), F.col("rin"), F.col("rout"), rooms).alias("b"), "best").collect()
    assert [r.b for r in got] == [r.best for r in got]
    assert [r[0] for r in spark.sql("SELECT array(3, null, 1) a UNION ALL SELECT array(4, 1, 2, 3) UNION ALL SELECT cast(array() AS array<int>)").select(C.median_of(F.col("a"))).collect()] == [2.0, 2.5, None]


def test_long_ladders(spark):
    """The nearest room looks at the logarithm of a ladder's rooms, and finds what a look at all finds."""
    draw, rows = np.random.default_rng(2), []
    for i in range(300):
        top = [60, 300, 50_000, 3_000_000_000][i % 4]
        rows.append((float(draw.integers(0, 2 * top)) / 2, sorted(map(int, draw.integers(0, top, draw.integers(1, 300))))))
    frame = spark.createDataFrame(rows, "need double, rooms array<bigint>")
    all_of = F.array_min(F.transform("rooms", lambda r: F.struct(F.round(C.log_gap(r, F.col("need")), 9).alias("away"), r.alias("room"))))["room"]
    room = lambda: C.nearest_room(F.lit("either"), F.col("need"), F.col("rooms"), F.col("rooms"), F.col("rooms"))
    assert frame.where(~room().eqNullSafe(all_of)).count() == 0
    plan = frame.select(room())._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence" in plan and "array_min" not in plan


def test_malformed_dates_drop_out(spark):
    cols = "event_id string, date_iso string, tour string, city string, country string, venue string, capacity int, headliner_key string, venue_key string"
    rows = [("e1", "2024-02-30", "t", "Rome", "IT", "A", 1, "x", "a"), ("e2", "2024-03-01", "t", "Rome", "IT", "A", 1, "x", "a"), ("e3", "", "t", "Bari", "IT", "B", 1, "x", "b"), ("e4", "2024-03-05", "t", "Bari", "IT", "B", 1, "x", "b"), ("e5", None, "t", "Bari", "IT", "B", 1, "", "b")]
    e = spark.createDataFrame(rows, cols)
    assert [(r.event_id, r.to_event_id, r.days_between) for r in E.legs(e).collect()] == [("e2", "e4", 4)]
    assert sum(r.events for r in R.seasonality(e, "month").collect()) == 2
    runs = spark.createDataFrame([("p1", "x", "A", "Rome", "2024-02-28", "2024-02-31", 2, 1.0), ("p2", "x", "C", "Bari", "2024-03-06", None, 1, 2.0), ("p3", "x", "B", "Rome", "soon", "2024-03-09", 1, 3.0), ("p4", "", "A", "Rome", "2024-03-01", "2024-03-01", 1, 4.0)], "pid string, artist_key string, venue string, city string, start_iso string, end_iso string, n_shows int, gross_usd double")
    got = {r.event_id: (r.pid, r.tier, r.day_off) for r in E.match_runs(e, runs).collect()}
    assert got == {"e4": ("p2", 3, -1)}


def test_event_build_joins_its_nights_once(spark, tmp_path):
    """What follows the bills reads tables written on the way, and a chain of steps leaves its last table alone."""
    import __spark_entry__
    from backline.operators.identity import Steps
    from backline.plans.domain import Domain

    built = __spark_entry__.queries()["event_build"](spark, __spark_entry__.SMOKE_DIR)
    assert not [f for f in built.inputFiles() if "lineitem" in f]
    d = Domain(spark, __spark_entry__.SMOKE_DIR)
    assert sorted(map(tuple, E.match_by_tier(d.events(), d.runs()).collect())) == sorted(map(tuple, E.match_runs(d.events(), d.runs()).collect()))
    step = Steps()
    a = step(spark.range(10))
    b = step(a.withColumn("twice", F.col("id") * 2))
    assert b.agg(F.sum("twice")).first()[0] == 90
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|FILE_NOT_EXIST"):
        a.collect()


def test_matching_tiers(spark):
    e = spark.createDataFrame([(f"e{i}", "act", day, venue, city, arena) for i, (day, venue, city, arena) in enumerate([("2024-05-10", "Old Name", "Rome", 7), ("2024-05-10", "Hall", "Rome", None), ("2024-05-10", "Else", "Rome", None), ("2024-05-10", "Else", "Oslo", None), ("2024-04-30", "Hall", "Rome", 8)])], "event_id string, headliner_key string, date_iso string, venue string, city string, arena_id int")
    runs = spark.createDataFrame([("p1", "act", "New Name", "Rome", 7, "2024-05-01", "2024-06-30", 40), ("p2", "act", "Hall", "Rome", None, "2024-05-11", "2024-05-11", 1), ("p3", "act", "Hall", "Rome", None, "2024-05-10", "2024-05-10", 9)], "pid string, artist_key string, venue string, city string, arena_id int, start_iso string, end_iso string, n_shows int").withColumn("gross_usd", F.lit(1.0))
    got = {r.event_id: (r.pid, r.tier, r.day_off) for r in E.match_runs(e, runs).collect()}
    assert got == {"e0": ("p1", 1, 0), "e1": ("p3", 2, 0), "e2": ("p3", 3, 0), "e4": ("p1", 3, -1)}
    assert {r.pid for r in E.unmatched(runs, E.match_runs(e, runs)).collect()} == {"p2"}


def test_venues_merge_in_their_city_only(spark):
    cols = "venue string, venue_norm string, venue_key string, city string, city_norm string, country string, countryCode string, latitude double, longitude double, arena_id int, venue_type string, observed_capacity bigint, date_iso string"
    one = lambda v, c, key=None, cap=None, kind=None, arena=None: (v, v.lower(), key or f"{v}|{c}", c, c.lower(), "Italy", "IT", 1.0, 2.0, arena, kind, cap, "2024-01-01")
    rows = [one("Forum", "Milan", cap=1000, kind="Arena"), one("Unipol Forum", "Milan", cap=900), one("Unipol Forum", "Bologna"), one("Forum", "Milan", key="id1", cap=1100), one("Forum", "Milan", cap=90_000), one("Field", "Bari", kind="Stadium", cap=186_000), one("Club X", "Bari", kind="Club", cap=186_000, arena=5), one("", "Bari", key="raw")]
    aliases = spark.createDataFrame([("unipol forum", "milan", "IT", "forum")], "alias_norm string, city_norm string, countryCode string, canonical_norm string")
    events = V.with_uid(spark.createDataFrame(rows, cols), aliases)
    arenas = spark.createDataFrame([(5, 0, "", "")], "arena_id int, concert_capacity bigint, arena_type string, outside_inside string")
    looked = spark.createDataFrame([("forum|milan|IT", "matched", "Low", 9.0, 9.0, 5, "x", "Outside"), ("unipol forum|bologna|IT", "matched", "High", 7.0, 8.0, 4000, "Dome", "Inside")], "venue_uid string, status string, confidence string, latitude double, longitude double, capacity bigint, venue_type string, outside_inside string")
    identity = spark.createDataFrame([("The Forum", "forum", "milan", "IT")], "canonical string, canonical_norm string, city_norm string, countryCode string")
    got = {r.venue_uid: r for r in V.assemble(events, arenas, looked, identity, least_events=1).collect()}
    assert set(got) == {"forum|milan|IT", "unipol forum|bologna|IT", "field|bari|IT", "club x|bari|IT", "raw"}
    forum = got["forum|milan|IT"]
    assert (forum.venue, forum.events, forum.n_keys, forum.capacity, forum.cap_rejected, forum.capacity_source, forum.outside_inside) == ("The Forum", 4, 3, 1100, 90_000, "box office (outlier trimmed)", "Inside")
    assert (got["unipol forum|bologna|IT"].capacity_source, got["unipol forum|bologna|IT"].latitude) == ("lookup", 7.0)
    assert got["club x|bari|IT"].review_reason == "capacity implausible for venue type" and got["field|bari|IT"].needs_review == 0
    assert got["raw"].review_reason == "no capacity, no indoor/outdoor"
    attached = {(r.venue_key, r.venue_capacity) for r in V.attach(events, V.assemble(events, arenas, looked)).collect()}
    assert ("id1", 1100) in attached and ("raw", None) in attached


def test_places_by_partition(spark):
    rows = spark.range(1000).select("id", ((F.col("id") * 7919) % 997).alias("v"))
    got = {r.id: r.place for r in R.ranked(rows, F.desc("v"), "id").collect()}
    assert got == {i: n + 1 for n, i in enumerate(sorted(range(1000), key=lambda i: (-(i * 7919 % 997), i)))}


def test_reports(spark):
    e = spark.createDataFrame([("e1", "2024-02-29", "Rome", "inside", "t"), ("e2", "2024-03-01", None, "outside", "t"), ("e3", "2024-12-31", "Rome", None, "")], "event_id string, date_iso string, city string, io string, tour string")
    assert {r.city: (r.inside, r.outside, r["all"]) for r in R.pivot_counts(e, "city", "io", ["inside", "outside"]).collect()} == {"Rome": (1, 0, 2)}
    days = {r.day: r.events for r in R.seasonality(e, "day").collect()}
    assert len(days) == 366 and days[60] == 1 and days[366] == 1 and sum(days.values()) == 3


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() for k in q), set(e.oracle_sql()) <= set(q))"
    for left in (None, "backline/llm/__pycache__"):
        if left:
            (tmp_path / "repo" / left).mkdir(parents=True)
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        assert out.stdout.split()[1:] == ["False", "True"]
