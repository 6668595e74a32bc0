"""Dates, numbers, bands, verdicts and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers, bands and country sets.
TIERS = [("A", 40_000_000, 50), ("B", 10_000_000, 100)]
LEAST_C = 1_000_000
CAPACITY_BANDS = [(1_000, "under 1,000"), (2_500, "1,000-2,499"), (5_000, "2,500-4,999"), (10_000, "5,000-9,999"), (20_000, "10,000-19,999"), (40_000, "20,000-39,999"), (60_000, "40,000-59,999"), (10**9, "60,000+")]
LADDER_BANDS = [(1_500, "club (under 1,500)"), (3_500, "theatre (1,500-3,499)"), (8_000, "mid-scale (3,500-7,999)"), (15_000, "arena (8,000-14,999)"), (30_000, "large arena (15,000-29,999)"), (10**9, "stadium (30,000+)")]
GROSS_BANDS = [500, 1_500, 3_500, 8_000, 15_000, 30_000, 200_000]
CONTINENTS = {
    "Europe": "AD AL AT BA BE BG BY CH CY CZ DE DK EE ES FI FO FR GB GG GI GR HR HU IE IM IS IT JE LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS RU SE SI SK SM UA VA XK",
    "North America": "AG AI AW BB BM BS BZ CA CR CU CW DM DO GD GL GP GT HN HT JM KN KY LC MQ MS MX NI PA PR SV TC TT US VC VG VI",
    "South America": "AR BO BR CL CO EC FK GF GY PE PY SR UY VE",
    "Asia": "AE AF AM AZ BD BH BN BT CN GE HK ID IL IN IQ IR JO JP KG KH KP KR KW KZ LA LB LK MM MN MO MV MY NP OM PH PK PS QA SA SG SY TH TJ TL TM TR TW UZ VN YE",
    "Africa": "AO BF BI BJ BW CD CF CG CI CM CV DJ DZ EG EH ER ET GA GH GM GN GQ GW KE KM LR LS LY MA MG ML MR MU MW MZ NA NE NG RE RW SC SD SL SN SO SS ST SZ TD TG TN TZ UG ZA ZM ZW",
    "Oceania": "AS AU CK FJ FM GU KI MH NC NF NR NU NZ PF PG PW SB TO TV VU WF WS",
}
EARTH_KM = 6371.0


def not_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def day(c: Column) -> Column:
    """The date of an ISO text, null where it isn't one."""
    return c.try_cast("date")


def venue_key(venue_id: Column, venue: Column, city: Column) -> Column:
    """The id where there is one, else name and city (null if either is)."""
    return F.coalesce(F.nullif(venue_id, F.lit("")), F.concat(venue, F.lit("|"), city))


def classify_tier(listeners: Column, rank: Column) -> Column:
    """Tier A to E by audience or chart rank."""
    out = F.when(listeners.isNull() & rank.isNull(), "E")
    for tier, least, best in TIERS:
        out = out.when((listeners >= least) | (rank <= best), tier)
    return out.when(listeners >= LEAST_C, "C").otherwise("D")


def category_rank(category: Column) -> Column:
    """1 to 5 for 'Category A' to 'Category E', else 6."""
    out = None
    for i, letter in enumerate("ABCDE", 1):
        hit = category == f"Category {letter}"
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(6)


def band(value: Column, bands: list[tuple[int, str]]) -> Column:
    """Label of the left-closed band, 'capacity unknown' for null."""
    out = F.when(value.isNull(), "capacity unknown")
    for top, label in bands[:-1]:
        out = out.when(value < top, label)
    return out.otherwise(bands[-1][1])


def right_closed(value: Column, edges: list[int]) -> Column:
    """Label '(low, high]' of the band; null outside all."""
    out = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        hit = (value > lo) & (value <= hi)
        label = f"({lo}, {hi}]"
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def parse_number(text: Column) -> Column:
    """Number of a text with , $ % signs; null where there is none."""
    return F.regexp_replace(F.trim(text), "[,$%]", "").try_cast("double")


def parse_date(text: Column) -> Column:
    """ISO date of a text in one of four formats, else ''. The order matters: month first wins."""
    formats = ["M/d/yyyy", "yyyy-MM-dd", "d/M/yyyy", "M/d/yy"]
    shapes = [r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{2}$"]
    t = F.trim(text)
    tries = [F.when(t.rlike(shape), F.try_to_date(t, fmt)) for fmt, shape in zip(formats, shapes, strict=True)]
    # Two digits from 69 on mean the last century.
    tries[-1] = F.when(F.year(tries[-1]) >= 2069, F.add_months(tries[-1], -1200)).otherwise(tries[-1])
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.lit(""))


def flip_date(text: Column) -> Column:
    """dd-MM-yyyy to yyyy-MM-dd or back by order of parts, '' unless there are three."""
    p = F.split(text, "-")
    return F.when(F.size(p) == 3, F.concat_ws("-", p[2], p[1], p[0])).otherwise("")


def overlap_fraction(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Shared days over the shorter span; negative when disjoint."""
    days = F.date_diff(F.least(a2, b2), F.greatest(a1, b1))
    return days / F.greatest(F.least(F.date_diff(a2, a1), F.date_diff(b2, b1)), F.lit(1))


def gap_days(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Days between disjoint spans, else 0."""
    return F.when(b1 > a2, F.date_diff(b1, a2)).when(a1 > b2, F.date_diff(a1, b2)).otherwise(0).cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def rename_grade(distance_m: Column, ratio: Column, gap: Column) -> Column:
    """Trust in a proposed rename from distance, capacity ratio and gap in days; unknown values never help."""
    near = F.coalesce(distance_m <= 25, F.lit(False))
    alike = F.coalesce(ratio <= 1.25, F.lit(False))
    seamless = F.coalesce((gap > 0) & (gap <= 400), F.lit(False))
    return F.when(F.coalesce(gap == 0, F.lit(False)), "low").when(near & alike & seamless, "high").when(near & (alike | seamless), "medium").otherwise("low")


def capacity_verdict(typical: Column, ceiling: Column, gap: float = 1.2, borderline: float = 0.8) -> Column:
    """Whether the largest room of the kind explains a skipped market."""
    return (
        F.when(typical.isNull(), "unknown")
        .when(ceiling.isNull(), "capacity gap (none of this kind)")
        .when(typical > ceiling * gap, "capacity gap")
        .when(typical > ceiling * borderline, "borderline")
        .otherwise("not capacity")
    )


def continent(code: Column) -> Column:
    out = None
    for name, codes in CONTINENTS.items():
        hit = code.isin(codes.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def percent_rank_average(partition, order) -> Column:
    """Average rank over size, as pandas' rank(pct=True)."""
    from pyspark.sql import Window

    whole = Window.partitionBy(*partition)
    ties = Window.partitionBy(*partition, order)
    rank = F.rank().over(Window.partitionBy(*partition).orderBy(order))
    return (rank + (F.count(F.lit(1)).over(ties) - 1) / 2) / F.count(order).over(whole)


def first_of_year_day(day: Column) -> Column:
    """Day of a leap year as 'dd Mon'."""
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (day - 1).cast("int")), "dd MMM")
