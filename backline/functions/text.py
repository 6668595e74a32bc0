"""Names: normalisation, genre classes, indoor or outdoor by name, similarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Genres by class, in order of precedence.
GENRE_CLASSES = [
    ("Sport", ["sports", "basketball"]),
    ("Entertainment", ["sports entertainment"]),
    ("Comedy", ["comedy"]),
    ("Family", ["family entertainment"]),
    ("Entertainment", ["theatrical", "spoken word", "multimedia", "awards show"]),
]
OTHER_TYPE = "Family, Entertainment, Comedy & Other"
SPORT_TYPES = ["Tenant Sporting Event", "Non-Tenant Sporting Event"]
# Words that mark an outdoor site, an indoor hall, and a smaller room in a venue.
OUTDOOR_WORDS = (
    r"piazza|piazzale|piazzetta|parco|park|giardin\w*|villa|castello|stadio|stadium|anfiteatro|amphitheat\w*|cavea|terme|circo|campo sportivo|ippodromo|autodromo|velodromo|"
    r"lungomare|porto|molo|spiaggia|lido|beach|bay|isola|masseria|fiera|festival|open air|reggia|cortile|chiostro|fossato|cave|foro|rotonda|arena|"
    r"teatro (romano|antico|greco|all'aperto|di verdura|del silenzio)|summer|estate|sagrato|belvedere|marina|darsena|prato|campo|piazzale|largo"
)
INDOOR_WORDS = (
    r"pala\w*|palasport|palazzo dello sport|palazzetto|forum|teatro|theatre|theater|auditorium|sala|club|live|hall|discoteca|disco|circolo|cinema|casa della musica|"
    r"magazzin\w*|fabbrica|spazio|centro congressi|opera|conservatorio|chiesa|basilica|cattedrale|duomo|dome"
)
SPORT_PALACES = r"pala\w*|palasport|palazzo dello sport"
SUBROOM_MARKERS = [
    "lounge", "bar", "club", "cafe", "basement", "upstairs", "downstairs", "studio", "hall 2", "hall 3", "room 2", "second stage", "small", "kleine", "klein", "petite",
    "sala 2", "annex", "parish", "foundry", "attic", "loft", "garage", "backstage", "gallery", "terrace", "rooftop", "grounds", "park", "plaza", "arena 2", "academy 2", "academy 3",
]
# Words of an entity's class or description that tell its type and kind, the most specific first.
TYPE_KEYWORDS = [
    ("stadium", "Stadium", "Outside"),
    ("racetrack", "Race Track", "Outside"),
    ("racecourse", "Race Track", "Outside"),
    ("speedway", "Race Track", "Outside"),
    ("amphitheat", "Amphitheatre", "Outside"),
    ("fairground", "Fairground", "Outside"),
    ("festival", "Festival Site", "Outside"),
    ("park", "Outdoor Venues", "Outside"),
    ("garden", "Outdoor Venues", "Outside"),
    ("arena", "Arena", "Inside"),
    ("concert hall", "Auditorium / Theatre", "Inside"),
    ("opera house", "Auditorium / Theatre", "Inside"),
    ("theatre", "Auditorium / Theatre", "Inside"),
    ("theater", "Auditorium / Theatre", "Inside"),
    ("auditorium", "Auditorium / Theatre", "Inside"),
    ("music venue", "Club", "Inside"),
    ("nightclub", "Club", "Inside"),
    ("indoor", "Arena", "Inside"),
    ("convention", "Convention Center", "Inside"),
    ("casino", "Casino", "Inside"),
    ("church", "Auditorium / Theatre", "Inside"),
    ("cathedral", "Auditorium / Theatre", "Inside"),
]
# Names of halls, and words that may be.
STRONG_INDOOR = ["palacio de los deportes", "palais des sports", "palasport", "palazzo dello sport", "palacongressi", "sporthalle", "messehalle", "stadthalle", "festhalle", "olympiahalle"]
WEAK_INDOOR = ["arena", "forum", "dome", "halle", "hall", "pala"]
SUBROOM_TOKENS = ["2", "3", "ii", "iii"]


def _norm(name: str | None) -> str | None:
    if name is None:
        return None
    s = unicodedata.normalize("NFKD", name.strip().lower())
    s = "".join(c for c in s if not unicodedata.combining(c)).replace("&", " and ").replace("$", "s")
    s = " ".join(re.sub(r"[^\w\s]", " ", s).split())
    return s.removeprefix("the ")


@F.pandas_udf(StringType())
def _norm_unicode(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in names:
        yield s.map(_norm, na_action="ignore")


def norm_key(name: Column) -> Column:
    """Folded name: lower case, no marks, '&' as 'and', '$' as 's', no punctuation, single spaces, no leading 'the'.

    ASCII names, nearly all, stay in the JVM; only others go through Python for their decomposition.
    """
    s = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("$"), F.lit("s"))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\w\s]", " "), r"\s+", " "))
    return F.when(name.rlike(r"^\p{ASCII}*$"), F.regexp_replace(s, "^the ", "")).otherwise(_norm_unicode(name))


def norm_ascii(name: Column) -> Column:
    """norm_key for names known to be ASCII, without the Python branch in the plan."""
    s = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("$"), F.lit("s"))
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\w\s]", " "), r"\s+", " "))
    return F.regexp_replace(s, "^the ", "")


def harvest_name(name: Column) -> Column:
    """Curly quotes straightened, spaces squeezed."""
    return F.trim(F.regexp_replace(F.translate(name, "‘’“”", "''\"\""), r"\s+", " "))


def slug(name: Column) -> Column:
    """Header or file-safe form: runs of other signs as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def genre_class(genre: Column) -> Column:
    """Class of a comma-separated genre list, by precedence."""
    parts = F.transform(F.split(F.lower(F.coalesce(genre, F.lit(""))), ","), lambda x: F.trim(x))
    out = None
    for name, genres in GENRE_CLASSES:
        hit = F.arrays_overlap(parts, F.array(*[F.lit(g) for g in genres]))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Music")


def event_type_for_genre(genre: Column) -> Column:
    """Event type of a box-office row that isn't music; null for music."""
    kind = genre_class(genre)
    return F.when(kind == "Sport", "Sporting Event").when(kind != "Music", OTHER_TYPE)


def io_from_name(name: Column, inside: list[str] = [], outside: list[str] = []) -> Column:  # noqa: B006
    """'inside', 'outside' or null by the venue's name; the lists hold names that the words would misread."""
    n = F.lower(F.trim(name))
    words = lambda w: n.rlike(rf"(?U)\b({w})\b")
    return (
        F.when(n.isin(inside or [""]) & (n != ""), "inside")
        .when(n.isin(outside or [""]) & (n != ""), "outside")
        .when(n.startswith("pala") & ~n.startswith("palazzo"), "inside")
        .when(words(OUTDOOR_WORDS) & ~words(SPORT_PALACES), "outside")
        .when(words(INDOOR_WORDS), "inside")
    )


def is_subroom(norm: Column) -> Column:
    """A marker anywhere in the name, or a token that numbers a second room."""
    marked = F.lit(False)
    for m in SUBROOM_MARKERS:
        marked = marked | norm.contains(m)
    return marked | F.arrays_overlap(F.split(norm, " "), F.array(*[F.lit(t) for t in SUBROOM_TOKENS]))


def kind_of_class(labels: Column, description: Column) -> tuple[Column, Column]:
    """(type, 'Inside' or 'Outside') of an entity: the first keyword that any of its class labels or its description holds."""
    texts = F.transform(F.concat(F.coalesce(labels, F.array().cast("array<string>")), F.array(description)), lambda x: F.lower(F.coalesce(x, F.lit(""))))
    kind = io = F.lit(None).cast("string")
    for word, name, place in reversed(TYPE_KEYWORDS):
        hit = F.exists(texts, lambda x: F.contains(x, F.lit(word)))  # noqa: B023
        kind, io = F.when(hit, name).otherwise(kind), F.when(hit, place).otherwise(io)
    return kind, io


def indoor_hint(name: Column) -> Column:
    """'likely mislabelled' or 'check' for a place not labelled as a hall whose name says that it is one, else null."""
    low = F.lower(name)
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(any_of(STRONG_INDOOR), "likely mislabelled").when(any_of(WEAK_INDOOR), "check")


def register(spark) -> None:
    """The name and genre functions for SQL, by the same names."""
    classes = [(name, set(genres)) for name, genres in GENRE_CLASSES]

    def genre(value: str | None) -> str:
        parts = {p.strip() for p in (value or "").lower().split(",")}
        return next((name for name, genres in classes if parts & genres), "Music")

    def event_type(value: str | None) -> str | None:
        kind = genre(value)
        return "Sporting Event" if kind == "Sport" else OTHER_TYPE if kind != "Music" else None

    spark.udf.register("norm_key", _norm_unicode)
    spark.udf.register("genre_class", F.pandas_udf(_mapped(genre), StringType()))
    spark.udf.register("event_type_for_genre", F.pandas_udf(_mapped(event_type), StringType()))


def _mapped(f):
    def column(s: pd.Series) -> pd.Series:
        return s.map(f)

    return column


def ratio(a: str, b: str) -> float:
    """Indel similarity in percent: 200 times the longest common subsequence over the summed lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = diagonal = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left = diagonal + 1 if x == y else max(up, left)
            diagonal = up
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the common tokens and the common tokens with either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one = " ".join(sorted(x - y))
    two = " ".join(sorted(y - x))
    if both and (not one or not two):
        return 100.0
    first, second = f"{both} {one}".strip(), f"{both} {two}".strip()
    best = ratio(first, second)
    return max(best, ratio(both, first), ratio(both, second)) if both else best


@F.pandas_udf(DoubleType())
def token_set_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
