"""Ordered-rule classifiers of listens, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAY_MS = 30_000

#: First rule whose text is contained decides.
PLATFORM_RULES = [
    ("amazon", "speaker_tv"),
    ("echo", "speaker_tv"),
    ("cast", "speaker_tv"),
    ("tizen", "speaker_tv"),
    ("android_tv", "speaker_tv"),
    ("fire", "speaker_tv"),
    ("web_player", "web"),
    ("osx", "desktop"),
    ("os x", "desktop"),
    ("windows", "desktop"),
    ("linux", "desktop"),
    ("mac", "desktop"),
    ("android", "mobile"),
    ("ios", "mobile"),
    ("iphone", "mobile"),
    ("ipad", "mobile"),
]
#: The same for user agents.
DEVICE_RULES = [("ios/", "iOS"), ("iphone", "iOS"), ("ipad", "iOS"), ("macintosh", "Macintosh"), ("os x", "Macintosh"), ("mac os", "Macintosh"), ("windows", "Windows"), ("android", "Android")]
#: Start reasons by intent, eras by year, seasons by month, the household's pattern.
DELIBERATE = ("clickrow", "playbtn", "backbtn", "remote")
PASSIVE = ("trackdone", "appload", "fwdbtn")
ERAS = [("2015-2017", 2015, 2017), ("2018", 2018, 2018), ("2019-2020", 2019, 2020), ("2021-2022", 2021, 2022), ("2023-2024", 2023, 2024), ("2025-2026", 2025, 2026)]
SEASONS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
WHITE_NOISE = r"(?i)white\s+noise"
#: Phrases of recordings that aren't music.
NON_MUSIC = [
    r"\bnpr\b",
    r"\bbbc (radio|news|world)\b",
    r"\bespn\b",
    r"\bpodcast\b",
    r"\bradio hour\b",
    r"\bradio station\b",
    r"\btalk radio\b",
    r"\bnews hour\b",
    r"\bsermon\b",
    r"\baudiobook\b",
    r"\bchapter \d",
    r"\bthis american life\b",
    r"\bted talk\b",
    r"\bwhite noise\b",
    r"\bsleep sounds\b",
    r"\bnature sounds\b",
    r"\bbeats 1\b",
    r"\bapple music 1\b",
    r"\bnews and culture\b",
    r"\bguided meditation\b",
]


def is_non_music(title: Column, hint: Column) -> Column:
    """Whether a title with its album hint names something that isn't music."""
    return F.concat_ws(" ", title, hint).rlike("(?i)" + "|".join(NON_MUSIC))


def is_play(ms: Column, *, least: int = PLAY_MS) -> Column:
    """Whether a listen is a play: at least ``least`` milliseconds; null isn't."""
    return F.coalesce(ms, F.lit(0)) >= least


def ordered(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Value of the first rule whose text ``text`` contains in any case."""
    low = F.lower(text)
    out = None
    for part, value in rules:
        hit = low.contains(part)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def platform_bucket(platform: Column) -> Column:
    """Mobile, desktop, web, speaker_tv or other; a null platform counts as not_applicable, which is other."""
    return ordered(F.coalesce(platform, F.lit("not_applicable")), PLATFORM_RULES, "other")


def device_family(agent: Column) -> Column:
    """iOS, Macintosh, Windows, Android or unknown, from a user agent."""
    return ordered(F.coalesce(agent, F.lit("")), DEVICE_RULES, "unknown")


def intent(reason: Column, shuffle: Column) -> Column:
    """Shuffle before deliberate before passive before other."""
    return F.when(F.coalesce(shuffle, F.lit(False)), "shuffle").when(reason.isin(*DELIBERATE), "deliberate").when(reason.isin(*PASSIVE), "passive").otherwise("other")


def era(year: Column) -> Column:
    """Slug of the era of a year, null outside all of them."""
    out = F.lit(None).cast("string")
    for slug, first, last in reversed(ERAS):
        out = F.when(year.between(first, last), slug).otherwise(out)
    return out


def season(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name).otherwise(out)
    return out


def is_household(artist: Column, names: Sequence[str]) -> Column:
    """Whether an act is on the household list (exact, case matters) or says white noise."""
    listed = artist.isin(*names) if names else F.lit(False)
    return F.coalesce(listed | artist.rlike(WHITE_NOISE), F.lit(False))


def safe_int(text: Column) -> Column:
    """Whole part of a number in text, null for anything else."""
    return F.trim(text).try_cast("double").try_cast("bigint")


def split_pair(text: Column) -> Column:
    """Struct (artist, title) split at the first blank-hyphen-blank; null if a side is empty."""
    at = F.instr(text, " - ")
    artist = F.trim(F.substring(text, F.lit(1), at - 1))
    title = F.trim(F.substring(text, at + 3, F.length(text)))
    return F.when((at > 0) & (artist != "") & (title != ""), F.struct(artist.alias("artist"), title.alias("title")))


def title_key(text: Column) -> Column:
    """Title with runs of white space as one blank, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def hours(ms: Column, digits: int = 1) -> Column:
    return F.round(ms / F.lit(3_600_000.0), digits)


def minutes_seconds(ms: Column) -> Column:
    """Milliseconds as m:ss."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def id_of_uri(uri: Column) -> Column:
    """Last part of an identifier with colons, or of an address with slashes."""
    return F.element_at(F.split(F.rtrim(F.regexp_replace(F.regexp_replace(uri, r"\?.*$", ""), r"/+$", "")), "[:/]"), -1)


def release_year(date: Column) -> Column:
    """First four characters of a release date as a year, null if there aren't four."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def estimated_hours(plays: Column, duration_ms: Column) -> Column:
    return F.round(plays * duration_ms / F.lit(3_600_000.0), 2)


def nearest_size(images: Column, target: int) -> Column:
    """The image (struct with width) whose width is nearest the target; the first of equals."""
    gap = F.transform(images, lambda x, i: F.struct(F.abs(x["width"] - target).alias("gap"), i.alias("i"), x.alias("image")))
    return F.get(F.sort_array(gap), F.lit(0))["image"]


def name_or_text(item: Column) -> Column:
    """Name of an act given as JSON object, or the text itself."""
    return F.coalesce(F.get_json_object(item, "$.name"), item)


def joined_names(names: Column, by: str = ", ") -> Column:
    """Names that aren't blank, joined."""
    return F.array_join(F.filter(names, lambda x: F.trim(x) != ""), by)
