"""File names, session names and spoken text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns by which frames of one recording are told, tried in this order.
GROUP_PATTERNS = (
    r"^([a-zA-Z_]+\d{1,6})_frame_\d+$",
    r"^((?:[a-zA-Z]+_\d+))_frame_\d+$",
    r"^(IMG_\d{8}_\d{6})_\d+$",
    r"^([a-zA-Z_]+)_\d{3,}$",
    r"^([a-zA-Z][a-zA-Z0-9_]+)_\d+$",
)
#: Fixed value: a consent id.
CONSENT_ID = r"^CONSENT-h\d{2,}-\d{4}-\d{3}$"
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(file_name(name), r"(?<=.)\.[^.]*$", "")


def ending(name: Column) -> Column:
    """The part after the last dot in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(name), r"(?<=.)\.([^.]*)$", 1))


def group_key(name_stem: Column) -> Column:
    """What frames of one recording share: the first pattern that fits, else the stem itself."""
    return F.coalesce(*[F.nullif(F.regexp_extract(name_stem, p, 1), F.lit("")) for p in GROUP_PATTERNS], name_stem)


def house(name: Column) -> Column:
    """The house in a name (h and two digits or more, between underscores), else null."""
    return F.nullif(F.regexp_extract(name, r"(?:^|_)(h\d{2,})(?=_)", 1), F.lit(""))


def house_key(group: Column) -> Column:
    return F.when(house(group).isNotNull(), F.concat(F.lit("house:"), house(group))).otherwise(F.concat(F.lit("solo:"), group))


def session_parts(session: Column) -> Column:
    """struct<house, room, number> of a name like h01_pooja_room_s001, else null."""
    p = r"^(h\d{2,})_([a-z][a-z_]*)_(s\d{3,})$"
    return F.when(session.rlike(p), F.struct(*[F.regexp_extract(session, p, i).alias(n) for i, n in ((1, "house"), (2, "room"), (3, "number"))]))


def archive_key(path: Column) -> Column:
    """An archive's name without the time stamp that exports append."""
    return F.lower(F.trim(F.regexp_replace(stem(path), r"-\d{8}T.*$", "")))


def safe_name(name: Column, most: int = 120) -> Column:
    """A long stem cut to so many letters and told apart by eight hex digits of the name's hash."""
    end = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    cut = F.concat(F.substring(stem(name), 1, most), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8), end)
    return F.when(F.length(stem(name)) <= most, name).otherwise(cut)


def portable(path: Column, root: str) -> Column:
    """A path relative to root, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + root.rstrip("/") + "/", "")


def spoken(text: Column) -> Column:
    """Text fit to be read aloud: no control characters, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"\s+", " "))


def scene_json(reply: Column) -> Column:
    """struct<activity, risks> of a model's reply, from its first to its last brace; null where that is no JSON object."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
    parsed = F.from_json(body, "activity string, risks array<struct<risk_type: string, severity: string>>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(
        body.isNotNull() & parsed["_bad"].isNull(),
        F.struct(F.coalesce(parsed["activity"], F.lit("unknown")).alias("activity"), F.coalesce(parsed["risks"], F.array().cast("array<struct<risk_type: string, severity: string>>")).alias("risks")),
    )


def percent(part: Column, whole: Column) -> Column:
    """As text to one place; of nothing, 0.0%. Rounded by the double itself, halves to even, as C and Python print it; counts, so never below 0.

    The double is told from the half between two tenths exactly: in two parts of few enough bits that twenty times each is exact.
    """
    share = F.when(whole > 0, 100.0 * part / whole).otherwise(F.lit(0.0))
    down = F.floor(share * 10)
    high = share.cast("float").cast("double")
    beyond = (high * 20 - (2 * down + 1)) + (share - high) * 20
    tenths = down + ((beyond > 0) | ((beyond == 0) & (down % 2 == 1))).cast("int")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))
