"""Reading instants out of free-form text with built-in expressions only (whole parse stays in the JVM)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations and the offset each one names, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\b\.?)?"
_ZONE = r"\s*+([+-]\d{2}:?\d{0,2}|[A-Za-z]{1,5}|[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)?\s*+(?:\[([A-Za-z0-9_+/-]+)\])?"
_REST = rf"(?:,?[Tt_ ]\s*+{_CLOCK}{_ZONE})?$"
#: Blanks around a text; each run is tried once, so long runs inside cost no more than their length.
_AROUND = r"^[\s\u00a0\u200b\ufeff]++|(?<![\s\u00a0\u200b\ufeff])[\s\u00a0\u200b\ufeff]++$"
#: Layout, and where its year, month and day stand; the other groups are hour, minute, second, fraction, half of day, zone, bracket.
LAYOUTS = [
    (rf"^(\d{{4}})[-:/](\d{{1,2}})[-:/](\d{{1,2}}){_REST}", "$1|$2|$3"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_REST}", "$3|$1|$2"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_REST}", "$3|$2|$1"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{4}}){_REST}", "$3|$2|$1"),
]
#: Other spellings, brought to a layout above before it is tried.
REWRITES = [
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日$", "$1-$2-$3"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2})[时時点](\d{1,2})分(?:(\d{1,2})秒)?", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?", "$1-$2-$3T$4:$5:$6"),
    (r"^(\S+[Tt ]\d{1,2}:\d{2}):(?!\d)", "$1"),
    (r"^(\d{4}-\d{2}-\d{2}[Tt ]\d{2})(?=$|[Zz]$|[+-]\d{2})", "$1:00"),
]


def with_instant(df: DataFrame, text: str, zone: str, ms: str = "ms", own: str = "own_zone") -> DataFrame:
    """`df` with `ms` (UTC epoch milliseconds, BIGINT) and `own` (the text names its zone or is Unix time, BOOLEAN).

    Both are null when the text is unreadable or names an impossible moment. Local times without a zone are read in
    `zone` (an IANA name; null means UTC). A local time that occurs twice is the first, a skipped one is read with the
    offset before the change. Digits finer than a millisecond are cut. Null and empty texts, and what
    fits no layout as a whole, give null, whatever their length; blanks around a text do not count. Slashed dates are month first, dotted ones day first; bare digits are Unix time in s, ms, us
    or ns by their number of digits; missing clock parts are zero; 24:00:00 is the next midnight.

    Each step is a projection of its own, so that a value used several times is computed once and code stays small.
    """
    x = df.withColumn("_s", F.regexp_replace(F.col(text), _AROUND, ""))
    odd = F.col("_s").rlike("年|^\\d{8}[Tt]|[Tt ]\\d{2}(?:$|[Zz]$|[+-]\\d{2})")
    fixed = F.col("_s")
    for pattern, to in REWRITES:
        fixed = F.regexp_replace(fixed, pattern, to)
    x = x.withColumn("_s", F.when(odd, fixed).otherwise(F.col("_s")))
    split = F.lit(None).cast("string")
    for pattern, ymd in reversed(LAYOUTS):
        split = F.when(F.col("_s").rlike(pattern), F.regexp_replace("_s", pattern, f"{ymd}|$4|$5|$6|$7|$8|$9|$10|")).otherwise(split)
    x = x.withColumn("_p", F.split(split, r"\|"))
    part = lambda i: F.col("_p")[i]
    num = lambda c: F.when(c == "", 0).otherwise(c.try_cast("int"))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3))).cast("int")
    x = x.withColumns(
        {
            "_y": part(0).try_cast("int"), "_mo": F.coalesce(part(1).try_cast("int"), month), "_d": part(2).try_cast("int"),
            "_h": num(part(3)), "_mi": num(part(4)), "_sec": num(part(5)), "_half": F.lower(part(7)),
            "_frac": F.coalesce(F.rpad(F.substring(part(6), 1, 3), 3, "0").try_cast("int"), F.lit(0)), "_fine": F.translate(part(6), "0", ""), "_zone": part(8), "_br": part(9),
        }
    )
    zone_text = F.col("_zone")
    signed = zone_text.rlike("^[+-]")
    clean = F.rpad(F.translate(zone_text, ":+-", ""), 4, "0")
    minutes = F.substring(clean, 1, 2).try_cast("int") * 60 + F.substring(clean, 3, 2).try_cast("int")
    minutes = F.when((F.substring(clean, 3, 2).try_cast("int") <= 59) & (minutes <= 1080), minutes)
    abbreviations = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    named = F.when(F.col("_br") != "", F.col("_br")).when(zone_text.contains("/"), zone_text)
    x = x.withColumns(
        {
            "_off": F.when(signed, minutes * F.when(zone_text.startswith("-"), -1).otherwise(1)).when((zone_text != "") & ~zone_text.contains("/"), abbreviations[F.upper(zone_text)]),
            "_fixed": (zone_text != "") & ~zone_text.contains("/"), "_named": named,
            "_next": (F.col("_half") == "") & (F.col("_h") == 24) & (F.col("_mi") == 0) & (F.col("_sec") == 0) & (F.col("_fine") == ""),
            "_hour": F.when(F.col("_half") == "", F.col("_h")).otherwise(F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)),
            "_day": F.when(F.col("_y") > 0, F.unix_seconds(F.try_make_timestamp(F.col("_y"), F.col("_mo"), F.col("_d"), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))),
        }
    )
    possible = ((F.col("_half") == "") | F.col("_h").between(1, 12)) & ((F.col("_hour") <= 23) | F.col("_next")) & (F.col("_mi") <= 59) & ((F.col("_sec") <= 59) | ((F.col("_sec") == 60) & (F.col("_mi") == 59)))
    clock = F.when(F.col("_next"), 86400).otherwise(F.col("_hour") * 3600 + F.col("_mi") * 60 + F.col("_sec"))
    x = x.withColumn("_local", F.when(possible, F.col("_day") + clock)).withColumn("_wall", F.timestamp_seconds("_local"))
    # The wall clock, as a timestamp of UTC fields, read in its zone; in a zone that nobody knows it is unreadable.
    parts = [f(F.col("_wall")) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)]
    in_zone = F.unix_seconds(F.try_make_timestamp(*parts, F.coalesce("_named", F.col(zone), F.lit("UTC"))))
    digits = F.regexp_extract("_s", r"^[+-]?(\d{1,20})$", 1)
    size = F.length(digits)
    number = digits.try_cast("decimal(20,0)")
    unix = F.when(size <= 11, number * 1000).when(size <= 14, number).when(size <= 17, F.floor(number / 1000)).when(size <= 20, F.floor(number / 1000000))
    unix = F.when(digits != "", unix.try_cast("bigint") * F.when(F.col("_s").startswith("-"), -1).otherwise(1))
    x = x.withColumns({"_unix": unix, "_sec": F.when(F.col("_fixed"), F.col("_local") - F.col("_off") * 60).when(F.col("_local").isNotNull(), in_zone)})
    value = F.coalesce("_unix", F.col("_sec") * 1000 + F.col("_frac"))
    x = x.withColumn("_ms", value)
    flag = F.when(F.col("_ms").isNotNull(), F.col("_unix").isNotNull() | F.coalesce(F.col("_fixed"), F.lit(False)) | F.col("_named").isNotNull())
    return x.select(*df.columns, F.col("_ms").alias(ms), flag.alias(own))
