"""Planning names and places of files: templates, levels, checks, conflicts and roll-ups, all as one lazy plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import fresh_path
from .ranking import running

#: The variables a template may use.
VARIABLES = [
    "capture_time", "capture_date", "captured_date", "captured_time", "camera", "camera_make", "camera_model", "lens", "original_name", "original_stem", "extension", "semantic", "primary_label", "tone",
    "dominant_color", "saturation", "sequence", "short_hash",
]
#: The kinds of a directory level; the first three come from the date.
LEVELS = ["year", "month", "day", "original_directory", "primary_semantic", "tone", "dominant_color", "saturation"]
DATES = {"year": "yyyy", "month": "MM", "day": "dd"}
#: What stands in for a missing value, and what becomes of rows with one target.
FALLBACKS, STRATEGIES = ["modification_time", "unknown", "skip", "block"], ["skip", "sequence", "short_hash"]
#: The longest segment and path, in UTF-16 units, and the issues that no strategy can cure.
SEGMENT_UNITS, PATH_UNITS, FATAL = 255, 260, ["invalid_segment", "reserved_name", "path_too_long", "target_escape"]


@dataclass
class Rules:
    template: str
    levels: list[tuple[str, str]] = field(default_factory=list)  #: (kind, fallback)
    fallback: str = "unknown"  #: of the template's variables
    strategy: str = "sequence"
    start: int = 1
    width: int = 4


def parse_template(template: str) -> list[tuple[str, str | None]]:
    """Pieces of a template: (text, None) or (variable, format); unknown variables and open braces are errors."""
    out: list[tuple[str, str | None]] = []
    at = 0
    for m in re.finditer(r"\{([a-z_]+)(?::([^{}]*))?\}", template):
        if m.start() > at:
            out.append((template[at : m.start()], None))
        if m[1] not in VARIABLES:
            raise ValueError(f"unknown_template_variable: {m[1]}")
        out.append((m[1], m[2] or ""))
        at = m.end()
    out.append((template[at:], None))
    if any(f is None and re.search(r"[{}]", t) for t, f in out):
        raise ValueError("invalid_template")
    return [p for p in out if p != ("", None)]


def rule_issues(rules: Rules) -> list[str]:
    """Codes of what is wrong with the rules; none when a plan can be made."""
    kinds = [k for k, _ in rules.levels]
    out = ["sequence_width"] if not 1 <= rules.width <= 12 else []
    out += ["sequence_start"] if rules.start < 1 else []
    out += ["levels"] if len(kinds) > 8 else []
    for i, (kind, fallback) in enumerate(rules.levels):
        out += ["duplicate_level"] if kind in kinds[:i] else []
        out += ["invalid_level_fallback"] if fallback == "modification_time" and kind not in DATES else []
    try:
        parse_template(rules.template)
    except ValueError as e:
        out.append(str(e).split(":")[0])
    return out


def render(template: str, values: dict[str, Column]) -> Column:
    """A template as one concatenation of columns: no function is called per row."""
    parts: list[Column] = []
    for name, fmt in parse_template(template):
        if fmt is None:
            parts.append(F.lit(name))
        elif name in ("capture_time", "captured_time") and fmt:
            parts.append(F.date_format(values.get("_captured", values[name]), fmt))
        elif name == "sequence":
            parts.append(T.zero_padded(values[name], fmt))
        else:
            parts.append(values[name].cast("string"))
    return F.concat(*[F.coalesce(p, F.lit("unknown")) for p in parts])


def _issue(code: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))


def variables(rules: Rules) -> tuple[dict[str, Column], list[Column]]:
    """Columns of all variables, and the issues met on the way, over rows as for :func:`draft`."""
    captured, modified = F.col("captured"), F.timestamp_millis("modified_at")
    issues: list[Column] = []
    iso = "yyyy-MM-dd'T'HH:mm:ssxxx"
    if rules.fallback == "modification_time":
        time, text = F.coalesce(captured, modified), F.when(captured.isNotNull(), F.col("capture_time")).otherwise(F.date_format(modified, iso))
        issues.append(_issue("capture_time_missing", "warning", time.isNull()))
    else:
        time, text = captured, F.when(captured.isNotNull(), F.col("capture_time")).otherwise("" if rules.fallback == "block" else "unknown")
        issues.append(_issue("capture_time_missing", "error" if rules.fallback == "block" else "warning", captured.isNull()))

    def resolved(column: Column, code: str) -> Column:
        there = column.isNotNull() & (F.trim(column) != "")
        if rules.fallback == "block":
            issues.append(_issue(code, "error", ~F.coalesce(there, F.lit(False))))
        return F.when(there, column).otherwise("unknown" if rules.fallback in ("unknown", "modification_time") else "")

    date = F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(""))
    semantic = resolved(F.col("semantic"), "semantic_missing")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = {
        "_captured": time, "capture_time": F.coalesce(text, F.lit("")), "capture_date": date, "captured_date": date, "captured_time": F.coalesce(F.date_format(time, "HH-mm-ss"), F.lit("")),
        "camera": resolved(F.coalesce("camera_model", "camera_make"), "camera_missing"), "camera_make": blank("camera_make"), "camera_model": blank("camera_model"), "lens": resolved(F.col("lens_model"), "lens_missing"),
        "original_name": blank("file_name"), "original_stem": T.stem(blank("file_name")), "extension": F.ltrim(blank("extension"), F.lit(".")), "semantic": semantic, "primary_label": semantic,
        "tone": resolved(F.col("tone"), "tone_missing"), "dominant_color": resolved(F.col("dominant_color"), "color_missing"), "saturation": resolved(F.col("saturation"), "saturation_missing"),
        "sequence": F.col("ordinal"), "short_hash": F.substring(blank("fingerprint"), 1, 8),
    }
    return out, issues


def levels(rules: Rules, values: dict[str, Column]) -> tuple[Column, list[Column]]:
    """The directory as an array of segments; values are split at slashes, missing ones take the fallback of their level."""
    parts, issues = [], []
    named = {"primary_semantic": "semantic", "tone": "tone", "dominant_color": "dominant_color", "saturation": "saturation"}
    for kind, fallback in rules.levels:
        if kind in DATES:
            value = F.date_format(values["_captured"], DATES[kind])
            instead = F.date_format(F.timestamp_millis("modified_at"), DATES[kind])
        else:
            value = T.parent_path(F.replace(F.col("relative_path"), F.lit("\\"), F.lit("/"))) if kind == "original_directory" else values[named[kind]]
            instead = F.lit(None).cast("string")
        there = F.coalesce(value != "", F.lit(False))
        if fallback == "modification_time":
            filled = F.when(there, value).otherwise(instead)
            issues.append(_issue("missing_metadata", "warning", filled.isNull()))
        else:
            filled = F.when(there, value).otherwise("unknown" if fallback == "unknown" else "")
            if fallback == "block":
                issues.append(_issue("missing_metadata", "error", ~there))
        parts.append(F.split(F.coalesce(filled, F.lit("")), "/"))
    return F.filter(F.flatten(F.array(*parts)), lambda s: s != "") if parts else F.array().cast("array<string>"), issues


def path_issues(relative: Column, root: str) -> list[Column]:
    """What forbids a relative target below `root`."""
    segments = F.split(relative, "/")
    reasons = F.transform(segments, lambda s: T.bad_segment(s))
    escape = (relative == "") | relative.rlike(r"^[/\\]") | relative.contains(":") | F.exists(segments, lambda s: s.isin(".", "..") | s.contains("\\"))
    out = [_issue("target_escape", "error", escape)]
    out += [_issue(code, "error", F.array_contains(reasons, code)) for code in ("reserved_name", "invalid_segment")]
    out.append(_issue("segment_too_long", "error", F.exists(segments, lambda s: T.utf16_length(s) > SEGMENT_UNITS)))
    return [*out, _issue("path_too_long", "error", T.utf16_length(F.concat(F.lit(root.rstrip("/") + "/"), relative)) > PATH_UNITS)]


def draft(rows: DataFrame, rules: Rules, root: str) -> DataFrame:
    """`rows` with target, values (map of the variables), issues (code, severity) and valid (whether the path is allowed).

    rows (ordinal, relative_path, file_name, extension, capture_time, captured TIMESTAMP, modified_at, camera_make,
    camera_model, lens_model, semantic, tone, dominant_color, saturation, fingerprint, file_status), nulls anywhere;
    rules without :func:`rule_issues`. The extension is put behind names that lack it.
    """
    if found := rule_issues(rules):
        raise ValueError(", ".join(found))
    values, issues = variables(rules)
    segments, more = levels(rules, values)
    name = render(rules.template, values)
    injected = _issue("target_escape", "error", name.rlike(r"[/\\]"))
    full = with_extension(name, values["extension"])
    x = rows.withColumns({"target": F.array_join(F.concat(segments, F.array(full)), "/"), "values": F.create_map(*[v for k in VARIABLES for v in (F.lit(k), values[k].cast("string"))]), "_issues": F.array(*issues, *more, injected)})
    bad = F.array_compact(F.array(*path_issues(F.col("target"), root)))
    x = x.withColumn("_bad", bad)
    gone = _issue("source_missing", "error", F.coalesce(F.col("file_status") != "present", F.lit(True)))
    return x.withColumns({"valid": F.size("_bad") == 0, "issues": F.concat(F.array_compact("_issues"), F.col("_bad"), F.array_compact(F.array(gone)))}).drop("_issues", "_bad")


def with_extension(name: Column, extension: Column) -> Column:
    """The name with its extension behind it, unless it ends so already, whatever the ASCII case."""
    return F.when(T.ascii_lower(name).endswith(F.concat(F.lit("."), T.ascii_lower(extension))), name).otherwise(F.concat(name, F.lit("."), extension))


def resolve_conflicts(rows: DataFrame, target: str, key: str, strategy: str = "sequence", existing: DataFrame | None = None, start: int = 1, width: int = 4, short_hash: str = "short_hash") -> DataFrame:
    """`rows` with `resolved` and `conflict` (existing_target, duplicate_target or null).

    Of rows with one target, compared without regard to ASCII case, the first by key keeps it, unless a file of
    `existing` (target) has it already. The others are in conflict: with 'skip' they keep their target and are left
    out of the plan; with 'short_hash' the hash of their file goes before the extension; with 'sequence' numbers from
    `start` on do, _0001, _0002 and so on, past every number whose name is the target of another row or exists. The
    numbers to avoid are placed among the rows of their stem by a running count, so the answer needs no loop, and a
    target that a third of all rows share is spread over all tasks. Null targets are no conflict.
    """
    t = F.col(target)
    x = running(rows.withColumn("_low", T.ascii_lower(target)), ["_low"], [F.col(key)], _place=F.lit(1))
    there = existing.where("target is not null").select(T.ascii_lower("target").alias("_low"), F.lit(True).alias("_there")).distinct() if existing is not None else None
    x = x.join(there, "_low", "left") if there is not None else x.withColumn("_there", F.lit(None).cast("boolean"))
    x = x.withColumns({"_n": F.when(t.isNull(), 0).otherwise(F.col("_place") - F.when(F.col("_there"), 0).otherwise(1)), "_stem": F.regexp_extract(t, r"^(.*?)(\.[^./]*)?$", 1), "_ext": F.regexp_extract(t, r"(\.[^./]*)$", 1)})
    x = x.withColumn("conflict", F.when(F.col("_n") > 0, F.when(F.col("_there"), "existing_target").otherwise("duplicate_target")))
    in_conflict = F.col("conflict").isNotNull()
    if strategy == "skip":
        return x.withColumn("resolved", t).drop("_low", "_place", "_there", "_n", "_stem", "_ext")
    if strategy == "short_hash":
        return x.withColumn("resolved", F.when(in_conflict, F.concat("_stem", F.lit("_"), F.col(short_hash), "_ext")).otherwise(t)).drop("_low", "_place", "_there", "_n", "_stem", "_ext")
    # Names that look like a suffixed one, by the stem they would block; a number has as many digits as it needs, at least `width`.
    names = x.select("_low") if there is None else x.select("_low").unionByName(there.select("_low"))
    pattern = rf"^(.*)_(\d{{{width}}}|[1-9]\d{{{width},}})(\.[^./]*)?$"
    taken = names.select(F.regexp_extract("_low", pattern, 1).alias("_s"), F.regexp_extract("_low", pattern, 3).alias("_e"), F.regexp_extract("_low", pattern, 2).try_cast("bigint").alias("_m")).where(F.col("_m") >= start).distinct()
    rows_ = x.where(in_conflict).select(T.ascii_lower("_stem").alias("_s"), T.ascii_lower("_ext").alias("_e"), (F.col("_n") - 1).alias("_at"), F.lit(1).alias("_row"))
    taken = taken.join(rows_.select("_s", "_e").distinct(), ["_s", "_e"], "left_semi")
    # Before a taken number lie as many free ones as it is away from the start, less the taken ones between.
    gaps = running(taken, ["_s", "_e"], [F.col("_m")], _r=F.lit(1)).select("_s", "_e", (F.col("_m") - start - F.col("_r") + 1).alias("_at"), F.lit(0).alias("_row"))
    dealt = running(rows_.unionByName(gaps), ["_s", "_e"], [F.col("_at"), F.col("_row")], _skip=1 - F.col("_row")).where("_row = 1")
    numbers = dealt.select(F.concat("_s", "_e").alias("_low"), (F.col("_at") + 1).alias("_n"), (F.lit(start) + F.col("_at") + F.col("_skip")).alias("_number"))
    y = x.join(numbers, ["_low", "_n"], "left")
    name = F.concat("_stem", F.lit("_"), T.zero_padded(F.col("_number"), "0" * width), "_ext")
    return y.withColumn("resolved", F.when(in_conflict, name).otherwise(t)).select(*rows.columns, "conflict", "resolved")


def status(issues: Column, conflict: Column, strategy: str) -> Column:
    """error, skipped_conflict, warning or ready, from the issues of a row and its conflict."""
    fatal = F.exists(issues, lambda i: i["code"].isin(FATAL))
    failed = F.exists(issues, lambda i: i["severity"] == "error")
    if strategy == "skip":
        clash = F.when(conflict.isNotNull(), "skipped_conflict")
    else:
        clash = F.when(conflict.isNotNull() & ~failed, "warning")
    return F.when(fatal, "error").otherwise(F.coalesce(clash, F.when(failed, "error").when(F.size(issues) > 0, "warning").otherwise("ready")))


def target_tree(rows: DataFrame, path: str, size: str) -> DataFrame:
    """(directory, depth, files, bytes) for every directory above a target, the root included."""
    per = rows.groupBy(T.parent_path(path).alias("d")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    up = per.select(F.explode(F.concat(F.array(F.lit("")), T.ancestors(F.concat("d", F.lit("/x"))))).alias("directory"), "n", "b")
    return up.groupBy("directory").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes")).withColumn("depth", T.path_depth("directory"))


class Plans:
    """Plans (ordinal, asset_id, target, issues) kept by name in the shared folder: replaced as a whole, read in order, deleted."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "plans")

    def save(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/plan={name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/plan={name}").orderBy("ordinal")

    def issues(self, name: str) -> DataFrame:
        """(ordinal, asset_id, code, severity): one row per issue."""
        return self.spark.read.parquet(f"{self.path}/plan={name}").select("ordinal", "asset_id", F.explode("issues").alias("i")).select("ordinal", "asset_id", "i.code", "i.severity")

    def delete(self, name: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/plan={name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
