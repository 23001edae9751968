"""Fixed values of the chart domain, and small column functions over them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Lead names in layout order, with the plausible peak-to-peak range in mV.
LEADS = (
    ("I", 0.05, 2.5), ("aVR", 0.05, 2.0), ("V1", 0.05, 3.5), ("V4", 0.10, 4.0),
    ("II", 0.05, 2.5), ("aVL", 0.05, 2.0), ("V2", 0.10, 4.0), ("V5", 0.05, 3.0),
    ("III", 0.05, 2.5), ("aVF", 0.05, 2.5), ("V3", 0.10, 4.0), ("V6", 0.05, 3.0),
    ("Rhythm", 0.05, 4.0),
)
OTHER_RANGE = (0.05, 4.0)
MM_PER_MV, MM_PER_S, SAMPLE_HZ, PX_PER_MM = 10.0, 25.0, 500.0, 11.8

# The first of these patterns found in a token names the lead.
LEAD_TOKENS = (
    ("I", r"(?i)^\|?I$"), ("II", r"(?i)^\|?II$"), ("III", r"(?i)^\|?III$"),
    ("aVR", r"(?i)a\s*v\s*r"), ("aVL", r"(?i)a\s*v\s*l"), ("aVF", r"(?i)a\s*v\s*f"),
    ("V1", r"[Vv]\s*1"), ("V2", r"[Vv]\s*2"), ("V3", r"[Vv]\s*3"), ("V4", r"[Vv]\s*4"), ("V5", r"[Vv]\s*5"), ("V6", r"[Vv]\s*6"),
)

# Words that a report's text is expected to hold, in lower case.
REPORT_WORDS = (
    "ecg ekg report patient technician confirmed room years male female mmhg cm kg medication diagnosis information"
    " department ref phys avr avl avf v1 v2 v3 v4 v5 v6"
).split()

# Steps of a job in order; content types by extension; display names of classes.
STEPS = ("received", "orientation", "yolo", "crop", "enhanced", "mask", "digitized", "predicted")
CONTENT_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".svg": "image/svg+xml",
    ".json": "application/json", ".npz": "application/octet-stream",
}
CLASS_NAMES = {
    "Normal": "Normal ECG", "HB": "Heart Block (HB)", "MI": "Myocardial Infarction (MI)",
    "PMI": "Prior Myocardial Infarction (PMI)",
}


def lead_dim(spark: SparkSession):
    """One row for each lead: its place, chart row, label strip, duration and plausible range."""
    rows = [
        (n, i, min(i // 4, 3), 0.10 if n in ("I", "II", "III") else 0.06 if n == "Rhythm" else 0.12, 10.0 if n == "Rhythm" else 2.5, lo, hi)
        for i, (n, lo, hi) in enumerate(LEADS)
    ]
    return spark.createDataFrame(rows, "lead string, ord int, row_idx int, label_skip double, duration_s double, lo_mv double, hi_mv double")


def lead_of(token: Column) -> Column:
    """The lead that a token names, null if none."""
    token, out = F.trim(token), None
    for name, pattern in LEAD_TOKENS:
        hit = token.rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def extension(path: Column, default: str = ".jpg") -> Column:
    found = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def mapped(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def alnum_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def keyword_hits(text: Column) -> Column:
    return F.size(F.filter(words(F.lower(text)), lambda w: w.isin(REPORT_WORDS)))


def lead_alias(key: Column) -> Column:
    """The rhythm strip's name in any case as Rhythm."""
    return F.when(F.upper(key) == "RHYTHM", F.lit("Rhythm")).otherwise(key)


def named_probabilities(names: Column, values: Column) -> Column:
    """Map of class names to probabilities; an error if their numbers differ."""
    wrong = F.assert_true(F.size(names) == F.size(values), F.lit("as many classes as probabilities are needed"))
    return F.when(wrong.isNull(), F.map_from_arrays(names, values))


def confident(words_found, least: int = 20):
    """Rows of recognised text (text, conf) that are sure enough and not blank."""
    return words_found.where((F.col("conf") >= least) & (F.trim("text") != ""))


def run_paths(run_id: Column, root: str = "uploads") -> dict[str, Column]:
    return {"result": F.format_string(f"{root}/result_%s.json", run_id.cast("string")), "folder": F.format_string(f"{root}/digitized_%s", run_id.cast("string"))}


def new_run_id() -> Column:
    return F.uuid()


def tail(text: Column, chars: int = 20_000) -> Column:
    return F.right(text, F.lit(chars))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", 100.0 * share)
