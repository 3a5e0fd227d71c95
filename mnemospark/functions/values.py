"""JSON, time and scoring functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemospark.functions.json_repair import repair_json  # noqa: F401


def parsed(raw: Column, schema: str) -> tuple[Column, Column]:
    """(value, error flag) of a JSON text: broken text gives null and true."""
    fine = F.try_parse_json(raw).isNotNull()
    return F.when(fine, F.from_json(raw, schema)), raw.isNotNull() & ~fine


def bracket_balance(text: Column, opening: str, closing: str) -> Column:
    """How many more opening than closing brackets."""
    count = lambda x: F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))
    return count(opening) - count(closing)


def any_key(raw: Column, *names: str) -> Column:
    """The first of several spellings of a key that a JSON object has."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in names])


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_days(ts: Column, now: Column) -> Column:
    """Fractional days; ``now`` is given, so results repeat."""
    return (F.unix_micros(now) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def complexity(text: Column) -> Column:
    """Branches + 1."""
    return F.regexp_count(text, F.lit(r"if|else if|while|for|catch|case|&&|\|\|")) + 1


def file_complexity(lines: Column, entities: Column, deps: Column) -> Column:
    score = lines / 100 + 2 * entities + 1.5 * deps
    return F.when(score < 5, "simple").when(score < 15, "moderate").otherwise("complex")


def effort_hours(days: Column, tasks: Column, factor: Column) -> Column:
    """Days of eight hours shared among tasks, between 1 and 16."""
    return F.least(F.greatest(F.round(days * 8 / tasks * factor), F.lit(1.0)), F.lit(16.0))


# Weights of severities and efforts.
SEVERITY_DEBT = {"BLOCKER": 8.0, "CRITICAL": 4.0, "MAJOR": 2.0, "MINOR": 1.0, "INFO": 0.5}
EFFORT_DEBT = {"HIGH": 4.0, "MEDIUM": 2.0, "LOW": 1.0}
SEVERITY_RANK = {"BLOCKER": 5, "CRITICAL": 4, "MAJOR": 3, "MINOR": 2, "INFO": 1}


def looked_up(c: Column, table: dict[str, float], default: float = 0) -> Column:
    """CASE over a small table."""
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out
