"""Label and reasoning from the raw text that a language model returned, without Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YES, NO = ("yes", "y", "1", "true"), ("no", "n", "0", "false")
WEAK = ("race", "gender", "diversity", "representation", "image", "bias")


def _patterns(name: str, bare: str) -> list[str]:
    """A quoted field, a quoted value, a bare value: tried in this order."""
    colon, value = r"\s*:\s*", r'"([^"]+)"'
    return [f'(?i)"{name}"{colon}{value}', f"(?i){name}{colon}{value}", f"(?i){name}{colon}{bare}"]


LABELS, REASONS = _patterns("label", "([a-zA-Z-]+)"), _patterns("reasoning", r"([^,\n]+)")
ECHOES = ("Now classify the following post", "{{ post }}", 'Post: "{{')
SYSTEM_START = "You are an AI ethics researcher"
ECHOED = "⚠️ Model failed — repeated system prompt without generating output"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_output(raw: Column) -> Column:
    """Without code fences and echoed system blocks."""
    t = strip(F.regexp_replace(raw, r"```json|```", ""))
    for pattern in (r"(?is)### SYSTEM_INSTRUCTION.*?###", r"(?is)system_instruction.*?###"):
        t = F.regexp_replace(t, pattern, "")
    return strip(t)


def parse_label(cleaned: Column) -> Column:
    """yes, no or null; a pattern whose hit is neither gives way to the next."""
    tries = []
    for pattern in LABELS:
        hit = F.lower(strip(F.regexp_extract(cleaned, pattern, 1)))
        tries.append(F.when(hit.isin(*YES), "yes").when(hit.isin(*NO), "no"))
    return F.coalesce(*tries)


def parse_reasoning(cleaned: Column) -> Column:
    tries = [F.when(cleaned.rlike(p), F.regexp_replace(strip(F.regexp_extract(cleaned, p, 1)), r"[.,;]+$", "")) for p in REASONS]
    rest = strip(F.regexp_extract(cleaned, r"(?is)label\s*:\s*(?:yes|no)(.*)$", 1))
    line = F.regexp_extract(rest, r"^([^\n]*)", 1)
    return F.coalesce(*tries, F.when(F.length(line) > 10, line), F.lit("No reasoning provided"))


def parse_output(raw: Column) -> Column:
    """struct(label, reasoning), with the guard against an echoed prompt and the weak fallbacks. Null counts as empty."""
    raw = F.coalesce(raw, F.lit(""))
    cleaned = clean_output(raw)
    echoed = strip(raw).startswith(SYSTEM_START) | (F.size(F.split(raw, "Post:")) > 2)
    for mark in ECHOES:
        echoed = echoed | raw.contains(mark)
    label = parse_label(cleaned)
    low, weak = F.lower(cleaned), F.lit(False)
    for word in WEAK:
        weak = weak | low.contains(word)
    weak = low.contains("yes") & weak
    start = F.substring(strip(raw), 1, 100)
    return F.when(echoed, F.struct(F.lit("no").alias("label"), F.lit(ECHOED).alias("reasoning"))).when(label.isNotNull(), F.struct(label.alias("label"), parse_reasoning(cleaned).alias("reasoning"))).when(weak, F.struct(F.lit("yes").alias("label"), F.concat(F.lit("Fallback parsing (weak keyword match): "), start).alias("reasoning"))).otherwise(F.struct(F.lit("no").alias("label"), F.concat(F.lit("Fallback (no strong signal): "), start).alias("reasoning")))
