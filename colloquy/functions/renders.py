"""Text that is rendered for a prompt, a person or an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def question(term: Column) -> Column:
    return F.format_string("In your own words, what is %s and why does it matter here?", term)


def prompt_id(version: str, template: str) -> str:
    """Version and the start of the template's hash."""
    import hashlib

    return f"{version}-{hashlib.sha256(template.encode()).hexdigest()[:8]}"


def ordered_block(rows: DataFrame, key: str, order: list[str], line: Column, name: str = "block") -> DataFrame:
    """One text a key: its lines in order."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return packed.select(key, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias(name))


def map_fingerprint(rows: DataFrame, side: str, name: str) -> DataFrame:
    """16 hex digits of the sorted names of both sides, as a JSON object with ", " and ": " between its parts."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.col(name), r'(["\\])', r"\\$1"), F.lit('"'))
    by = rows.groupBy(side).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(quoted)), ", "), F.lit("]")).alias("l"))
    whole = by.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col(side), F.lit('": '), "l"))), ", ").alias("j"))
    return whole.select(F.left(F.sha2(F.concat(F.lit("{"), "j", F.lit("}")), 256), F.lit(16)).alias("fingerprint"))


def backticked(text: Column) -> Column:
    """Distinct inline code of a text without its fences."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"(?s)```.*?(```|$)", " "), F.lit(r"`([^`\n]+)`"), 1))


def clean_markdown(text: Column) -> Column:
    """Without URLs, backticks and runs of markup, spaces single."""
    bare = F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), "`", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(^|\s)[#*_>|~-]+(?=\s|$)", " "), r"\s+", " "))


def number(value: Column, kind: Column) -> Column:
    """A JSON value as a double: strings are read, booleans and what cannot be read are null."""
    return F.when(kind != "boolean", value.try_cast("double"))


def usage(payload: Column) -> Column:
    """tokens_in, tokens_out and cost of a call's usage object (JSON text); a local call has no cost."""
    field = lambda *names: F.coalesce(*[F.get_json_object(payload, f"$.{n}").try_cast("double") for n in names])
    local = F.coalesce(F.get_json_object(payload, "$.local") == "true", F.lit(False))
    own = field("cost") + F.coalesce(F.when(F.get_json_object(payload, "$.is_byok") == "true", field("cost_details.upstream_inference_cost")), F.lit(0.0))
    return F.struct(field("prompt_tokens", "input_tokens").alias("tokens_in"), field("completion_tokens", "output_tokens").alias("tokens_out"), F.when(~local, own).alias("cost"))


def difficulty(depth: Column, level: Column) -> Column:
    """How far a concept's depth lies from a person's level."""
    return F.when(level.isNull() | (level == 0), "outside").when(depth <= level - 1, "easy").when(depth == level, "boundary_known").when(depth == level + 1, "boundary_unknown").otherwise("hard")


def mean_sd_text(mean: Column, sd: Column) -> Column:
    return F.when(mean.isNull(), F.lit("-")).when(sd.isNull(), F.format_string("%.2f", mean)).otherwise(F.format_string("%.2f ± %.2f", mean, sd))


def camel(term: Column) -> Column:
    return term.rlike(r"^[A-Za-z]*[a-z][A-Z][A-Za-z]*$")
