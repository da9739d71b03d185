"""Prompt text for a summarising service and parsing of its replies.

No call is made here: prompts are a column to send, replies a column received.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The service's limit and the fields of a reply.
PROMPT_TEXT_LIMIT = 30_000
REPLY_FIELDS = ("summary", "key_terms", "llm_confidence", "llm_confidence_reason")
_REPLY_TYPE = ("summary string, key_terms array<string>, llm_confidence string, "
               "llm_confidence_reason string")
_STRICT = {"allowSingleQuotes": "false"}

def prompt_parts(text: Column, instruction: str, limit: int = PROMPT_TEXT_LIMIT) -> Column:
    """Prompts for a whole document, as an array of (part, parts, prompt).

    The service takes ``limit`` characters, so a longer document is sent in parts;
    every character is in exactly one. An empty or null document is one empty part.
    """
    whole = F.coalesce(text, F.lit(""))
    parts = F.greatest(F.lit(1), F.ceil(F.length(whole) / limit)).cast("int")
    return F.transform(F.sequence(F.lit(1), parts), lambda i: F.struct(
        i.alias("part"), parts.alias("parts"),
        F.concat(F.lit(instruction + "\n\n<<<\n"),
                 F.substring(whole, (i - 1) * limit + 1, F.lit(limit)), F.lit("\n>>>")).alias("prompt")))


def message_content(envelope: Column) -> Column:
    """The first message of a chat-completion response body."""
    return F.get_json_object(envelope, "$.choices[0].message.content")


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def without_fences(text: Column) -> Column:
    """Reply without an opening and closing code fence."""
    opened = F.regexp_replace(_trim(F.coalesce(text, F.lit(""))), r"(?iU)\A```(?:json)?\s*", "")
    return _trim(F.regexp_replace(opened, r"(?U)(?<!\s)\s*+```\s*\z", ""))


def json_candidate(text: Column) -> Column:
    """From the first opening to the last closing brace; empty when there is none.

    A reply that is one valid object is its own candidate, so this covers both
    the direct parse and the fallback for prose around the object.
    """
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parsed_object(candidate: Column) -> Column:
    """The reply fields of a candidate, or null unless it is exactly one object.

    ``from_json`` on its own ignores whatever follows the first object. Inside
    a list, trailing text or a second object breaks the parse instead.
    """
    listed = F.from_json(F.concat(F.lit("["), candidate, F.lit("]")),
                         f"array<struct<{_ddl_fields()}>>", _STRICT)
    return F.when(F.size(listed) == 1, F.get(listed, 0))


def _ddl_fields() -> str:
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in _REPLY_TYPE.split(","))


def present_fields(candidate: Column) -> Column:
    """Which fields the object holds, with their text; null values stay null."""
    wrapped = F.from_json(F.concat(F.lit('{"reply":'), candidate, F.lit("}")),
                          "reply map<string,string>", _STRICT)
    return wrapped["reply"]


def with_default(fields: Column, parsed: Column, name: str, default: Column) -> Column:
    """A field, or the default when it is absent; an explicit null stays null."""
    return F.when(F.map_contains_key(fields, name), parsed[name]).otherwise(default)
