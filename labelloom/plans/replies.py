"""Replies of the summarising service, parsed as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import replies as R


def parsed_replies(replies: DataFrame, envelope: bool = False) -> DataFrame:
    """Parse ``doc_id, status_code, body`` into the reply fields.

    ``parse_status`` is ``ok``, ``http_error``, ``no_json``, ``invalid_json`` or
    ``wrong_type`` (key terms that are no list); ``error`` says more. Only the
    fields of an ``ok`` row are filled. With ``envelope`` the body is the whole
    chat-completion response, otherwise it is the message itself.
    """
    body = F.col("body")
    message = R.message_content(body) if envelope else body
    answered = F.coalesce(F.col("status_code") == 200, F.lit(False))
    texts = replies.select(
        "doc_id", "status_code", "body", answered.alias("answered"),
        R.without_fences(F.when(answered, message)).alias("reply"),
    ).withColumn("candidate", R.json_candidate(F.col("reply")))
    parsed = texts.withColumns({
        "parsed": R.parsed_object(F.col("candidate")),
        "fields": R.present_fields(F.col("candidate")),
    })
    whole = F.col("parsed").isNotNull() & F.col("fields").isNotNull()
    mistyped = (F.try_element_at("fields", F.lit("key_terms")).isNotNull()
                & F.col("parsed.key_terms").isNull())
    status = (
        F.when(~F.col("answered"), "http_error")
        .when(F.col("candidate") == "", "no_json")
        .when(~whole, "invalid_json")
        .when(mistyped, "wrong_type")
        .otherwise("ok")
    )
    error = (
        F.when(F.col("parse_status") == "http_error",
               F.concat(F.lit("HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("?")),
                        F.lit(": "), F.coalesce(body, F.lit(""))))
        .when(F.col("parse_status") == "no_json",
              F.concat(F.lit("No JSON: "), F.col("reply")))
    )
    defaults = {
        "summary": F.lit(""),
        "key_terms": F.array().cast("array<string>"),
        "llm_confidence": F.lit("low"),
        "llm_confidence_reason": F.lit(""),
    }
    good = F.col("parse_status") == "ok"
    return parsed.withColumn("parse_status", status).select(
        "doc_id", "status_code", "parse_status", error.alias("error"),
        *[F.when(good, R.with_default(F.col("fields"), F.col("parsed"), name, default)).alias(name)
          for name, default in defaults.items()],
    )
