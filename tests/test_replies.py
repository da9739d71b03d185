import json

from pyspark.sql import functions as F

from labelloom.functions.replies import prompt_parts
from labelloom.plans.replies import parsed_replies

OBJECT = {"summary": "s", "key_terms": ["a", "b"], "llm_confidence": "high",
          "llm_confidence_reason": "r"}
BARE = json.dumps(OBJECT)
FULL = ("ok", "s", ["a", "b"], "high", "r")

CASES = {
    "bare": (BARE, FULL),
    "spaces": (f"\n  {BARE} \t\n", FULL),
    "fenced": (f"```json\n{BARE}\n```", FULL),
    "fenced upper": (f"```JSON {BARE}```  ", FULL),
    "plain fence": (f"```\n{BARE}\n```", FULL),
    "prose": (f"Here it is:\n{BARE}\nDone.", FULL),
    "trailing text": (f"{BARE} and more", FULL),
    "pretty": (json.dumps(OBJECT, indent=2), FULL),
    "trailing brace": (BARE + " }", ("invalid_json",)),
    "two objects": (BARE + BARE, ("invalid_json",)),
    "two listed objects": (f"{BARE}, {BARE}", ("invalid_json",)),
    "closed list": (f"{BARE}] [{BARE}", ("invalid_json",)),
    "truncated": (BARE[:-1], ("no_json",)),
    "truncated in braces": ('{"summary": "a } b", "key_terms": [', ("invalid_json",)),
    "single quotes": ("{'summary': 's'}", ("invalid_json",)),
    "no object": ("sorry", ("no_json",)),
    "empty": ("", ("no_json",)),
    "null": (None, ("no_json",)),
    "list only": ('["a"]', ("no_json",)),
    "empty object": ("{}", ("ok", "", [], "low", "")),
    "missing": ('{"summary": "s"}', ("ok", "s", [], "low", "")),
    "explicit nulls": ('{"summary": null, "key_terms": null, "llm_confidence": null}',
                       ("ok", None, None, None, "")),
    "wrong type": ('{"summary": "s", "key_terms": "abc"}', ("wrong_type",)),
    "number as text": ('{"summary": 5, "key_terms": [1, null]}', ("ok", "5", ["1", None], "low", "")),
    "extra field": ('{"summary": "s", "other": {"x": [1]}}', ("ok", "s", [], "low", "")),
}


def test_reply_shapes(spark):
    df = spark.createDataFrame([(k, 200, body) for k, (body, _) in CASES.items()],
                               "doc_id string, status_code int, body string")
    for r in parsed_replies(df).collect():
        want = CASES[r.doc_id][1]
        got = (r.parse_status, r.summary, r.key_terms, r.llm_confidence, r.llm_confidence_reason)
        assert got == (want if len(want) > 1 else want + (None,) * 4), r.doc_id


def test_failed_calls(spark):
    df = spark.createDataFrame([(1, 500, "x" * 400), (2, None, BARE), (3, 200, "nothing" + "y" * 400)],
                               "doc_id int, status_code int, body string")
    rows = {r.doc_id: r for r in parsed_replies(df).collect()}
    assert rows[1].parse_status == "http_error" and rows[1].error == "HTTP 500: " + "x" * 400
    assert rows[2].parse_status == "http_error" and rows[2].summary is None
    assert rows[3].error == "No JSON: nothing" + "y" * 400


def test_response_envelope(spark):
    body = json.dumps({"choices": [{"message": {"content": f"```json\n{BARE}\n```"}}]})
    df = spark.createDataFrame([(1, 200, body)], "doc_id int, status_code int, body string")
    row = parsed_replies(df, envelope=True).first()
    assert (row.parse_status, row.summary, row.key_terms) == ("ok", "s", ["a", "b"])


def test_prompts_hold_every_character_once(spark):
    texts = ["ab" * 15_000 + "é" * 30_001, None, "x" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select("id", F.inline(prompt_parts(F.col("t"), "Go."))).collect()
    head, tail = "Go.\n\n<<<\n", "\n>>>"
    for i, text in enumerate(texts):
        mine = sorted((r.part, r.parts, r.prompt) for r in rows if r.id == i)
        assert [m[0] for m in mine] == list(range(1, mine[0][1] + 1))
        assert "".join(m[2].removeprefix(head).removesuffix(tail) for m in mine) == (text or "")
    assert sorted(r.id for r in rows) == [0, 0, 0, 1, 2]
