"""Schemas of the screening engine's tables, as Spark DDL."""

ANSWER = "struct<choice:string,confidence:double,noul:double,cause:string>"
SPEC_DOCS = "doc string, text string, last_commit timestamp"
SYMBOLS = "name string, kind string, file string, line int, source string, value string"
CONFIG_ROWS = "key string, role string, file string, line int, text string, value string, profile string"
SPEC_MAP = "spec string, line int, text string, code array<string>, status string, why string, alternatives array<string>, spec_text string"
RULE_MAP = "source string, line int, text string, rule string, scope array<string>, flags array<string>, keep_comments boolean, status string, why string, duplicate_of string"
VERDICTS = "rule string, file string, code_sha string, verdict string, why string, date date, seq long"
REQUESTS = "item_id string, family string, request_key string, body string, seq long"
ANSWERS = f"request_key string, n int, answer {ANSWER}, error string"
