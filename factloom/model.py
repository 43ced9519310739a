"""Schemas of the fact relations and the fixed codes that queries share."""

from __future__ import annotations

from pyspark.sql import types as T

#: Symbol kinds in code order (0 to 10), access codes and symbol flag bits.
SYMBOL_KINDS = ("Variable", "Sub", "Method", "Package", "Class", "Module", "Field", "Enumerator", "HashKeyDef", "Handler", "Namespace")
ACCESS = {"Read": 0, "Write": 1, "Declaration": 2}
LINKAGE, HIDDEN, LEXICAL, EXPORTED = 1, 2, 4, 8
#: Role bits of files, edge kind bits and severity ranks.
ROLES = {"open": 1, "workspace": 2, "dependency": 4, "builtin": 8}
EDGE_KINDS = {"inherits": 1, "app_surface": 2, "inherits_inv": 4, "bridges": 8, "specializes": 16}
#: The caveat of medians of too few runs, and the verdicts of a comparison with a baseline.
PROVISIONAL = "PROVISIONAL (n<3)"
REGRESSED, IMPROVED, UNCHANGED = "REGRESSED", "improved", "ok"
SEVERITIES = ("error", "warning", "info", "hint")

POINT = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())])
SPAN = T.StructType([T.StructField("start", POINT), T.StructField("end", POINT)])

FILES = "file_id BIGINT, path STRING, source STRING"
STRINGS = "str_id BIGINT, s STRING"
REFS = "name_id BIGINT, file_id BIGINT"
SYMS = "file_id BIGINT, name_id BIGINT, key_id BIGINT, kind INT, start_row INT, start_col INT, end_row INT, end_col INT, container_id BIGINT, flags INT"
EDGES = "src STRING, dst STRING, kind INT, ord INT"
WITNESSES = "att_type STRING, att_key STRING, source_kind STRING, priority INT, payload_type STRING, payload STRING, start_pos BIGINT, end_pos BIGINT, seq BIGINT"
CONCLUSIONS = "path STRING, generation BIGINT, map STRING, source_fingerprint BIGINT"
MEASUREMENTS = "run_id STRING, corpus STRING, phase STRING, rep INT, kind STRING, name STRING, value DOUBLE, unit STRING"
RUNS = "run_id STRING, ts TIMESTAMP, sha STRING, dirty BOOLEAN, loadavg_at_start DOUBLE"
