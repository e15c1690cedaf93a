"""Explicit schemas of the relations that operators pass on."""

from __future__ import annotations

PATTERN = (
    "struct<type:string,pattern:string,query:string,sources:array<string>,sinks:array<string>,sanitizers:array<string>,"
    "where:array<struct<not_constant:boolean,not_sanitized:array<string>,not_test_file:boolean,inside_function:string>>,"
    "inside_type:string,inside_pattern:string,not_inside_type:string,not_inside_pattern:string>"
)
FIX = "struct<description:string,pattern:string,replace:string>"
RULES = (
    "id string, name string, description string, severity string, category string, confidence string, cwe string, "
    f"languages array<string>, frameworks array<string>, patterns array<{PATTERN}>, fix {FIX}, references array<string>, "
    "message string, rule_ord int"
)
FILES = "path string, content string"
LINES = "path string, language string, is_test_file boolean, line_no int, text string"
FINDINGS = (
    "rule_id string, rule_name string, severity string, category string, cwe string, message string, file string, line int, "
    f"column int, snippet string, fix {FIX}, fix_available boolean, references array<string>, confidence string, "
    "confidence_score double, quality_score int, metavars map<string,string>, phase int, rule_ord int, pattern_ord int"
)
BASELINE = "rule_id string, file string, line int, column int, snippet_hash string, rule_name string, severity string, snippet string"
VULNERABILITIES = "id string, summary string, severity string, package string, version string, fixed_version string, references array<string>"
CACHE = "path string, hash string, ruleset string, findings string"

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")
