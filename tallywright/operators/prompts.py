"""Prompt files with a SYSTEM: and a USER: part."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_PARTS = re.compile(r"^(SYSTEM|USER):[ \t]*\n?", re.M)


def parse_prompt(text: str) -> tuple[str, str]:
    """(system, user) parts, trimmed; fails if one is missing."""
    pieces = _PARTS.split(text)
    parts = {name: body.strip() for name, body in zip(pieces[1::2], pieces[2::2], strict=True)}
    if set(parts) != {"SYSTEM", "USER"}:
        raise ValueError("a prompt needs one SYSTEM: and one USER: part")
    return parts["SYSTEM"], parts["USER"]


def load_prompt(spark: SparkSession, path: str) -> tuple[str, str]:
    return parse_prompt(spark.read.text(path, wholetext=True).first()[0])
