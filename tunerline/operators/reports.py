"""Small results as files: JSON reports and dimension files written back."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame

from tunerline.operators.state import _fs


def _put(spark, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_json(summary: DataFrame, path: str, entries: DataFrame | None = None) -> dict:
    """One JSON document of a summary of one row, with the rows of entries (as many as a report lists, not a whole table), on any file system that Spark reaches."""
    body = summary.first().asDict(recursive=True)
    if entries is not None:
        body["entries"] = [r.asDict(recursive=True) for r in entries.collect()]
    _put(summary.sparkSession, path, json.dumps(body, indent=2, default=str, ensure_ascii=False))
    return body


def disabled(data: dict, audit: DataFrame) -> dict:
    """A dimension file's data with the leagues disabled whose path failed (audit: espn_path, ok, error)."""
    bad = {r["espn_path"]: r["error"] or "verification failed" for r in audit.where("not ok").select("espn_path", "error").collect()}  # leagues of one file
    out = copy.deepcopy(data)
    for category in out["categories"]:
        for league in category["leagues"]:
            if league["espnPath"] in bad:
                league["disabled"], league["disabledReason"] = True, bad[league["espnPath"]]
    return out


def write_dimension(spark, data: dict, path: str) -> None:
    """A dimension file as JSON or YAML, by its name."""
    if path.endswith(".json"):
        text = json.dumps(data, indent=2, ensure_ascii=False)
    else:
        import yaml

        text = yaml.safe_dump(data, sort_keys=False, allow_unicode=True)
    _put(spark, path, text)
