"""Versions of what is written again and again: numbered notes, the last of which names the current one.

A note is made in one step and never changed, so a reader finds a whole version or the one before, and a writer that is
broken off leaves no trace in the notes. Two writers of one number are an error of the later one.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from loomspark.sources import io


def _notes(spark: SparkSession, folder: str) -> list[int]:
    fs, place = io._filesystem(spark, f"{folder.rstrip('/')}/_notes")
    names = [str(x.getPath().getName()) for x in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _note(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/_notes/{number:010d}.json"


def current(spark: SparkSession, folder: str) -> dict | None:
    """What the last note says, with its number; null where there is none."""
    numbers = _notes(spark, folder)
    return {**io.read_json(spark, _note(folder, numbers[-1])), "number": numbers[-1]} if numbers else None


def commit(spark: SparkSession, folder: str, version: str, keep: int = 2, **facts) -> dict:
    """Makes a version (a name inside the folder) the current one; versions before the last `keep` ones go."""
    numbers = _notes(spark, folder)
    number = numbers[-1] + 1 if numbers else 1
    io.write_bytes(spark, _note(folder, number), json.dumps({"version": version, **facts}, sort_keys=True).encode())
    for old in numbers[: max(0, len(numbers) + 1 - keep)]:
        name = io.read_json(spark, _note(folder, old))["version"]
        io._delete(spark, f"{folder.rstrip('/')}/{name}")
        io._delete(spark, _note(folder, old))
    return {**facts, "version": version, "number": number}


def path_of(folder: str, note: dict) -> str:
    return f"{folder.rstrip('/')}/{note['version']}"
