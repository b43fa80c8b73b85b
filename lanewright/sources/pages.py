"""Pages of matches: reading, and pulling them from a paged source."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields that the operators read; an absent array is null, an empty one is empty.
MATCH = """match_id long, winning_team string, match_outcome string, average_badge int, duration_s int,
players array<struct<player_slot:int,team:string,hero_id:int,account_id:long,assigned_lane:int,net_worth:long,player_match_outcome:string,hero_build_id:long,pregame_hero_id:long,
items:array<struct<item_id:long,game_time_s:int,sold_time_s:int,upgrade_info:int,imbued_ability_id:long>>,stats:array<struct<time_stamp_s:int,net_worth:long>>>>,
objectives array<struct<team_objective:string,destroyed_time_s:int,team:string>>, mid_boss array<struct<destroyed_time_s:int,team_killed:string,team_claimed:string>>"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Matches of pages (files with an array of matches each); of a match on several pages the first file's counts.

    Pages hold a few hundred matches, so a file is a task's worth of work.
    """
    rows = spark.read.schema(MATCH).option("multiLine", True).json(path).where("match_id is not null").withColumn("_file", F.input_file_name())
    first = F.row_number().over(Window.partitionBy("match_id").orderBy("_file"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "_file")


def players(matches: DataFrame) -> DataFrame:
    """One row per player, with the match's fields."""
    return matches.select("match_id", "winning_team", "match_outcome", "average_badge", "duration_s", F.col("objectives").isNotNull().alias("has_objectives"), F.explode("players").alias("p")).select("*", "p.*").drop("p")


def entries(matches: DataFrame) -> DataFrame:
    """One row per item entry of each player, ``pos`` being its place in the array."""
    return players(matches).select("match_id", "player_slot", "hero_id", F.posexplode("items").alias("pos", "e")).select("match_id", "player_slot", "hero_id", "pos", "e.*")


def net_worth_samples(matches: DataFrame) -> DataFrame:
    return players(matches).select("match_id", "player_slot", F.explode("stats").alias("s")).select("match_id", "player_slot", "s.*")


def cache_name(path: str, params: dict[str, Any]) -> str:
    """File name of an answer: the path as a slug and a hash of path and sorted parameters."""
    key = hashlib.sha256(f"{path}?{json.dumps(params, sort_keys=True)}".encode()).hexdigest()
    return f"{path.strip('/').replace('/', '_')}-{key[:16]}.json"


class Pace:
    """At most so many calls a minute for each name; callers wait their turn."""

    def __init__(self, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.last: dict[str, float] = {}
        self.lock, self.now, self.sleep = threading.Lock(), now, sleep

    def wait(self, name: str, per_minute: float) -> None:
        with self.lock:
            left = self.last.get(name, float("-inf")) + 60 / per_minute - self.now()
            if left > 0:
                self.sleep(left)
            self.last[name] = self.now()


class Refused(Exception):
    """The source wants to be asked later (``after`` seconds, if it says so)."""

    def __init__(self, after: float | None = None) -> None:
        super().__init__("refused")
        self.after = after


def fetched(fetch: Callable[[str, dict[str, Any]], Any], path: str, params: dict[str, Any], folder: Path, pace: Pace | None = None, per_minute: float = 10, tries: int = 5) -> Any:
    """An answer from the folder, else from ``fetch``, written in one piece; refusals are retried with growing waits."""
    place = folder / cache_name(path, params)
    if place.exists():
        return json.loads(place.read_text())
    pace = pace or Pace()
    for attempt in range(tries):
        pace.wait(path, per_minute)
        try:
            answer = fetch(path, params)
            break
        except Refused as e:
            if attempt == tries - 1:
                raise
            pace.sleep(e.after + 1 if e.after is not None else min(120, 5 * 2**attempt))
    folder.mkdir(parents=True, exist_ok=True)
    draft = place.with_suffix(".tmp")
    draft.write_text(json.dumps(answer))
    os.replace(draft, place)
    return answer


def pulled(fetch: Callable[[int | None], list[dict[str, Any]]], n: int, page: int = 200) -> Iterator[list[dict[str, Any]]]:
    """Pages newest first, each below the smallest id so far, until ``n`` matches, an empty or a short page."""
    below, got = None, 0
    while got < n:
        rows = fetch(below)
        if rows:
            yield rows
        got += len(rows)
        if len(rows) < page:
            return
        below = min(r["match_id"] for r in rows) - 1
