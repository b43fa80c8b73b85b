"""Deeply nested records as flat node tables with interval labels.

A depth-first walk numbers every object and array of a document on entering
(``pre``) and on leaving (``post``); a node lies inside another exactly if its
interval does.  Nodes of the declared types become rows (document, type, pre,
post, pos, key, fields); parents are found again by containment, with one
sweep over a document's nodes in ``pre`` order, which is linear however many
parents a document holds.

Defined results: a payload that is null, empty or not valid JSON gives no rows;
nesting may have any depth; JSON inside a JSON string is read too, at the top,
anywhere above a marked object and under declared keys; an absent, null or empty array gives no child rows; ``pos`` counts null entries; a
lone object where an array is usual has position 0; a field that is absent,
null or not of its type is null, numbers in strings are numbers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.runtime import stored


class NodeType(NamedTuple):
    """A kind of node: objects under ``key`` of a ``parent`` node, or, without
    parent, any object that has the field ``marker``.  ``mapped``: an object
    under ``key`` maps keys to nodes.  ``fields``: column -> (path, type)."""

    name: str
    fields: dict[str, tuple[tuple[str, ...], str]]
    parent: str | None = None
    key: str | None = None
    marker: str | None = None
    mapped: bool = False


def _long(x: Any) -> int | None:
    if x.__class__ is int:
        return x if -(1 << 63) <= x < 1 << 63 else None
    if x.__class__ is str:
        try:
            return _long(int(x))
        except ValueError:
            return None
    if x.__class__ is float and x == x and abs(x) < 1 << 63 and x == int(x):
        return int(x)
    return None


def _text(x: Any) -> str | None:
    return x if x.__class__ is str else None if x is None or x.__class__ in (dict, list) else json.dumps(x)


#: Kinds of fields: the Arrow type and how a JSON value becomes one; "present" is 1 for any value.
ARROW = {"long": (pa.int64(), _long), "string": (pa.string(), _text), "present": (pa.int64(), lambda x: 1)}


SPACE = re.compile(r"[ \t\n\r]*")
ATOM = json.JSONDecoder().scan_once


def _deep(text: str) -> Any:
    """``json.loads`` with a stack of its own, for nesting beyond the parser's depth."""
    skip = lambda i: SPACE.match(text, i).end()
    open_: list[Any] = []
    keys: list[str] = []

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        k, i = ATOM(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        keys.append(k)
        return skip(i + 1)

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "[" or c == "{":
            value: Any = [] if c == "[" else {}
            i = skip(i + 1)
            if text[i : i + 1] != ("]" if c == "[" else "}"):
                open_.append(value)
                i = i if c == "[" else key(i)
                continue
            i += 1
        else:
            try:
                value, i = ATOM(text, i)
            except StopIteration:
                raise ValueError("no value") from None
        while open_:
            top = open_[-1]
            listed = top.__class__ is list
            if listed:
                top.append(value)
            else:
                top[keys.pop()] = value
            i = skip(i)
            c = text[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                i = i if listed else key(i)
                break
            if c != ("]" if listed else "}"):
                raise ValueError("no end")
            value = open_.pop()
            i += 1
        else:
            if skip(i) != len(text):
                raise ValueError("more than a value")
            return value


def parsed(text: str | None) -> Any:
    """The JSON value of ``text``, also of JSON encoded as a string, however often; None if it isn't valid."""
    while text.__class__ is str:  # each string is shorter than its encoding
        try:
            text = json.loads(text)
        except RecursionError:
            try:
                text = _deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
    return text


class Walker:
    """One walk over one document at a time; rows gather by type."""

    def __init__(self, types: list[NodeType]) -> None:
        self.types = types
        self.under = {(t.parent, t.key): i for i, t in enumerate(types) if t.key}
        self.markers = [(t.marker, i) for i, t in enumerate(types) if t.marker]
        self.getters = [[(path, ARROW[kind][1]) for path, kind in t.fields.values()] for t in types]
        self.rows: list[list[tuple]] = [[] for _ in types]

    def read(self, doc: int, text: str | None) -> None:
        value = parsed(text)
        self.doc, self.n = doc, 0
        if value.__class__ in (dict, list):
            self.walk(value)

    def walk(self, x: Any) -> None:
        """What holds no declared type yet: containers, and strings that may be JSON, down to the marked objects."""
        left: list[Iterator[tuple[int, Any]]] = [iter([(0, x)])]
        while left:
            for pos, v in left[-1]:
                if v.__class__ is str and v.lstrip()[:1] in ("{", "[", '"'):
                    v = parsed(v)
                if v.__class__ is dict:
                    marked = next((i for marker, i in self.markers if marker in v), None)
                    if marked is not None:
                        self.node(v, marked, pos, None)
                        continue
                    self.n += 1
                    left.append(iter([(0, y) for y in v.values()]))
                    break
                if v.__class__ is list:
                    self.n += 1
                    left.append(enumerate(v))
                    break
            else:
                left.pop()
                self.n += 1

    def passed(self, x: Any) -> None:
        """A container of no declared type inside a node: only its intervals count."""
        left = [x]
        while left:
            v = left.pop()
            self.n += 2
            left += [y for y in (v.values() if v.__class__ is dict else v) if y.__class__ is dict or y.__class__ is list]

    def node(self, x: dict, i: int, pos: int, key: str | None) -> None:
        """An object of type ``i``."""
        self.n += 1
        pre, t = self.n, self.types[i]
        for k, v in x.items():
            kind = v.__class__
            if kind is dict or kind is list or kind is str:
                child = self.under.get((t.name, k))
                if child is None:
                    if kind is not str:
                        self.passed(v)
                else:
                    self.children(parsed(v), child)
        self.n += 1
        values = []
        for path, cast in self.getters[i]:
            v = x.get(path[0])
            for p in path[1:]:
                v = v.get(p) if v.__class__ is dict else None
            values.append(v if v is None else cast(v))
        self.rows[i].append((self.doc, pre, self.n, pos, key, *values))

    def children(self, v: Any, i: int) -> None:
        """The nodes of type ``i`` that a value holds."""
        if v.__class__ is list:
            self.n += 1
            for pos, x in enumerate(v):
                if x.__class__ is dict:
                    self.node(x, i, pos, None)
            self.n += 1
        elif v.__class__ is dict:
            if self.types[i].mapped:
                self.n += 1
                for pos, (key, x) in enumerate(v.items()):
                    if x.__class__ is dict:
                        self.node(x, i, pos, key)
                self.n += 1
            else:
                self.node(v, i, 0, None)


def node_table(records: DataFrame, doc: str, payload: str, types: list[NodeType]) -> DataFrame:
    """(doc, type, pre, post, pos, key, fields...): rows of all declared nodes. No shuffle."""
    columns: dict[str, str] = {}
    for t in types:
        columns |= {c: kind for c, (_, kind) in t.fields.items()}
    head = {"doc": pa.int64(), "type": pa.string(), "pre": pa.int64(), "post": pa.int64(), "pos": pa.int32(), "key": pa.string()}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(types)

        def full() -> Iterator[pa.RecordBatch]:
            for t, rows in zip(types, walker.rows):
                if not rows:
                    continue
                n, cols = len(rows), list(zip(*rows))
                arrays = [pa.array(cols[0], pa.int64()), pa.array([t.name], pa.string()).take(pa.array([0] * n)), *(pa.array(c, a) for c, a in zip(cols[1:5], list(head.values())[2:]))]
                own = dict(zip(t.fields, cols[5:]))
                arrays += [pa.array(own[c], ARROW[k][0]) if c in own else pa.nulls(n, ARROW[k][0]) for c, k in columns.items()]
                rows.clear()
                yield pa.RecordBatch.from_arrays(arrays, [*head, *columns])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                walker.read(d, text.as_py())
                if sum(map(len, walker.rows)) >= 50_000:
                    yield from full()
        yield from full()

    schema = "doc long, type string, pre long, post long, pos int, key string" + "".join(f", {c} {'long' if k == 'present' else k}" for c, k in columns.items())
    return records.select(F.col(doc).cast("long").alias("doc"), F.col(payload)).where(F.length(payload) > 0).mapInArrow(label, schema)


def linked(nodes: DataFrame, child: str, parents: dict[str, str], value: Column) -> DataFrame:
    """(doc, pre, post, pos, value, <parent>_pre, <parent>_value...): each ``child``
    node with the enclosing node of each type in ``parents`` (type -> value expression).

    One sweep per document: the last node of a type that began before the child
    holds it if it ends after it.  Only small numbers travel.
    """
    pick = F.when(F.col("type") == child, value)
    for p, expression in parents.items():
        pick = pick.when(F.col("type") == p, F.expr(expression))
    rows = nodes.where(F.col("type").isin(child, *parents)).select("doc", "pre", "post", "pos", "type", pick.alias("value"))
    sweep = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for p in parents:
        rows = rows.withColumn(p, F.last(F.when(F.col("type") == p, F.struct("pre", "post", "value")), ignorenulls=True).over(sweep))
    out = rows.where(F.col("type") == child)
    inside = {p: F.col(f"{p}.post") > F.col("post") for p in parents}
    return out.select("doc", "pre", "post", "pos", "value", *(x for p in parents for x in (F.when(inside[p], F.col(f"{p}.pre")).alias(f"{p}_pre"), F.when(inside[p], F.col(f"{p}.value")).alias(f"{p}_value"))))


def _at(*names: str, kind: str = "long") -> dict[str, tuple[tuple[str, ...], str]]:
    return {n: ((n,), kind) for n in names}


MATCH = NodeType(
    "match", _at("match_id", "duration_s", "average_badge") | _at("winning_team", "match_outcome", kind="string") | {"has_objectives": (("objectives",), "present")}, marker="match_id"
)
PLAYER = NodeType(
    "player",
    _at("player_slot", "hero_id", "account_id", "hero_build_id", "pregame_hero_id", "assigned_lane") | _at("team", "player_match_outcome", kind="string") | {"final_net_worth": (("net_worth",), "long")},
    "match",
    "players",
    mapped=True,
)
ITEM = NodeType(
    "item",
    _at("item_id", "game_time_s", "sold_time_s", "upgrade_info", "imbued_ability_id") | {"imbue_target": (("imbue", "target", "ability_id"), "long")},
    "player",
    "items",
)
STAT = NodeType("stat", _at("time_stamp_s", "net_worth"), "player", "stats")
OBJECTIVE = NodeType("objective", _at("destroyed_time_s") | _at("team_objective", kind="string") | {"loser": (("team",), "string")}, "match", "objectives")
BOSS = NodeType("boss", {"boss_time_s": (("destroyed_time_s",), "long")} | _at("team_killed", "team_claimed", kind="string"), "match", "mid_boss")
EVERY = [MATCH, PLAYER, ITEM, STAT, OBJECTIVE, BOSS]


def narrowed(node: NodeType, *columns: str) -> NodeType:
    """The type with only some of its fields."""
    return node._replace(fields={c: node.fields[c] for c in columns})


def latest_matches(nodes: DataFrame, pulls: DataFrame, doc: str = "raw_id") -> DataFrame:
    """(doc, pre, match_id): of each match the node of its latest valid pull
    (ties: the larger document id, then the later place in it)."""
    when = pulls.select(F.col(doc).cast("long").alias("doc"), "pulled_at")
    matches = nodes.where((F.col("type") == "match") & F.col("match_id").isNotNull()).select("doc", "pre", "match_id")
    best = matches.join(when, "doc").groupBy("match_id").agg(F.max(F.struct("pulled_at", "doc", "pre")).alias("best"))
    return best.select("best.doc", "best.pre", "match_id")


def slot_of(slot: str = "player_slot", key: str = "key") -> str:
    """A player's slot: its own field, or the key under which a map holds it."""
    return f"coalesce({slot}, try_cast({key} as bigint))"


def item_entries(pulls: DataFrame) -> DataFrame:
    """(match_id, player_slot, item_pos, item_id): item entries of each match's latest valid pull."""
    types = [narrowed(MATCH, "match_id"), narrowed(PLAYER, "player_slot"), narrowed(ITEM, "item_id")]
    nodes = stored(node_table(pulls, "raw_id", "payload", types), "nodes")
    entries = linked(nodes, "item", {"match": "match_id", "player": slot_of()}, F.col("item_id")).where(F.col("value").isNotNull())
    chosen = latest_matches(nodes, pulls).select("doc", F.col("pre").alias("match_pre"))
    return entries.join(chosen, ["doc", "match_pre"], "left_semi").select(
        F.col("match_value").alias("match_id"), F.col("player_value").cast("int").alias("player_slot"), F.col("pos").alias("item_pos"), F.col("value").alias("item_id")
    )


def flat_tables(pulls: DataFrame, *names: str) -> dict[str, DataFrame]:
    """The node tables of the latest valid pulls by name (all, or those named with the types above them);
    each row carries match_id and, below players, player_pre, player_slot and the player's hero (``player_hero``).

    One sweep ties all types at once and its rows are stored, so that a plan that reads many of the tables many
    times holds scans only.  Matches that a later pull replaces are left out before the sweep; what they hold then lies in none."""
    wanted = {t.name for t in EVERY} if not names else {"match", *names} | ({"player"} if {"item", "stat"} & set(names) else set())
    types = [t for t in EVERY if t.name in wanted]
    nodes = stored(node_table(pulls, "raw_id", "payload", types), "nodes")
    kind = F.col("type")
    latest = nodes.where(kind == "match").join(latest_matches(nodes, pulls).select("doc", "pre"), ["doc", "pre"], "left_semi")
    sweep = Window.partitionBy("doc").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = {"match": {"match_pre": "pre", "up_match": "match_id"}} | ({"player": {"player_pre": "pre", "up_slot": slot_of(), "player_hero": "hero_id"}} if "player" in wanted else {})
    rows, ties = latest.unionByName(nodes.where(kind != "match")), []
    for p, values in above.items():
        rows = rows.withColumn(f"_{p}", F.last(F.when(kind == p, F.struct("post", *(F.expr(v).alias(c) for c, v in values.items()))), ignorenulls=True).over(sweep))
        ties += [F.when(F.col(f"_{p}.post") >= F.col("post"), F.col(f"_{p}.{c}")).alias(c) for c in values]
    flat = stored(rows.select(*nodes.columns, *ties).where("match_pre is not null"), "flat")
    out = {"match": flat.where(kind == "match").select("doc", "match_pre", *MATCH.fields)}
    for t in types[1:]:
        extra = ["player_pre", F.col("up_slot").cast("int").alias("player_slot"), "player_hero"] if t.parent == "player" else []
        own = [F.expr(slot_of()).cast("int").alias(c) if c == "player_slot" else F.col(c) for c in t.fields]
        out[t.name] = flat.where(kind == t.name).select("doc", "pre", "pos", F.col("up_match").alias("match_id"), *extra, "key", *own)
    return out
