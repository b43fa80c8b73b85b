"""Command line.

    python -m lanewright list
    python -m lanewright run NAME FOLDER [--out PATH]
    python -m lanewright heroes FOLDER
    python -m lanewright fit FOLDER MODEL [--badge 80|all]
    python -m lanewright build FOLDER --hero H [--archetype A]
    python -m lanewright next MODEL FOLDER --hero H [--archetype A] [--time m:ss] [--bought 1,2] [--souls N]
    python -m lanewright why MODEL FOLDER ITEM --hero H ...
    python -m lanewright watch MODEL FOLDER --hero H ...      # reads "ITEM [m:ss]" lines, advises after each

Items may be given by id or by name.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.functions.text import clock, resolve
from lanewright.operators import advice, backoff, evaluation
from lanewright.plans import adapters, build_queries, registry
from lanewright.runtime import forget, session, stored
from lanewright.sources import sinks


def _item(shop: DataFrame, text: str) -> int:
    return int(text) if text.strip().isdigit() else resolve(shop, "id", "name", text.strip())


def _state(args: argparse.Namespace, shop: DataFrame, shares: DataFrame) -> advice.State:
    """The state that the arguments tell; without an archetype, each of the hero's by its share."""
    bought = tuple(_item(shop, x) for x in args.bought.split(",") if x.strip())
    own = {r["archetype_id"]: r["share"] for r in shares.where(F.col("hero_id") == args.hero).collect()} or {0: 1.0}
    return advice.State(args.hero, clock(args.time), args.souls, bought, own if args.archetype is None else {args.archetype: 1.0})


def fitted(spark: SparkSession, folder: str, badge: float | None) -> tuple[DataFrame, DataFrame]:
    """Level tables, weighted towards a badge, and archetype shares of a folder of tables."""
    bought = stored(adapters.buys(spark, folder), "buys")
    labels = adapters.labels(bought)
    rows = backoff.row_weights(backoff.prepared(bought, labels, adapters.SEAT), adapters.SEAT, badge)
    return backoff.levels(rows, "weight"), backoff.archetype_shares(bought, labels, adapters.SEAT)


def heroes(spark: SparkSession, folder: str) -> DataFrame:
    """(hero_id, archetype_id, players, share, top items) of every group."""
    bought = stored(adapters.buys(spark, folder), "buys")
    cell = ["hero_id", "archetype_id"]
    labelled = bought.join(adapters.labels(bought), adapters.SEAT)
    top = evaluation.top_items(labelled, cell, 3).join(F.broadcast(adapters.items(spark, folder).select(F.col("id").alias("item_id"), "name")), "item_id")
    names = top.groupBy(*cell).agg(F.max("n_players").alias("players"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("items"))
    return names.join(backoff.archetype_shares(bought, adapters.labels(bought), adapters.SEAT), cell).select(*cell, "players", F.round("share", 3).alias("share"), "items").orderBy(*cell)


def watched(lines: Iterable[str], state: advice.State, levels: DataFrame, shop: DataFrame, show=print) -> advice.State:
    """Follows purchases ("ITEM [m:ss]", one a line) and shows advice before the first and after each; the last state."""
    tell = lambda s: show("; ".join(f"{r['name']} {r['p']:.3f}" for r in advice.advise(s, levels, shop, 3).collect()) or "nothing left to advise")
    tell(state)
    for line in lines:
        name, _, at = line.strip().rpartition(" ") if ":" in line else (line.strip(), "", "")
        if not name:
            continue
        try:
            state = state.after(_item(shop, name), clock(at) if at else None)
        except KeyError as e:
            show(e.args[0])
            continue
        tell(state)
    return state


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lanewright")
    out.add_argument("--master", default=None)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    commands.add_parser("heroes", help="groups of players of every hero").add_argument("folder")
    fit = commands.add_parser("fit", help="fit and save the next-item model")
    fit.add_argument("folder")
    fit.add_argument("model")
    fit.add_argument("--badge", type=advice.target_badge, default=backoff.TARGET)
    build = commands.add_parser("build", help="the build of a hero")
    build.add_argument("folder")
    build.add_argument("--hero", type=int, required=True)
    build.add_argument("--archetype", type=int, default=None)
    for name, text in (("next", "what to buy next"), ("why", "where an item's chance comes from"), ("watch", "advise while purchases come in")):
        command = commands.add_parser(name, help=text)
        command.add_argument("model")
        command.add_argument("folder")
        if name == "why":
            command.add_argument("item")
        command.add_argument("--hero", type=int, required=True)
        command.add_argument("--archetype", type=int, default=None)
        command.add_argument("--time", default="0:00")
        command.add_argument("--bought", default="")
        command.add_argument("--souls", type=int, default=None)
        command.add_argument("-n", type=int, default=5)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    queries = registry.queries()
    if args.command == "list":
        print(*queries, sep="\n")
        return 0
    if args.command == "run" and args.name not in queries:
        print(f"unknown query: {args.name}", file=sys.stderr)
        return 2
    spark = session(master=args.master)
    try:
        if args.command == "run":
            result = queries[args.name](spark, args.folder)
            if args.out:
                result.write.mode("overwrite").parquet(args.out)
            else:
                result.show(50, truncate=60)
        elif args.command == "heroes":
            heroes(spark, args.folder).show(500, truncate=80)
        elif args.command == "fit":
            sinks.save_model(*fitted(spark, args.folder, args.badge), args.model, badge=args.badge, kappa=backoff.KAPPA)
            print(f"{args.model}: {advice.badge_label(args.badge)}")
        elif args.command == "build":
            rows = build_queries.generated_builds(spark, args.folder).where(F.col("hero_id") == args.hero)
            rows = rows if args.archetype is None else rows.where(F.col("archetype_id") == args.archetype)
            named = rows.join(F.broadcast(adapters.items(spark, args.folder).select(F.col("id").alias("item_id"), "name", "cost")), "item_id")
            named.select("archetype_id", "position", "name", "cost", "p", "buy_time_s", "sell_time_s").orderBy("archetype_id", "position").show(200, truncate=40)
        else:
            shop = adapters.items(spark, args.folder)
            levels, shares, _ = sinks.load_model(spark, args.model)
            state = _state(args, shop, shares)
            if args.command == "next":
                advice.advise(state, levels, shop, args.n).show(args.n, truncate=40)
            elif args.command == "why":
                advice.explained(state, levels, _item(shop, args.item)).show(10, truncate=60)
            else:
                watched(sys.stdin, state, levels, shop)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    finally:
        forget(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
