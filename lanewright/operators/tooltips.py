"""Item tooltips: what each section shows, and the one line that stands for the item.

All of it is expressions over an item's nested arrays, so an item is one row
from input to output and nothing is shuffled.

Defined results: names that are no property, or whose value is nothing or
zero, show nothing; of stats with one label the first counts; an item without
sections takes its description; one without anything has no headline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions import text

STATS = "array<struct<label:string,value:string>>"
#: Property values that show nothing, and the kind of section that counts last.
NOTHING, INNATE = ("", "0", "0.0"), "innate"


def stats(names: Column, properties: Column) -> Column:
    """Label and shown value of the named properties, in their order."""
    told = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.try_element_at(properties, n))
    sound = F.filter(told, lambda p: (F.length(p["label"]) > 0) & ~F.coalesce(F.trim(p["value"]), F.lit("")).isin(*NOTHING))
    return F.transform(sound, lambda p: F.struct(p["label"].alias("label"), text.stat_value(F.trim(p["value"]), p["prefix"], p["postfix"]).alias("value"))).cast(STATS)


def first_of_each(xs: Column) -> Column:
    """Stats without those whose label came before."""
    names = F.transform(xs, lambda x: x["label"])
    return F.filter(xs, lambda x, i: F.array_position(names, x["label"]) == i + 1)


def shown(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.concat(x["value"], F.lit(" "), x["label"]))


def conditions(icons: Column) -> Column:
    names = F.filter(F.transform(icons, lambda c: c["localized_name"]), lambda n: F.length(n) > 0)
    return F.coalesce(names, F.array().cast("array<string>"))


def headline(parts: Column, prose: Column) -> Column:
    """The best line: of sections that do something, then of the others, their leading stats, then
    named conditions, then important stats; else the prose's first sentence.

    ``parts``: array of struct(kind, leading, conditions, important), each of the last three an array of lines."""
    def lines(innate: bool, field: str) -> Column:
        own = F.filter(parts, lambda p: F.coalesce(p["kind"] == INNATE, F.lit(False)) == innate)
        return F.try_element_at(F.flatten(F.transform(own, lambda p: F.coalesce(p[field], F.array().cast("array<string>")))), F.lit(1))

    ranked = [lines(innate, field) for innate in (False, True) for field in ("leading", "conditions", "important")]
    return F.coalesce(*ranked, text.first_sentence(prose))


def item_tooltips(items: DataFrame, rules: text.Rules = text.Rules()) -> DataFrame:
    """(id, name, headline, sections) of raw items; a section is struct(kind, prose, stats, conditions), its prose sanitised."""
    every = F.flatten(F.transform(F.col("tooltip_sections"), lambda s: F.transform(s["section_attributes"], lambda a: F.struct(s["section_type"].alias("kind"), a.alias("a")))))
    props = F.col("properties")
    told = F.transform(
        F.coalesce(every, F.array()),
        lambda x: F.struct(
            x["kind"].alias("kind"), F.coalesce(x["a"]["loc_string"], F.lit("")).alias("raw"), stats(x["a"]["elevated_properties"], props).alias("leading"),
            stats(x["a"]["important_properties"], props).alias("important"), stats(x["a"]["properties"], props).alias("plain"), conditions(x["a"]["important_properties_with_icon"]).alias("conditions"),
        ),
    )
    rows = items.select("id", "name", F.col("description.desc").alias("description"), told.alias("told"))
    bare = ~F.exists("told", lambda t: F.length(t["raw"]) > 0) & (F.length("description") > 0)
    prose = F.when(bare, F.array("description")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "name", "told", F.concat(prose, F.transform("told", lambda t: t["raw"])).alias("raw"), bare.alias("bare"))
    rows = rows.withColumn("prose", text.sanitise_all("raw", rules))
    extra = F.when(F.col("bare"), F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("prose")[0].alias("prose"), F.array().cast(STATS).alias("stats"), F.array().cast("array<string>").alias("conditions"))))
    own = F.transform("told", lambda t, i: F.struct(t["kind"].alias("kind"), F.element_at("prose", i + 1 + F.when(F.col("bare"), 1).otherwise(0)).alias("prose"), first_of_each(F.concat(t["leading"], t["important"], t["plain"])).alias("stats"), t["conditions"].alias("conditions")))
    kind = "array<struct<kind:string,prose:string,stats:" + STATS + ",conditions:array<string>>>"
    lines = F.transform("told", lambda t: F.struct(t["kind"].alias("kind"), shown(t["leading"]).alias("leading"), t["conditions"].alias("conditions"), shown(t["important"]).alias("important")))
    return rows.select("id", "name", headline(lines, F.array_join("prose", " ")).alias("headline"), F.concat(F.coalesce(extra, F.array()).cast(kind), own.cast(kind)).alias("sections"))


def section_headlines(sections: DataFrame) -> DataFrame:
    """(item_id, headline) of stored sections (section_id, item_id, kind, prose, conditions): the first named
    condition, of sections that do something before innate ones, else the first sentence of the first section with words.

    Each section is reduced to one line before items are grouped, so an item may have any number of sections."""
    named = F.try_element_at(F.filter("conditions", lambda c: F.length(c) > 0), F.lit(1))
    rows = sections.where(F.col("item_id").isNotNull()).select("item_id", "section_id", F.coalesce(F.col("kind") == INNATE, F.lit(False)).alias("late"), named.alias("named"), text.first_sentence(F.col("prose")).alias("sentence"))
    best = F.min(F.when(F.col("named").isNotNull(), F.struct("late", "section_id", "named")))
    return rows.groupBy("item_id").agg(F.coalesce(best["named"], F.min(F.when(F.col("sentence").isNotNull(), F.struct("section_id", "sentence")))["sentence"]).alias("headline"))
