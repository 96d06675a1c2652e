"""Texts through a runner's stages as rounds of a plan: parts that fail are halved, and the halves are rows that are dealt anew.

No task works off a text's failures by itself. A round asks for all open halves of all texts at once, each
different one once; tries that are used are summed by text or part, and results are put back by place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.backends import ANSWERS, BETWEEN, ODD, PARTS, Runner, Stage
from folioflow.plans.stages import bounded, dropped, staged, staged_apart

#: What a token that starts a word begins with.
MARK = "▁"
#: Words that a part has to have to be halved.
LEAST_WORDS = 4
#: Failed texts whose keys are broadcast.
BROADCAST_KEYS = 200_000


def middle(stage: Stage, units: str = "units") -> Column:
    """How many units the first half gets: half of the words; of tokens those up to the word's start nearest to the middle, the first of equals, in the inner half. Null where a part can't be halved."""
    n, u = F.size(units), F.col(units)
    if stage.on_words:
        return F.when(n >= LEAST_WORDS, F.floor(n / 2).cast("int"))
    inner = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (4 * k >= n) & (4 * k <= 3 * n) & F.coalesce(F.get(u, k).startswith(MARK), F.lit(False)))
    return F.array_min(F.transform(inner, lambda k: F.struct(F.abs(2 * k - n).alias("away"), k.alias("k"))))["k"]


def together(units: str) -> Column:
    """Units as one text, which takes a third of an array's room where it is moved; as JSON where they hold what stands between units."""
    one = F.array_join(units, BETWEEN)
    plain = (F.size(units) > 0) & ~F.exists(units, lambda u: u.contains(BETWEEN)) & ~one.startswith(ODD)
    return F.when(plain, one).otherwise(F.concat(F.lit(ODD), F.to_json(units)))


def answered(parts: DataFrame, stage: Stage, target: str, beam: int, level: int | None = None) -> DataFrame:
    """ANSWERS to parts; equal parts reach the model once, wherever they stand. Rows with an error keep it.

    Equal parts meet in one task, one behind the other, and carry their places with them: no part is moved a second time.
    A row has a value, or an error, or else units that the next round has to ask for: at no level those of the part that
    failed, at a level, where it was asked for by itself, its halves, in a row each.
    """
    error = F.col("error") if "error" in parts.columns else F.lit(None).cast("string").alias("error")
    rows = parts.select("key", "nth", "path", "lang", F.when(F.col("units").isNotNull(), together("units")).alias("part"), error)
    rows = rows.repartition("lang", F.coalesce("part", "key")).sortWithinPartitions("lang", "part")
    found = rows.mapInPandas(stage.asker(target, beam), ANSWERS)
    if level is None:
        return found.withColumn("error", F.when(~F.col("again"), F.col("error")))
    cut = F.when(F.col("again") & F.lit(level < stage.depth), middle(stage))
    half = lambda side, units: F.struct(F.concat("path", F.lit(side)).alias("path"), units.alias("units"))
    halves = F.array(half("0", F.slice("units", F.lit(1), F.col("cut"))), half("1", F.slice("units", F.col("cut") + 1, F.size("units"))))
    whole = F.array(F.struct("path", F.lit(None).cast("array<string>").alias("units")))
    cut_up = F.col("cut").isNotNull()
    rows = found.withColumn("cut", cut).withColumn("h", F.explode(F.when(cut_up, halves).otherwise(whole)))
    return rows.select("key", "nth", "h.path", "lang", "h.units", "value", F.when(~cut_up, F.col("error")).alias("error"), cut_up.alias("again"))


def asked(parts: DataFrame, stage: Stage, target: str, beam: int, level: int | None = None) -> DataFrame:
    """answered, staged."""
    return staged(answered(parts, stage, target, beam, level))


def through(rows: DataFrame, stage: Stage, target: str, spent: bool = False) -> DataFrame:
    """(key, lang, value, error, n_tries) of rows (key, lang, text), each key once. spent rows are staged ones that nothing else reads; they are dropped as soon as their parts were asked for.

    What fails is asked for again with the narrowest beam, then as two halves, and so on to a depth. A text
    fails as a whole if a part fails that can't be halved, or if its tries don't suffice for all halves.
    n_tries counts what was asked for again, up to the round in which a text failed.
    """
    budget = ["key"] if stage.shared else ["key", "nth"]
    parts = rows.mapInPandas(stage.split, PARTS).withColumn("path", F.lit(""))
    settled, open_ = staged_apart(answered(parts, stage, target, stage.beam), "again")
    if spent:
        dropped(rows)
    # each text has a row of the first round, which tells its language
    done, used = [settled, staged(open_.select("key", "lang").distinct())], None
    dead = lambda: reduce(DataFrame.unionByName, [x.filter("error is not null").select("key", "error") for x in done if "error" in x.columns])
    for level in range(stage.depth + 1):
        if open_.isEmpty():
            break
        more = open_.select(*budget).join(dead(), "key", "left_anti").groupBy(*budget).agg(F.count("*").alias("used"))
        before, used = used, staged(more if used is None else used.unionByName(more).groupBy(*budget).agg(F.sum("used").alias("used")))
        if before is not None:
            dropped(before)
        done.append(staged(used.filter(F.col("used") > stage.tries).select("key", F.lit("ChunkError: no tries are left").alias("error")).distinct()))
        gone = staged(dead().select("key").distinct())
        again = open_.join(bounded(gone, BROADCAST_KEYS), "key", "left_anti").select("key", "nth", "path", "lang", "units")
        settled, halves = staged_apart(answered(again, stage, target, 1, level), "again")
        dropped(open_, gone)
        open_ = halves
        done.append(settled)
    empty = {"nth": "int", "path": "string", "lang": "string", "value": "string", "error": "string"}
    every = [x.select("key", *[F.col(name) if name in x.columns else F.lit(None).cast(kind).alias(name) for name, kind in empty.items()]) for x in done]
    placed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("nth", "path", "value"))))
    whole = F.array_join(F.transform(placed, lambda x: x["value"]), " ")
    # dealt as rows, which take less room than the lists that tasks would make of them before
    out = reduce(DataFrame.unionByName, every).repartition("key").groupBy("key").agg(F.max("lang").alias("lang"), whole.alias("value"), F.min("error").alias("error"))
    tries = F.lit(0).cast("long")
    if used is not None:
        out = out.join(used.groupBy("key").agg(F.sum("used").alias("n_tries")), "key", "left")
        tries = F.coalesce("n_tries", tries)
    found = staged(out.select("key", "lang", F.when(F.col("error").isNull(), F.col("value")).alias("value"), "error", tries.alias("n_tries")))
    dropped(*done, open_, *([] if used is None else [used]))
    return found


def translated(texts: DataFrame, runner: Runner, spent: bool = False) -> DataFrame:
    """(key, lang, value, error, n_tries) of texts (key, lang, text), keys once each, staged: the text after all of the runner's stages, or the error of the first that it fails in. spent as in through."""
    found = through(texts if spent else texts.select("key", "lang", "text"), runner.stages[0], runner.target, spent)
    for stage in runner.stages[1:]:
        last = through(found.filter("error is null").select("key", "lang", F.col("value").alias("text")), stage, runner.target)
        both = last.join(found.select("key", F.col("n_tries").alias("before")), "key").withColumn("n_tries", F.col("n_tries") + F.col("before")).drop("before")
        before, found = found, staged(both.unionByName(found.filter("error is not null")))
        dropped(before, last)
    return found
