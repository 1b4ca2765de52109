"""Whole episodes: decisions against labels, ledgers of incidents, localisation, retention, leaderboards, thresholds by family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators import calibrate as cal
from gaugeline.operators import detect, labels, ranked
from gaugeline.operators import metrics as me
from gaugeline.operators import sequence as sq


def scored_episodes(ticks: DataFrame, faults: DataFrame, good: Column, since: int, k: int = 2, before: int = 5, key: str = "machine") -> DataFrame:
    """(key, tp, fp, fn, first_hit) of the dwell-confirmed union of exceedance and failures against ``faults``, from step ``since`` on; ``good`` rows are
    those to fit on. Windows, both joins and the aggregate are keyed by entity."""
    down = F.col("state") == "DOWN"
    d = detect.exceedance(ticks, cal.tukey_fit(ticks, good, (key,)), down, (key,))
    d = sq.confirmed(d, F.col("alarm"), down, k, before, sq.Series(keys=(key,)), out="dec").select(key, "step", "dec")
    d = labels.active(d.filter(F.col("step") >= since), faults, (key,)).withColumn("y", F.col("y") == 1)
    c = me.counts(F.col("dec"), F.col("y"))
    return d.groupBy(key).agg(c["tp"].alias("tp"), c["fp"].alias("fp"), c["fn"].alias("fn"), F.min(F.when(F.col("dec") & F.col("y"), F.col("step"))).alias("first_hit"))


ARMS = ("quantile", "structural", "ml", "cusum")


def full_scores(arms: DataFrame, faults: DataFrame, since: int, noisy: Column, late: int = 5, k: int = 3, before: int = 5, episode: str = "ep", key: str = "machine") -> DataFrame:
    """(episode, class, origin, tp, fp, fn, hit, top, latency, and a hit of each of ARMS) of every episode of ``arms`` (episode, key, step, score, and a boolean for each of ARMS), with at most one of
    ``faults`` (episode, origin, class, t0, t1) each.

    An episode's decision at a step is that of the first three arms, of any entity, that has k alarms among itself and the ``before`` steps before it, or the cusum arm, which has a memory of its own. It is
    held against the fault's steps from ``since`` on. A hit may be up to ``late`` steps after the fault: of quantile and structural at its origin, of the others anywhere. top is the entity
    with the highest score during the fault, or the runner-up of a noisy one (``noisy``, of the entity); latency its first positive score from t0 on, 999 without one."""
    of = [F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in ARMS]
    steps = arms.groupBy(episode, "step").agg(*of)
    steps = sq.confirmed(steps, F.col("quantile") | F.col("structural"), F.col("ml"), k, before, sq.Series(keys=(episode,)), out="__c")
    f = faults.select(episode, "origin", "class", "t0", "t1")
    near = (F.col("step") >= F.col("t0")) & (F.col("step") < F.col("t1") + late)
    dec, y = F.col("__c") | F.col("cusum"), (F.col("step") >= F.col("t0")) & (F.col("step") < F.col("t1"))
    steps = steps.join(f, episode, "left").withColumns({"__d": dec, "__y": F.coalesce(y, F.lit(False)), "__s": F.col("step") >= since, "__near": F.coalesce(near, F.lit(False))})
    c = me.counts(F.col("__d") & F.col("__s"), F.col("__y") & F.col("__s"))
    any_ = lambda x, name: F.coalesce(F.bool_or(x & F.col("__near")), F.lit(False)).alias(name)
    whole = steps.groupBy(episode, "class", "origin").agg(c["tp"].alias("tp"), c["fp"].alias("fp"), F.count_if(~F.col("__d") & F.col("__y") & F.col("__s")).alias("fn"), any_(F.col("__d"), "hit"), any_(F.col("ml"), "ml"), any_(F.col("cusum"), "cusum"))
    here = arms.join(f, episode).filter(near)
    own = here.filter(F.col(key) == F.col("origin")).groupBy(episode).agg(*[F.bool_or(F.coalesce(F.col(a), F.lit(False))).alias(a) for a in ("quantile", "structural")])
    each = here.groupBy(episode, key).agg(F.max(F.when(y, F.col("score"))).alias("peak"), F.min(F.when(F.col("score") > 0, F.col("step") - F.col("t0"))).alias("__first"))
    top = detect.blamed(each.filter("peak is not null").select(episode, key, "peak"), (episode,), key, noisy).select(episode, F.col(key).alias("top"))
    top = top.join(each.select(episode, F.col(key).alias("top"), "__first"), [episode, "top"])
    out = whole.join(own, episode, "left").join(top, episode, "left")
    false = lambda x: F.coalesce(F.col(x), F.lit(False)).alias(x)
    return out.select(episode, "class", "origin", "tp", "fp", "fn", "hit", "top", F.when(F.col("class").isNotNull(), F.coalesce("__first", F.lit(999))).alias("latency"), *map(false, ARMS))


def full_battery(scores: DataFrame, late: int = 5, by: str = "class") -> DataFrame:
    """(by, n, hits, ac1, tp, fp, fn, and how many hits each of ARMS has) of ``full_scores``; ac1: the right entity named in no more than ``late`` steps. Episodes without a fault are those of a null class, whose fp are
    the clean false alarms."""
    named = (F.col("top") == F.col("origin")) & (F.col("latency") <= late)
    return scores.groupBy(by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if(named).alias("ac1"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.count_if(a).alias(a) for a in ARMS])


def battery(episodes: DataFrame, faults: DataFrame, by: str = "class", key: str = "machine") -> DataFrame:
    """(by, n, hits, tp, fp, fn, latency) of scored episodes by their fault's class; latency is the mean over hits."""
    e = episodes.join(faults.select(key, by, "t0"), key, "left").groupBy(by)
    latency = F.try_divide(F.sum(F.col("first_hit") - F.col("t0")).cast("double"), F.count("first_hit"))
    return e.agg(F.count("*").alias("n"), F.count_if(F.col("tp") > 0).alias("hits"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], latency.alias("latency"))


def incidents(ticks: DataFrame, faults: DataFrame, sensor: Column, sensor_width: int = 10, transport_width: int = 5, key: str = "machine") -> DataFrame:
    """(kind, key, step): failures, sensor and transport incidents, at most one each of the latter in a stretch of so many steps, and labels."""
    s = sq.Series(keys=(key,))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), key, "step")
    out = kind(ticks.filter("state = 'DOWN'"), "failure").unionByName(kind(sq.debounced(ticks.filter(sensor), sensor_width, s), "sensor"))
    out = out.unionByName(kind(sq.debounced(ticks.filter("state = 'BLOCKED'"), transport_width, s), "transport"))
    return out.unionByName(kind(faults.withColumn("step", F.col("t0")), "label"))


def counted(df: DataFrame, by: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """(by, <kind> ...): how many of each kind."""
    return df.groupBy(by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def localise_error(ticks: DataFrame, faults: DataFrame, trigger: Column, by: str = "class", key: str = "machine") -> DataFrame:
    """(by, med, p90, n): from a fault's start to its entity's first trigger."""
    o = ticks.join(faults, key).groupBy(key, by).agg(F.abs(F.min(F.when(trigger, F.col("step"))) - F.min("t0")).alias("err"))
    return o.groupBy(by).agg(F.percentile("err", F.lit(0.5)).alias("med"), F.percentile("err", F.lit(0.9)).alias("p90"), F.count("err").alias("n"))


def retention(df: DataFrame, by: str, after: Column, score: str = "score", y: str = "y", loss: float = 0.05) -> DataFrame:
    """(by, before, after_, verdict): the AUC of rows before and after a change; retained if it falls by no more than ``loss``."""
    a = me.auc(df.withColumn("__after", after.cast("int")), (by, "__after"), score, y)
    g = a.groupBy(by).agg(F.max(F.when(F.col("__after") == 0, F.col("auc"))).alias("before"), F.max(F.when(F.col("__after") == 1, F.col("auc"))).alias("after_"), F.count("*").alias("n")).filter("n = 2")
    return g.select(by, "before", "after_", F.when(F.col("after_") >= F.col("before") - loss, "retained").otherwise("lost").alias("verdict"))


def root_or_median(ticks: DataFrame, faults: DataFrame, counter: str, key: str = "machine") -> DataFrame:
    """(key, step, counter): an entity's own counter while its fault is active, else the median of all at that step, cut to a whole number."""
    m = ranked.exact_quantiles(ticks, [counter], [0.5], ("step",)).select("step", F.floor(F.get(counter, F.lit(0))).cast("long").alias("__med"))
    d = labels.active(ticks.select(key, "step", counter), faults, (key,)).join(m, "step")
    return d.select(key, "step", F.when(F.col("y") == 1, F.col(counter)).otherwise(F.col("__med")).alias(counter))


def stream_delay(ticks: DataFrame, faults: DataFrame, hit: Column, width: int = 8, key: str = "machine") -> DataFrame:
    """(key, windows): from a fault's first window to the first one of ``width`` steps that is hit."""
    w = ticks.groupBy(key, F.floor(F.col("step") / F.lit(width)).alias("k")).agg(hit.alias("dec"))
    w = w.join(faults.select(key, "t0"), key).filter(F.col("dec") & (F.col("k") * width >= F.col("t0") - (width - 1)))
    return w.groupBy(key).agg((F.min("k") - F.min(F.floor(F.col("t0") / F.lit(width)))).alias("windows"))


def leaderboard(df: DataFrame, by: str, entry: str, score: str = "score") -> DataFrame:
    """(by, entry, n, best, place): entries of each group by their best score, ties by entry."""
    g = df.groupBy(by, entry).agg(F.count("*").alias("n"), F.max(score).alias("best"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("best").desc(), entry)))


def latest_capped(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The ``most`` latest rows of each key, with overflow: how many there are besides."""
    w = Window.partitionBy(key)
    t = df.withColumns({"__rn": F.row_number().over(w.orderBy(F.col(order).desc())), "__n": F.count("*").over(w)})
    return t.filter(F.col("__rn") <= most).withColumn("overflow", F.greatest(F.lit(0), F.col("__n") - most)).drop("__rn", "__n")


def priority(faults: DataFrame, by: Column, key: str = "machine") -> DataFrame:
    """(g, root, severest): of each group the class of the earliest fault and the entity of the gravest, ties by entity."""
    return faults.groupBy(by.alias("g")).agg(F.min_by("class", F.struct("t0", key)).alias("root"), F.max_by(key, F.struct("mag", -F.col(key))).alias("severest"))


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "score", y: str = "y") -> DataFrame:
    """(thr, tp, fp, f1) of all thresholds in one pass: a row explodes into no more than those asked for."""
    s = df.select(F.col(score).alias("s"), (F.col(y) == 1).alias("y"), F.explode(F.array(*map(F.lit, thresholds))).alias("thr"))
    hit = F.col("s") >= F.col("thr")
    g = s.groupBy("thr").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if("y").alias("p"))
    return g.select("thr", "tp", "fp", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0)).alias("f1"))


def by_family_threshold(df: DataFrame, own: Column, share: float, family: str, score: str = "score") -> DataFrame:
    """``df`` with dec: at or over the ``share`` quantile of its family where ``own`` holds, else of all rows (one row)."""
    f = ranked.exact_quantiles(df.filter(own), [score], [share], (family,)).select(family, F.get(score, F.lit(0)).alias("__t"))
    g = ranked.exact_quantiles(df, [score], [share]).select(F.get(score, F.lit(0)).alias("__g"))
    return df.join(f, family, "left").join(F.broadcast(g), F.lit(True)).withColumn("dec", F.col(score) >= F.coalesce("__t", "__g")).drop("__t", "__g")


def imputed(df: DataFrame, value: str, lost: Column, clean: Column, key: str = "machine") -> DataFrame:
    """``df`` with the entity's clean median in the place of lost values; null without clean rows."""
    med = F.percentile(F.when(clean, F.col(value)), F.lit(0.5)).over(Window.partitionBy(key))
    return df.withColumn(value, F.when(lost, med).otherwise(F.col(value)))


def purged(windows: DataFrame, key: str, order: str, ends: int) -> DataFrame:
    """Windows without the ``ends`` first and last of each entity."""
    p = Window.partitionBy(key)
    w = windows.withColumns({"__a": F.row_number().over(p.orderBy(order)), "__b": F.row_number().over(p.orderBy(F.col(order).desc()))})
    return w.filter((F.col("__a") > ends) & (F.col("__b") > ends)).drop("__a", "__b")


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): the rows as lines of a table."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"))


def event_feed(events: DataFrame, entity: Column, kinds: tuple[str, ...], kind: str = "event_type") -> DataFrame:
    """The events of the chosen entities and kinds; an unknown kind chooses nothing."""
    return events.filter(entity & F.col(kind).isin(*kinds))


def down_kind(ticks: DataFrame, faults: DataFrame, key: str = "machine") -> DataFrame:
    """(key, step, kind) of each failure: injected while a fault is active, else natural."""
    d = labels.active(ticks.filter("state = 'DOWN'"), faults, (key,))
    return d.select(key, "step", F.when(F.col("class").isNull(), "natural").otherwise("injected").alias("kind"))
