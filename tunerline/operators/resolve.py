"""Name resolution: an ordered cascade over distinct keys, with a memo that outlasts a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunerline.functions.similarity import FAMILIES, bounded, combined_of, jaro, may_reach, network_family, sides, winkler
from tunerline.functions.text import normalize
from tunerline.functions.titles import callsigns, is_event, network_city, parse_event
from tunerline.operators.lookup import by_callsign, last_by_key
from tunerline.operators.scratch import settle

# Confidence by method, and the least score of a fuzzy match.
CONFIDENCE = {"tvg_id": 0.99, "alias": 0.95, "callsign": 0.90, "network_city": 0.75}
THRESHOLD = 0.85
#: Parts that the candidates of a family are dealt into, so that no family is one task where the join has to shuffle.
SLICES = 16

MEMO = "normalized_key string, canonical_id string, method string, confidence double"


def prepare(channels: DataFrame) -> DataFrame:
    """channels (source_id, stream_key, name, tvg_id, group_name) with normalized_key, feed_hint, is_event and event (the parsed title)."""
    n = normalize(F.col("name"))
    out = channels.withColumn("_n", n).withColumn("is_event", is_event(F.col("name"), F.col("group_name"))).withColumn("event", parse_event(F.col("name")))
    return out.withColumn("normalized_key", F.col("_n.normalized")).withColumn("feed_hint", F.col("_n.feed_hint")).drop("_n")


def first_per_key(prepared: DataFrame) -> DataFrame:
    """The row that decides for its key: the first by source and stream that is no event."""
    row = F.struct("source_id", "stream_key", *[c for c in prepared.columns if c not in ("source_id", "stream_key", "normalized_key")])
    first = prepared.where(~F.col("is_event")).groupBy("normalized_key").agg(F.min_by(row, F.struct("source_id", "stream_key")).alias("_r"))  # adds up in tasks: a hot key is a row for each
    return first.select("_r.*", "normalized_key").select(*prepared.columns)


def best_fuzzy(keys: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD, prune: bool = True) -> DataFrame:
    """key, canonical_id, score: the best candidate (name_key, ref_id, pos, alt_pos) from the threshold on; the first of equals.

    A key of a network family meets its family's candidates by an equi join; a key without one may equal any. Jaro
    has no index that keeps every pair (letters may move), so pairs are ruled out by what lengths and 126 bits of letters
    allow, in generated code while they are joined; the Python kernel and the token sets see the rest, and keys come
    distinct. Where the join shuffles, families are dealt into SLICES parts, each key going to all of its own."""
    part = F.pmod(F.xxhash64("name_key"), F.lit(SLICES)).cast("int")
    c = candidates.select("name_key", "ref_id", "pos", "alt_pos", F.coalesce(network_family(F.col("name_key")), F.lit("")).alias("family"), part.alias("part"), sides(F.col("name_key")).alias("y"))
    everyone = F.array(*[F.lit(f) for f in ["", *(f for _, f in FAMILIES)]])
    k = keys.select("key").distinct().withColumn("own", network_family(F.col("key"))).withColumn("x", sides(F.col("key")))
    k = k.select("key", "x", F.explode(F.when(F.col("own").isNotNull(), F.array("own")).otherwise(everyone)).alias("family"))
    k = k.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    pairs = k.join(c, ["family", "part"]).drop("family", "part")
    if prune:
        pairs = pairs.where(bounded(F.col("key"), F.col("name_key"), F.col("x"), F.col("y"), threshold) & may_reach(F.col("key"), F.col("name_key"), threshold))
    pairs = pairs.drop("x", "y")
    scored = pairs.withColumn("j", jaro(F.col("key"), F.col("name_key")))
    scored = scored.withColumn("score", combined_of(winkler(F.col("j"), F.col("key"), F.col("name_key")), F.col("key"), F.col("name_key")))
    best = scored.groupBy("key").agg(F.max_by(F.struct("ref_id", "score"), F.struct("score", -F.col("pos"), -F.col("alt_pos"))).alias("b"))
    return best.where(F.col("b.score") >= threshold).select("key", F.col("b.ref_id").alias("canonical_id"), F.col("b.score").alias("score"))


def _hit(id_: Column, method: str, ok: Column) -> Column:
    return F.when(ok, F.struct(id_.alias("canonical_id"), F.lit(method).alias("method"), F.lit(CONFIDENCE[method]).alias("confidence")))


def decide(rows: DataFrame, reference: DataFrame, index: DataFrame, aliases: DataFrame, stations: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A memo row for each row of rows (one for each key): exact id, reference name, alias, call sign, network and city, fuzzy, unresolved.

    reference: id of the open channels; index, aliases: from lookup; stations: callsign, network, city, pos."""
    k = rows.select(F.col("normalized_key").alias("key"), "name", "tvg_id")
    k = k.join(reference.select(F.col("id").alias("tvg_id"), F.lit(True).alias("_id")), "tvg_id", "left")
    k = k.join(index.select(F.col("name_key").alias("key"), F.col("ref_id").alias("_ref")), "key", "left")
    k = k.join(aliases.select(F.col("name_key").alias("key"), F.col("canonical").alias("_alias")), "key", "left")
    k = k.join(by_callsign(k, callsigns(F.col("name")), stations).withColumnRenamed("callsign", "_sign"), "key", "left")
    city = network_city(F.col("name"))
    k = k.withColumn("_net", city["network"]).withColumn("_city", F.lower(city["city"]))
    places = last_by_key(stations.select(F.upper("network").alias("_net"), F.lower("city").alias("_city"), F.col("callsign").alias("_place"), "pos"), "_net", "_city").drop("pos")
    k = k.join(places, ["_net", "_city"], "left")
    got = F.coalesce(
        _hit(F.col("tvg_id"), "tvg_id", F.col("_id")), _hit(F.col("_ref"), "alias", F.col("_ref").isNotNull()), _hit(F.col("_alias"), "alias", F.col("_alias").isNotNull()),
        _hit(F.concat(F.lit("station:"), "_sign"), "callsign", F.col("_sign").isNotNull()), _hit(F.concat(F.lit("station:"), "_place"), "network_city", F.col("_place").isNotNull()),
    )
    k = settle(k.select("key", got.alias("_got")), "decided")
    fuzzy = best_fuzzy(k.where("_got is null"), index, threshold)
    k = k.join(fuzzy, "key", "left")
    last = F.when(F.col("score").isNotNull(), F.struct("canonical_id", F.lit("fuzzy").alias("method"), F.col("score").alias("confidence"))).otherwise(F.struct(F.lit(None).cast("string").alias("canonical_id"), F.lit("unresolved").alias("method"), F.lit(0.0).alias("confidence")))
    return k.withColumn("_got", F.coalesce("_got", last)).select(F.col("key").alias("normalized_key"), "_got.*")


def resolve(channels: DataFrame, reference: DataFrame, index: DataFrame, aliases: DataFrame, stations: DataFrame, memo: DataFrame | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(resolutions, new memo rows). Events resolve to themselves; other rows share what their key's first row, or the memo, decides.

    Names are parsed once: the prepared rows, what the exact lookups decide, and the new memo rows are written for those who read them."""
    p = settle(prepare(channels), "prepared")
    todo = first_per_key(p)
    if memo is not None:
        todo = todo.join(memo.select("normalized_key"), "normalized_key", "left_anti")
    fresh = settle(decide(todo, reference, index, aliases, stations, threshold), "memo-rows")
    known = fresh if memo is None else memo.select(*fresh.columns).unionByName(fresh)
    joined = p.join(known, "normalized_key", "left")
    event = F.col("is_event")
    out = joined.select("source_id", "stream_key", "normalized_key", "feed_hint", "is_event", "event", F.when(~event, F.col("canonical_id")).alias("canonical_id"), F.when(event, "event_channel").otherwise(F.col("method")).alias("method"), F.when(event, 1.0).otherwise(F.col("confidence")).alias("confidence"))
    return out, fresh
