"""A model's replies made fields, and what they cite held against the tokens.

tokens: sheet_id, tid, text, x0, y0, x1, y1, conf, agreement, candidates (array of structs: text, engine, conf,
source_bbox). Fields cite token ids (`tokens`) for what they say (`verbatim`). A sheet's tokens meet its fields in one row
(one shuffle by sheet); everything else is expressions over arrays in that row.

A field is evidenced if its verbatim is made up of readings of the cited tokens, one of each in their order, white space
and case aside. Which places of the verbatim can be reached after each token is a dynamic programme, folded over the
tokens; the first way to each place is kept.

Defined results: a field without tokens needs no evidence; a null verbatim is an empty one; null texts are empty; ids that
are cited twice are read twice. Of repeated tokens of one id the least by text stands. Replies that are null, no JSON
object or hold a key twice become one error row, and fields whose tokens are no whole numbers one each; items that are no
objects are passed over. Numbers as values are read as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import repair
from draftmill.functions.staging import let, stage
from draftmill.functions.text import reply_object, squeezed
from draftmill.operators.fusion import CANDIDATES

_IDS = "array<int>"
_REGION = "struct<tid:int,text:string,engine:string,bbox:array<int>>"


def _flat(s: Column) -> Column:
    return F.coalesce(squeezed(s), F.lit(""))


def sheet_tokens(tokens: DataFrame) -> DataFrame:
    """(sheet_id, by_id): a map of each sheet's tokens with their readings, the token's own text first, then what the
    candidates read differently."""
    return with_entries(tokens.filter("tid IS NOT NULL")).groupBy("sheet_id").agg(F.sort_array(F.collect_list("entry")).alias("es")).select("sheet_id", by_id(F.col("es")).alias("by_id"))


def by_id(entries: Column) -> Column:
    """The map of a sheet's sorted entries."""
    return F.map_from_entries(F.filter(entries, lambda e, i: (i == 0) | (e["tid"] != F.get(entries, i - 1)["tid"])))


def with_entries(tokens: DataFrame, *keep: str) -> DataFrame:
    """(sheet_id, entry) of tokens, and the columns to keep: a token as its sheet's map has it, null without tid."""
    box = F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")])
    candidates = F.coalesce(F.col("candidates").cast(CANDIDATES), F.array().cast(CANDIDATES))
    reading = lambda flat, text, by, at: F.struct(flat.alias("flat"), text.alias("text"), by.alias("engine"), at.alias("bbox"))
    others = F.transform(candidates, lambda c: reading(_flat(c["text"]), c["text"], c["engine"], F.coalesce(c["source_bbox"], box)))
    read = tokens.select("sheet_id", *keep, F.col("tid").cast("int").alias("__tid"), F.coalesce("text", F.lit("")).alias("__text"), F.col("conf").cast("double").alias("__conf"), F.col("agreement").cast("double").alias("__agreement"), box.alias("__box"), others.alias("__others"))
    read = stage(read, __own=_flat(F.col("__text")), __others=F.col("__others"))
    own, others = F.col("__own"), F.col("__others")
    engine = F.coalesce(F.get(F.filter(others, lambda c: c["flat"] == own), 0)["engine"], F.lit("token"))
    new = F.filter(others, lambda c, i: (c["flat"] != "") & (c["flat"] != own) & ~F.exists(F.slice(others, 1, i), lambda d: d["flat"] == c["flat"]))
    token = F.struct(F.col("__text").alias("text"), own.alias("flat"), F.col("__conf").alias("conf"), F.col("__agreement").alias("agreement"), F.concat(F.array(reading(own, F.col("__text"), engine, F.col("__box"))), new).alias("readings"))
    return read.select("sheet_id", *keep, F.when(F.col("__tid").isNotNull(), F.struct(F.col("__tid").alias("tid"), token.alias("t"))).alias("entry"))


def regions(ids: Column, target: Column, by_id: Column) -> Column:
    """The readings that make up the target (in capitals, without white space), an array of tid, text, engine and bbox; null if there are none, no ids, or
    ids that the sheet lacks."""
    return let(_cited(ids, by_id), lambda cited: let(_own(cited), lambda own: _regions(ids, target, by_id, cited, own)))


def _cited(ids: Column, by_id: Column) -> Column:
    return F.transform(ids, lambda i: F.try_element_at(by_id, i))


def _own(cited: Column) -> Column:
    return F.array_join(F.transform(cited, lambda t: t["flat"]), "")


def _known(cited: Column) -> Column:
    return F.forall(cited, lambda t: t.isNotNull())


def _regions(ids: Column, target: Column, by_id: Column, cited: Column, own: Column) -> Column:
    path = F.array().cast(f"array<{_REGION}>")
    begin = F.array(F.struct(F.lit(0).alias("end"), path.alias("path")))
    region = lambda tid, c: F.struct(tid.alias("tid"), c["text"].alias("text"), c["engine"].alias("engine"), c["bbox"].alias("bbox"))

    def after(ways: Column, tid: Column) -> Column:
        readings = F.try_element_at(by_id, tid)["readings"]

        def on(way: Column) -> Column:
            fits = F.filter(readings, lambda c: F.startswith(F.substr(target, way["end"] + 1), c["flat"]))
            return F.transform(fits, lambda c: F.struct((way["end"] + F.length(c["flat"])).alias("end"), F.concat(way["path"], F.array(region(tid, c))).alias("path")))

        return F.flatten(F.transform(ways, on))

    def first_ways(ways: Column) -> Column:
        return F.filter(ways, lambda w, i: ~F.exists(F.slice(ways, 1, i), lambda v: v["end"] == w["end"]))

    # one step by each token; what it gives is thinned out at the next step's start, as a lambda can't name a value
    ways = F.aggregate(ids, begin, lambda ways, tid: F.coalesce(after(first_ways(ways), tid), F.filter(begin, lambda _: F.lit(False))))
    whole = let(ways, lambda w: F.get(F.filter(first_ways(w), lambda v: v["end"] == F.length(target)), 0)["path"])
    # the programme isn't needed where the tokens' own texts, which are the first way, or the readings of one token decide
    owns = F.transform(cited, lambda t, i: region(F.get(ids, i), F.get(t["readings"], 0))).cast(f"array<{_REGION}>")
    alone = let(F.get(F.filter(F.get(cited, 0)["readings"], lambda c: c["flat"] == target), 0), lambda c: F.when(c.isNotNull(), F.array(region(F.get(ids, 0), c))))
    return F.when((F.size(ids) > 0) & _known(cited), F.when(own == target, owns).when(F.size(ids) == 1, alone).otherwise(whole))


def regions_box(found: Column) -> Column:
    """The box around all regions: x0, y0, x1, y1; null without any."""
    side = lambda k, f: f(F.transform(found, lambda r: F.get(r["bbox"], k)))
    return F.when(F.size(found) > 0, F.struct(side(0, F.array_min).alias("x0"), side(1, F.array_min).alias("y0"), side(2, F.array_max).alias("x1"), side(3, F.array_max).alias("y1")))


def evidence(fields: DataFrame, tokens: DataFrame, ids: str = "tokens") -> DataFrame:
    """fields (sheet_id, ids, verbatim, ...) with the columns regions, evidence_bbox, evidence_ok, outcome, extra and told.
    outcome: `none cited`, `ok`, `missing` (ids that the sheet lacks), `unlike` (the cited texts don't begin the verbatim),
    `incomplete` (the rest of the verbatim is in other tokens, whose ids are in extra) or `fabricated` (part of the rest is
    in no token); told: what the outcome is about."""
    found = stage(_with_tokens(fields, tokens), __ids=F.coalesce(F.col(ids).cast(_IDS), F.array().cast(_IDS)), __target=_flat(F.col("verbatim")))
    found = stage(found, __held=_held(F.col("__ids"), F.col("__target"), F.col("__t")))
    return _shown(found).drop("__t", "__ids", "__target", "__held")


def _with_tokens(fields: DataFrame, tokens: DataFrame) -> DataFrame:
    """fields with their sheet's tokens as the column __t, empty where the sheet has none."""
    return _or_none(fields.join(sheet_tokens(tokens).withColumnRenamed("by_id", "__t"), "sheet_id", "left"))


def _or_none(found: DataFrame) -> DataFrame:
    return found.withColumn("__t", F.coalesce("__t", F.create_map().cast(found.schema["__t"].dataType)))


def _held(ids: Column, target: Column, by_id: Column) -> Column:
    """What the cited tokens are to the target: a struct of regions, outcome, extra and told."""
    none = F.array().cast(_IDS)

    def left(cited: Column, own: Column) -> Column:
        # the rest of the verbatim is taken off by the tokens that aren't cited, in the order of their ids
        def take(at: Column, e: Column) -> Column:
            flat = e["value"]["flat"]
            fits = (flat != "") & F.startswith(at["rest"], flat) & ~F.array_contains(ids, e["key"])
            return F.when(fits, F.struct(F.substr(at["rest"], F.length(flat) + 1).alias("rest"), F.concat(at["extra"], F.array(e["key"])).alias("extra"))).otherwise(at)

        rest = F.substr(target, F.length(own) + 1)
        end = F.aggregate(F.map_entries(by_id), F.struct(rest.alias("rest"), none.alias("extra")), take)
        return let(end, lambda e: F.when(e["rest"] == "", told(None, "incomplete", e["extra"], rest)).otherwise(told(None, "fabricated", none, e["rest"])))

    def told(found: Column | None, outcome: str, extra: Column = none, about: Column | None = None) -> Column:
        text = F.lit(None).cast("string")
        return F.struct((F.lit(None) if found is None else found).cast(f"array<{_REGION}>").alias("regions"), F.lit(outcome).alias("outcome"), extra.alias("extra"), (text if about is None else about).alias("told"))

    def seen(cited: Column, own: Column) -> Column:
        missing = F.filter(ids, lambda i: ~F.array_contains(F.map_keys(by_id), i))
        listed = lambda m: F.when(F.size(m) > 0, told(None, "missing", none, F.array_join(m.cast("array<string>"), ", ")))
        unlike = F.when(~F.startswith(target, own), told(None, "unlike", none, own))
        read = let(_regions(ids, target, by_id, cited, own), lambda r: F.when(r.isNotNull() | (own == target), told(r, "ok")))
        lacking = F.when(~_known(cited), let(missing, listed))
        return F.coalesce(F.when(F.size(ids) == 0, told(None, "none cited")), lacking, read, unlike, left(cited, own))

    return let(_cited(ids, by_id), lambda cited: let(_own(cited), lambda own: seen(cited, own)))


def _shown(found: DataFrame) -> DataFrame:
    """found with the columns of __held."""
    held = F.col("__held")
    return found.withColumns({k: held[k] for k in ("regions", "outcome", "extra", "told")} | {"evidence_ok": held["outcome"].isin("none cited", "ok"), "evidence_bbox": regions_box(held["regions"])})


# --- replies -----------------------------------------------------------------------------------------------------------


def call_outcomes(calls: DataFrame) -> DataFrame:
    """(sheet_id, outcome, processing_status, processing_error) of each call of the model. calls: sheet_id, pending (the
    number of fields that rules left open), enabled, available, error (of the request), raw_response. A failed call leaves
    the rules' fields as they are; nothing pending, or a model that is switched off, is no failure."""
    parsed = F.try_parse_json(reply_object(F.col("raw_response"))).isNotNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    skipped = F.when(F.coalesce("pending", F.lit(0)) == 0, "nothing pending").when(~flag("available"), "unavailable")
    outcome = F.coalesce(skipped, F.when(F.col("error").isNotNull(), "request failed").when(~F.coalesce(parsed, F.lit(False)), "unreadable reply").otherwise("parsed"))
    said = F.when(F.col("outcome") == "request failed", F.concat(F.lit("the request to the model failed: "), "error")).when(F.col("outcome") == "unreadable reply", "the model's reply is no JSON object").when((F.col("outcome") == "unavailable") & flag("enabled"), "the model can't be reached, and fields are pending")
    out = calls.withColumn("outcome", outcome).withColumn("processing_error", said)
    return out.select("sheet_id", "outcome", F.when(F.col("processing_error").isNotNull(), "failed").otherwise("success").alias("processing_status"), "processing_error")


def reply_items(replies: DataFrame) -> DataFrame:
    """A row for each field of each reply (sheet_id, raw_response): name, tokens, verbatim, corrected, basis, confidence,
    reason, note. error is null, or says why a reply (name null) or a field could not be read. If replies have the column
    by_id, rows have it too."""
    keep = [c for c in replies.columns if c == "by_id"]
    # a reply is taken apart by one cast: what is no object is null; a value that is no text (a list, say) is shown as JSON
    texts = ("verbatim", "corrected", "correction_basis", "confidence", "reason", "note")
    item = f"map<string, struct<tokens: variant, {', '.join(f'{k}: string' for k in texts)}>>"
    parsed = stage(replies.select("sheet_id", *keep, "raw_response"), v=F.try_parse_json(reply_object(F.col("raw_response")))).drop("raw_response")
    items = stage(parsed, m=F.try_variant_get("v", "$", item)).drop("v")
    each = items.select("sheet_id", *keep, F.col("m").isNull().alias("bad"), F.explode_outer("m").alias("name", "item")).filter("bad OR item IS NOT NULL")
    given = F.col("item")["tokens"]
    whole = stage(each, tokens=F.try_variant_get(given, "$", _IDS), given=given, item=F.col("item"))
    odd = F.col("tokens").isNull() | F.exists("tokens", lambda i: i.isNull())
    # lists of nulls are as good as empty
    empty = F.col("given").isNull() | F.is_variant_null("given") | F.coalesce(F.size("tokens") == 0, F.lit(False)) | (odd & F.coalesce(F.schema_of_variant("given") == "ARRAY<VOID>", F.lit(False)))
    wrong = odd & ~empty
    error = F.when(F.col("bad"), "no JSON object").when(wrong, "tokens are no list of whole numbers")
    ids = F.when(~F.col("bad"), F.when(empty | wrong, F.array().cast(_IDS)).otherwise(F.col("tokens")))
    return whole.select("sheet_id", *keep, "name", ids.alias("tokens"), *[F.col("item")[k].alias("basis" if k == "correction_basis" else k) for k in texts], error.alias("error"))


def _completed(items: DataFrame, tokens: DataFrame | None) -> DataFrame:
    """items with their evidence; those that more tokens complete are held against the tokens again with these."""
    items = items.withColumn("tokens", F.col("tokens").cast(_IDS))
    met = _or_none(items.withColumnRenamed("by_id", "__t")) if tokens is None else _with_tokens(items, tokens)
    items = items.drop("by_id")
    found = stage(met, __ids=F.coalesce(F.col("tokens").cast(_IDS), F.array().cast(_IDS)), __target=_flat(F.col("verbatim")))
    first = stage(found, __held=_held(F.col("__ids"), F.col("__target"), F.col("__t")))
    extra = F.col("__held")["extra"]
    repaired = F.size(extra) > 0
    more = F.when(repaired, F.sort_array(F.array_union("tokens", extra))).otherwise(F.col("tokens"))
    again = stage(first, tokens=more, tokens_repaired=F.when(repaired, extra), __first=F.col("__held")["told"], __held=F.when(repaired, let(F.sort_array(F.array_union("__ids", extra)), lambda ids: _held(ids, F.col("__target"), F.col("__t")))).otherwise(F.col("__held")))
    return _shown(again.select(*items.columns, "__t", "tokens_repaired", "__first", "__held")).drop("__held")


def reply_fields(replies: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The fields that replies give, with their evidence: reply_items without the rows in error, and tokens (with those that
    complete the evidence), tokens_repaired, evidence_ok, outcome, regions, evidence_bbox, agreement, conf, adjudicated,
    corrected_signal, correction (`fix`, `normalize` or null), status, notes and source. Without tokens, replies have their
    sheet's as the column by_id, and nothing is joined."""
    found = _completed(reply_items(replies).filter("error IS NULL").drop("error"), tokens)
    least = lambda k: F.array_min(F.transform("tokens", lambda i: F.try_element_at(F.col("__t"), i)[k]))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kind = repair.correction_kind(F.col("verbatim"), F.col("corrected"), F.col("basis"))
    quoted = lambda c: F.coalesce(F.col(c), F.lit("nothing"))
    change = F.concat(quoted("verbatim"), F.lit(" -> "), quoted("corrected"))
    why = F.when(kind == "fix", F.concat(F.lit("corrected: "), change, F.lit(" ("), "basis", F.lit(")"))).when(kind == "normalize", F.concat(F.lit("normalized without a basis: "), change))
    notes = F.array_compact(F.array(F.when(some("note"), F.col("note")), F.when(F.col("tokens_repaired").isNotNull(), F.concat(F.lit("tokens added for: "), "__first")), F.when(~F.col("evidence_ok"), F.concat("outcome", F.lit(": "), "told")), why))
    out = found.withColumns({"agreement": least("agreement"), "conf": least("conf"), "adjudicated": some("note") | some("basis") | some("corrected"), "correction": kind, "corrected_signal": F.coalesce(kind == "fix", F.lit(False)), "status": F.lit("needs_review"), "source": F.lit("llm"), "notes": notes})
    return out.drop("__t", "__first", "extra", "told", "note")


def reply_summary(replies: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """Of each sheet the fields that its reply gave, those in error, those without evidence and those completed."""
    items = reply_items(replies)
    found = _completed(items.select("sheet_id", *[c for c in items.columns if c == "by_id"], "tokens", "verbatim", "error"), tokens)
    read = F.col("error").isNull()
    return found.groupBy("sheet_id").agg(F.count_if(~read).alias("n_errors"), F.count_if(read).alias("n_fields"), F.count_if(read & ~F.col("evidence_ok")).alias("n_unproven"), F.count_if(read & F.col("tokens_repaired").isNotNull()).alias("n_completed"))
