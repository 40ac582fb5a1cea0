"""Recordings from the segments of their parts to a transcript under people's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import transcripts

#: Seconds from which a voice counts, that its reference needs at least and has at most, and width of the stretches in which overlaps are looked for.
HEARD, REFERENCE, CLIP, STRETCH = 20.0, 2.0, 9.9, 60.0
KEY = ["recording", "speaker"]


def whole(segments: DataFrame, offsets: DataFrame, known: DataFrame) -> DataFrame:
    """Segments (recording, part, start, end, speaker, text) on their recording's clock, empty ones left out; a part without an offset has failed and is left out.

    Of a recording of several parts, labels that aren't known names (recording, name) are told apart by part, as a letter means another voice in each.
    """
    at = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) + F.col("offset_s"), 2).alias(c)
    placed = segments.join(offsets.select("recording", "part", "offset_s"), ["recording", "part"]).where(X.strip(F.coalesce("text", F.lit(""))) != "")
    named = placed.select("recording", "part", at("start"), at("end"), X.strip(F.coalesce("speaker", F.lit(""))).alias("speaker"), X.strip(F.col("text")).alias("text"))
    parts = offsets.groupBy("recording").agg((F.count("*") > 1).alias("_several"))
    told = named.join(parts, "recording").join(_names(known), KEY, "left")
    label = F.when(F.col("_several") & F.col("known").isNull() & (F.col("speaker") != ""), F.concat("speaker", F.lit("·p"), (F.col("part") + 1).cast("string"))).otherwise(F.col("speaker"))
    return told.withColumn("speaker", label).drop("_several", "known")


def _names(known: DataFrame) -> DataFrame:
    return known.select("recording", F.col("name").alias("speaker"), F.lit(True).alias("known")).distinct()


def voices(segments: DataFrame, known: DataFrame, least: float = HEARD) -> DataFrame:
    """(recording, speaker, ident, known, seconds, n, clip_start, clip_s) of the voices that count: known names, and others with ``least`` seconds.

    ident is a known name itself, else SPEAKER_NN in the order in which they first speak. The clip is the longest stretch that nobody else overlaps, or if there is
    none the longest, from 1 second to CLIP.
    """
    n = segments.groupBy(*KEY).agg(F.round(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))), 2).alias("seconds"), F.count("*").alias("n"), F.min(F.struct("start", "part", "end")).alias("first"))
    counted = n.join(_names(known), KEY, "left").withColumn("known", F.coalesce("known", F.lit(False))).where(F.col("known") | (F.col("seconds") >= least))
    number = F.count_if(~F.col("known")).over(Window.partitionBy("recording").orderBy("first", "speaker"))
    told = counted.withColumn("ident", F.when(F.col("known"), F.col("speaker")).otherwise(F.format_string("SPEAKER_%02d", number)))
    clips = clip(segments).select(*KEY, F.col("start").alias("clip_start"), F.col("clip_s"))
    return told.join(clips, KEY).select(*KEY, "ident", "known", "seconds", "n", "clip_start", "clip_s")


def clip(segments: DataFrame) -> DataFrame:
    """Each voice's best stretch: of one voice without another in between, clean ones first, the longest, the earliest of equals."""
    runs = transcripts.turns(segments, "recording", ["start", "part", "end"], "speaker", "start", "end")
    clean = transcripts.overlap_free(runs, "recording", "island", "speaker", "start", "end", STRETCH).select("recording", "island", F.lit(True).alias("clean"))
    return transcripts.best_run(runs.join(clean, ["recording", "island"], "left"), "recording", "speaker", "start", "end", F.coalesce("clean", F.lit(False)), 1.0, CLIP)


def enrolled(segments: DataFrame, known: DataFrame, most: int = 4) -> DataFrame:
    """(recording, speaker, name, start, clip_s): new references from one part's segments, for the parts after it.

    Voices that aren't known, those that speak longest first, as long as there is room for ``most`` with the known ones; each needs a clip of REFERENCE seconds.
    Names are HABLANTE_N, numbered on from those known.
    """
    names = _names(known)
    n = segments.where(F.col("speaker") != "").groupBy(*KEY).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("seconds"))
    fresh = n.join(names, KEY, "left_anti").join(clip(segments).select(*KEY, "start", "clip_s"), KEY).where(F.col("clip_s") >= REFERENCE)
    held = names.groupBy("recording").agg(F.count("*").alias("_held"), F.count_if(F.col("speaker").startswith("HABLANTE_")).alias("_numbered"))
    ranked = fresh.withColumn("_place", F.row_number().over(Window.partitionBy("recording").orderBy(F.desc("seconds"), "speaker"))).join(held, "recording", "left")
    room = ranked.where(F.col("_place") <= most - F.coalesce("_held", F.lit(0)))
    return room.select(*KEY, F.concat(F.lit("HABLANTE_"), (F.col("_place") + F.coalesce("_numbered", F.lit(0))).cast("string")).alias("name"), "start", "clip_s")


def named(heard: DataFrame, decisions: DataFrame) -> DataFrame:
    """(recording, speaker, name, status) of voices by the decisions (recording, ident, name, target, ignored) on them; known voices keep their names.

    A decision may send a voice on to another; chains are followed, in each recording by itself. Voices without a decision are unresolved and have no name.
    """
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct("recording", F.col(c).alias("ident")))
    own = heard.where("not known").select("recording", "ident").join(decisions, ["recording", "ident"], "left")
    ends = transcripts.resolve_aliases(own.select(key("ident").alias("ident"), "name", key("target").alias("target"), F.coalesce("ignored", F.lit(False)).alias("ignored")))
    told = ends.select("ident.recording", "ident.ident", "name", "status")
    both = heard.select(*KEY, "ident", "known").join(told, ["recording", "ident"], "left")
    return both.select(*KEY, F.when(F.col("known"), F.col("ident")).otherwise(F.trim("name")).alias("name"), F.when(F.col("known"), "known").otherwise(F.col("status")).alias("status"))


def transcript(segments: DataFrame, names: DataFrame) -> DataFrame:
    """(recording, turn from 0, name, start, end, text): turns under the final names; voices without one are left out, and what they part is one turn."""
    kept = segments.join(names.where("name is not null").select(*KEY, "name"), KEY)
    found = transcripts.turns(kept, "recording", ["start", "part", "end"], "name", "start", "end", "text")
    return found.select("recording", F.col("island").cast("long").alias("turn"), "name", "start", "end", "text")


def written(turns: DataFrame, line: Column | None = None) -> DataFrame:
    """(recording, text): a line «name: text» for each turn, in order."""
    own = F.concat("name", F.lit(": "), "text") if line is None else line
    return turns.groupBy("recording").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", own.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
