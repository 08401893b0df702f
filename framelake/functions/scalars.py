"""Scalar functions over columns: keys, hashes, dates out of names, intents, filters, contexts and clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_blanks(c: Column) -> Column:
    """Without any kind of blank at either end; trim() takes off spaces alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def query_cache_key(query: Column) -> Column:
    return F.substring(F.sha2(F.lower(strip_blanks(query)), 256), 1, 24)


def frame_cache_key(file_hash: Column, fps: Column, resolution: Column) -> Column:
    return F.substring(F.sha2(F.concat(file_hash, F.lit(":fps="), fps.cast("string"), F.lit(":res="), resolution.cast("string")), 256), 1, 16)


def body_hash(body: Column) -> Column:
    """Null for an empty body."""
    return F.when(F.length(body) > 0, F.sha2(body, 256))


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The first forwarded address, else the remote one."""
    first = F.trim(F.split(forwarded, ",")[0])
    return F.coalesce(F.when(first != "", first), remote)


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def date_from_name(path: Column) -> Column:
    """The date that cameras put into names; null if there is none or it is no date."""
    name = F.element_at(F.split(path, "/"), -1)
    camera = F.regexp_extract(name, r"(?i)(PXL|VID|IMG|MVIMG|PANO)_(\d{8})_", 2)
    drone = F.regexp_extract(name, r"(?i)DJI_(\d{8})", 1)
    return F.to_date(F.try_to_timestamp(F.coalesce(F.when(camera != "", camera), F.when(drone != "", drone)), F.lit("yyyyMMdd")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """In lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.[^.]+$", 0))


#: Keywords of intents and of audio filters, in their order.
AUDIO_WORDS = (
    "music", "singing", "song", "speech", "talking", "speaking", "sound", "audio", "hear", "noise", "voice", "dialogue", "conversation", "narration",
    "ambient", "silence", "quiet", "event", "applause", "crowd", "explosion", "vietnamese", "english", "french", "spanish", "japanese", "korean",
)
TEMPORAL_WORDS = ("when", "date", "year", "month", "before", "after", "during")
VISUAL_WORDS = ("look", "color", "show", "photo", "video", "picture", "scene")
SEGMENT_WORDS = (
    ("music", "music"), ("singing", "music"), ("song", "music"), ("melody", "music"), ("speech", "speech"), ("talking", "speech"), ("speaking", "speech"),
    ("dialogue", "speech"), ("conversation", "speech"), ("narration", "speech"), ("ambient", "ambient"), ("background noise", "ambient"), ("nature sounds", "ambient"),
    ("event", "event"), ("sound effect", "event"), ("explosion", "event"), ("gunshot", "event"), ("applause", "event"), ("crowd", "event"),
    ("silence", "silence"), ("quiet", "silence"), ("silent", "silence"),
)
SPEECH_WORDS = ("speaking", "talking", "speech", "dialogue", "conversation", "narration", "interview", "monologue", "voice")
LANGUAGES = ("chinese", "english", "french", "japanese", "korean", "spanish", "tagalog", "thai", "vietnamese")


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(words))


def intent(query: Column) -> Column:
    """mixed, audio, temporal or visual, by substrings (so 'seventh' holds 'event')."""
    audio, temporal, visual = (_has(query, w) for w in (AUDIO_WORDS, TEMPORAL_WORDS, VISUAL_WORDS))
    return F.when((audio & (temporal | visual)) | (temporal & visual), "mixed").when(audio, "audio").when(temporal, "temporal").otherwise("visual")


def audio_filters(query: Column) -> Column:
    """Struct of segment_type (of the first keyword in order that occurs; speech where only speech is asked for),
    has_speech and language_hint (the first of the alphabet, where the order is free)."""
    low = F.lower(query)
    first = lambda pairs: F.coalesce(*[F.when(low.contains(w), F.lit(v)) for w, v in pairs])
    speech = F.when(_has(query, SPEECH_WORDS), F.lit(True))
    return F.struct(F.coalesce(first(SEGMENT_WORDS), F.when(speech, F.lit("speech"))).alias("segment_type"), speech.alias("has_speech"), first([(x, x) for x in LANGUAGES]).alias("language_hint"))


def needs_vision(n_results: Column) -> Column:
    return F.when(n_results < 3, "vision").otherwise("aggregate")


def vision_inputs(results: Column, most: int = 3) -> Column:
    """Of an array of results (with file_type) in their order the images, the first three at most."""
    return F.slice(F.filter(results, lambda r: r["file_type"] == "image"), 1, most)


#: Labels of audio events and their segment type.
EVENT_TYPES = {
    "Speech": "speech", "Male speech, man speaking": "speech", "Female speech, woman speaking": "speech", "Child speech, kid speaking": "speech",
    "Conversation": "speech", "Narration, monologue": "speech", "Scream": "non_verbal", "Shout": "non_verbal", "Crying, sobbing": "non_verbal",
    "Laughter": "non_verbal", "Whispering": "non_verbal", "Singing": "non_verbal", "Groan": "non_verbal", "Grunt": "non_verbal",
    "Music": "music", "Musical instrument": "music", "Electronic music": "music", "Pop music": "music", "Hip hop music": "music", "Rock music": "music",
    "Background music": "music", "Crowd": "ambient", "Applause": "ambient", "Chatter": "ambient", "Hubbub, speech noise, speech babble": "ambient",
    "Gunshot, gunfire": "event", "Explosion": "event", "Alarm": "event", "Siren": "event", "Smoke detector, smoke alarm": "event", "Fire alarm": "event",
}


def segment_type_of(top: Column, labels: Column) -> Column:
    """The type of the first known label, the top one before the others; else non_verbal."""
    known = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    types = F.transform(F.concat(F.array(top), F.coalesce(labels, F.array().cast("array<string>"))), lambda x: F.when(x.isNotNull(), F.try_element_at(known, x)))
    return F.coalesce(F.try_element_at(F.filter(types, lambda x: x.isNotNull()), F.lit(1)), F.lit("non_verbal"))


def word_count(transcript: Column) -> Column:
    clean = strip_blanks(F.coalesce(transcript, F.lit("")))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, r"\s+")))


def segment_typing(transcript: Column, top: Column, labels: Column, threshold: int = 4, rms: Column | None = None) -> Column:
    """Struct of n_words, segment_type, the transcript, which only speech keeps, and has_speech: enough words, or an energy
    above 0.01."""
    n = word_count(transcript)
    said = F.coalesce(n >= threshold, F.lit(False))
    loud = F.coalesce(rms > 0.01, F.lit(False)) if rms is not None else F.lit(False)
    kind = F.when(said, F.lit("speech")).otherwise(segment_type_of(top, labels))
    return F.struct(n.alias("n_words"), kind.alias("segment_type"), F.when(said, transcript).alias("transcript"), (said | loud).alias("has_speech"))


def activity(rate: Column) -> Column:
    """Half-open bands of heart rate; outside all of them, below 40 too, vigorous."""
    return F.when((rate >= 40) & (rate < 70), "rest").when((rate >= 70) & (rate < 100), "light").when((rate >= 100) & (rate < 140), "moderate").otherwise("vigorous")


def stress_index(rate: Column, baseline: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(rate - baseline) / 60.0)


def color_features(r: Column, g: Column, b: Column, sr: Column, sg: Column, sb: Column) -> Column:
    """Struct of the hex colour of truncated means, the warmth and the colourfulness."""
    return F.struct(F.format_string("#%02x%02x%02x", *[x.cast("int") for x in (r, g, b)]).alias("hex"), (r - b).alias("warmth"), (sr + sg + sb).alias("colorfulness"))


def clip_bounds(ts: Column, start: Column, end: Column, padding: float = 3.0) -> Column:
    """The audio segment if it holds the time, else the time with padding, not before 0."""
    inside = F.coalesce((ts >= start) & (ts <= end), F.lit(False))
    return F.struct(F.when(inside, start).otherwise(F.greatest(F.lit(0.0), ts - padding)).alias("start_sec"), F.when(inside, end).otherwise(ts + padding).alias("end_sec"))


def clip_seconds(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.1), end - start)


def cited(answer: Column) -> Column:
    """Distinct citation numbers [n], in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def context_line(number: Column, path: Column, ts: Column, caption: Column, phase: Column) -> Column:
    """One numbered line; parts that are null are left out."""
    return F.concat_ws(" ", F.concat(F.lit("["), number.cast("string"), F.lit("]")), path, F.concat(F.lit("at "), F.round(ts, 1).cast("string"), F.lit("s")), F.concat(F.lit("- "), F.when(caption != "", caption)), F.concat(F.lit("("), phase, F.lit(")")))


def evaluation_context(caption: Column, path: Column) -> Column:
    return F.coalesce(F.when(caption != "", caption), path)


def notification(file_path: Column, file_type: Column, status: Column, error: Column, file_id: Column) -> Column:
    return F.to_json(F.struct(file_id.alias("id"), file_path.alias("file_path"), file_type.alias("file_type"), status.alias("status"), error.alias("error_message")))


NOTIFICATION = "id bigint, file_path string, file_type string, status string, error_message string"


def parse_notification(payload: Column) -> Column:
    """Null for malformed text."""
    return F.from_json(payload, NOTIFICATION)


def multi_hot(labels: Column, vocabulary: list[str]) -> Column:
    return F.array(*[F.array_contains(labels, F.lit(v)).cast("double") for v in vocabulary])


def frame_seconds(index: Column, fps: float = 0.5) -> Column:
    return index / F.lit(fps)


def valid_index(index: Column, frame_count: Column) -> Column:
    """Whether a video of so many frames has that one."""
    return F.coalesce((index >= 0) & (index < frame_count), F.lit(False))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def half_up(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def processing_plan(codec: Column, seconds: Column) -> Column:
    """Struct of the proxy plan and both timeouts in seconds."""
    plan = F.when(codec == "h264", "copy").when(seconds > 3600, "skip").otherwise("transcode")
    return F.struct(plan.alias("plan"), F.greatest(F.lit(1200), F.floor(seconds * 1.5).cast("int")).alias("extract_timeout"), F.greatest(F.lit(1800), F.floor(seconds * 5).cast("int") + 120).alias("encode_timeout"))


#: Names of months and seasons.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SEASONS = (("spring", (3, 4, 5)), ("summer", (6, 7, 8)), ("fall", (9, 10, 11)), ("autumn", (9, 10, 11)), ("winter", (12, 1, 2)))


def months_of(query: Column) -> Column:
    """The months of the first season that a query names, else its first month; 'may' is found inside 'maybe' too."""
    low = F.lower(query)
    pick = [F.when(low.contains(s), F.array(*map(F.lit, ms))) for s, ms in SEASONS]
    return F.coalesce(*pick, *[F.when(low.contains(m), F.array(F.lit(i + 1))) for i, m in enumerate(MONTHS)])


def year_of(query: Column) -> Column:
    """The first year from 1990 to 2029 that a query names, else null."""
    found = F.regexp_extract(query, r"\b(199\d|20[012]\d)\b", 1)
    return F.when(found != "", found.cast("int"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
