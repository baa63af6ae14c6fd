"""Small rules of reading and asking as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import clean

MINIMUM_READABLE = 80
OUTLINE_CHARACTERS, ABSTRACT_CHARACTERS, SELECTION_CHARACTERS = 6_000, 3_000, 4_000


def outline(sections: Column, title: Column, most: int = OUTLINE_CHARACTERS) -> Column:
    """Of sections in order: "- section" lines of the distinct ones, up to the first that would pass `most` characters; the title's line if there is none."""
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def onto(held: Column, section: Column) -> Column:
        longer = F.concat(held["text"], F.when(held["text"] == "", "").otherwise(F.lit("\n")), F.lit("- "), section)
        fits = held["open"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(held["text"]).alias("text"), fits.alias("open"))

    made = F.aggregate(F.array_distinct(sections), start, onto, lambda held: held["text"])
    return F.when(made != "", made).otherwise(F.concat(F.lit("- "), title))


def is_abstract(section: Column) -> Column:
    """Whether a section path ends with an abstract."""
    return F.coalesce(section.rlike(r"(?i)(?:^| > )(?:abstract|摘要)$"), F.lit(False))


def abstract(blocks: Column, most: int = ABSTRACT_CHARACTERS) -> Column:
    """Of blocks (text, section) in order: those of the abstract, joined by line ends and cut."""
    return F.left(F.array_join(F.transform(F.filter(blocks, lambda b: is_abstract(b["section"])), lambda b: b["text"]), "\n"), F.lit(most))


def is_study_heading(type_: Column, level: Column) -> Column:
    """Whether a block is a heading for a table of contents: any but those of the first level."""
    return F.coalesce((type_ == "heading") & (F.coalesce(level, F.lit(2)) >= 2), F.lit(False))


def media_place(order: Column, section: Column, sections: Column) -> Column:
    """The block number before which a picture stands: its own, within bounds, else behind its section's last block, else the end."""
    last = F.array_max(F.transform(sections, lambda s, k: F.when(s == section, k + 1)))
    return F.coalesce(F.when(order.isNotNull(), F.least(F.greatest(order, F.lit(0)), F.size(sections))), last, F.size(sections))


def unchanged_translation(source: Column, output: Column) -> Column:
    """Whether a plain lower-case English phrase came back as it was, which is asked again."""
    given = clean(source)
    return (F.length(given) > 1) & given.rlike("^[a-z][a-z '-]*$") & (given == F.lower(clean(output)))


def selection(text: Column, most: int = SELECTION_CHARACTERS) -> Column:
    """Selected text for a translation; empty if nothing is selected."""
    return F.left(clean(text), F.lit(most))


def selection_scope(tag: Column, source_level: Column) -> Column:
    """scope and heading_level of a selection in a heading (its tag; a level kept from the source counts first); null elsewhere."""
    own = F.regexp_extract(F.lower(tag), "^h([1-6])$", 1).try_cast("int")
    level = F.when(F.coalesce(source_level, F.lit(0)) != 0, source_level).otherwise(own)
    return F.when(own.isNotNull() & level.between(1, 6), F.struct(F.lit("section").alias("scope"), level.alias("heading_level")))


def default_diagnostics(blocks: Column) -> Column:
    """Counters for an article that was read without any: its blocks all taken from the body."""
    length = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    same = {"readable_length": length, "root_text_length": length, "candidate_block_count": F.size(blocks), "accepted_block_count": F.size(blocks)}
    none = ("excluded_block_count", "empty_block_count", "article_candidate_count", "main_candidate_count", "role_main_candidate_count", "iframe_count", "canvas_count", "table_count", "shadow_root_count", "loading_indicator_count", "fallback_block_count")
    return F.struct(F.lit("body").alias("root_kind"), F.lit(MINIMUM_READABLE).alias("minimum_readable_length"), F.lit(False).alias("fallback_used"), *(v.alias(k) for k, v in same.items()), *(F.lit(0).alias(k) for k in none))


def image_crop(rect: Column, viewport: Column, width: Column, height: Column) -> Column:
    """x, y, width, height in an image of the viewport of what is seen of rect (left, top, width, height); null if nothing is, or for empty sizes.

    viewport: width, height, offset_left, offset_top. Halves are rounded up.
    """
    near = lambda x: F.floor(x + 0.5).cast("int")
    side = lambda at, size, offset, whole: (F.greatest(F.lit(0.0), at - offset), F.least(whole.cast("double"), at - offset + size))
    left, right = side(rect["left"], rect["width"], viewport["offset_left"], viewport["width"])
    top, bottom = side(rect["top"], rect["height"], viewport["offset_top"], viewport["height"])
    across, down = width / viewport["width"], height / viewport["height"]
    x, y = near(left * across), near(top * down)
    w, h = (F.greatest(F.lit(1), near(n)) for n in ((right - left) * across, (bottom - top) * down))
    seen = (right > left) & (bottom > top) & (width > 0) & (height > 0) & (viewport["width"] > 0) & (viewport["height"] > 0)
    return F.when(seen, F.struct(x.alias("x"), y.alias("y"), F.least(width.cast("int") - x, w).alias("width"), F.least(height.cast("int") - y, h).alias("height")))


def assistant_text(response: Column) -> Column:
    """The text of a model's answer in JSON: its first choice's content, or the text parts of it joined; null if empty."""
    content = F.try_variant_get(F.try_parse_json(response), "$.choices[0].message.content", "variant")
    kind = F.schema_of_variant(content)
    parts = F.filter(F.try_variant_get(content, "$", "array<struct<type: string, text: string>>"), lambda p: (p["type"] == "text") & p["text"].isNotNull())
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    trimmed = F.regexp_replace(F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), joined), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def request_text(content: Column, mark: str = "[image left out, {} characters]") -> Column:
    """text and images of a request's content (parts of type, text, url): a note of its length stands for each image."""
    before, behind = mark.split("{}")
    note = lambda p: F.concat(F.lit(before), F.length(p["url"]).cast("string"), F.lit(behind))
    lines = F.transform(content, lambda p: F.when(p["type"] == "text", p["text"]).otherwise(note(p)))
    return F.struct(F.array_join(lines, "\n").alias("text"), F.size(F.filter(content, lambda p: p["type"] != "text")).alias("images"))


def message_length(content: Column) -> Column:
    """Characters of a message's parts: of texts and of image addresses."""
    return F.aggregate(content, F.lit(0), lambda n, p: n + F.when(p["type"] == "text", F.length(p["text"])).otherwise(F.length(p["url"])))


def reference_text(reference: Column) -> Column:
    """What a question refers to, for finding it again: text, section, and an image's description."""
    parts = F.array(reference["text"], reference["section"], F.when(reference["type"] == "image", reference["alt"]))
    return F.coalesce(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n"), F.lit(""))


def checkpoint_covers(covered: Column, through: Column, answers: Column) -> Column:
    """How many of the compacted turns (answers: their answers' ids, in order) a checkpoint stands for; 0 if it doesn't match them."""
    fits = covered.between(1, F.size(answers)) & (F.get(answers, covered - 1) == through)
    return F.when(F.coalesce(fits, F.lit(False)), covered).otherwise(0)


def to_compact(covered: Column, through: Column, answers: Column) -> Column:
    """What a new checkpoint is made of: whether the old one stays its base, the answers not yet covered, how far it will reach; null without turns."""
    done = checkpoint_covers(covered, through, answers)
    rest = F.slice(answers, done + 1, F.size(answers))
    made = F.struct((done > 0).alias("keeps_previous"), rest.alias("answers"), F.try_element_at(answers, F.lit(-1)).alias("through"), F.size(answers).alias("covered"), (F.size(rest) > 0).alias("needs_update"))
    return F.when(F.size(answers) > 0, made)


def checkpoint_record(parsed: Column, through: Column, covered: Column, previous_created_at: Column, now: Column) -> Column:
    """A checked checkpoint with what it covers and its times; created_at is that of the first one. Null for what isn't valid."""
    at = now.cast("long")
    return F.when(parsed.isNotNull(), F.struct(parsed.alias("state"), through.alias("through"), covered.alias("covered"), F.coalesce(previous_created_at, at).alias("created_at"), at.alias("updated_at")))
