"""Scalar functions on text and cells, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.sequences import finite
from .compat import compatible, held

# The pattern of a token, and contractions with what they stand for, by match key.
TOKEN = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
EQUIVALENTS = {
    "cant": "cannot",
    "cannot": "cannot",
    "wont": "willnot",
    "willnot": "willnot",
    "dont": "donot",
    "donot": "donot",
    "doesnt": "doesnot",
    "doesnot": "doesnot",
    "didnt": "didnot",
    "didnot": "didnot",
    "isnt": "isnot",
    "isnot": "isnot",
    "arent": "arenot",
    "arenot": "arenot",
    "wasnt": "wasnot",
    "werent": "werenot",
    "im": "iam",
    "iam": "iam",
    "ive": "ihave",
    "ihave": "ihave",
    "ill": "iwill",
    "iwill": "iwill",
    "id": "iwould",
    "iwould": "iwould",
    "youre": "youare",
    "youare": "youare",
    "theyre": "theyare",
    "theyare": "theyare",
    "weve": "wehave",
    "wehave": "wehave",
    "theyve": "theyhave",
    "theyhave": "theyhave",
    "thats": "thatis",
    "thatis": "thatis",
}

# What a text's review status means, as reports say it; any other status is an ordinary record.
CONCLUSIONS = {
    "asr_empty_or_nonlexical_manual_review": "ASR为空或非词汇，词级时间定位不可依赖",
    "asr_text_mismatch_manual_review": "ASR与题目转写失配，保留低置信度回退时间并人工复核",
    "high_fallback_manual_review": "回退比例较高，作为低置信度文本并人工复核",
    "partial_invalid_timestamp_manual_review": "部分词缺少有效时间戳，保留无效原因并人工复核",
}
ORDINARY = "可作为常规文本对齐记录"


def tokenize(text: Column) -> Column:
    """The tokens of a text's compatibility form."""
    return F.regexp_extract_all(compatible(text), F.lit(TOKEN), F.lit(0))


def normalize_token(token: Column) -> Column:
    """Compatibility form, lower case, straight quotes, then letters, digits and apostrophes alone."""
    plain = F.translate(F.lower(compatible(token)), "‘’", "''")
    return F.regexp_replace(plain, r"[^a-z0-9']+", "")


def match_key(token: Column, equivalents: dict[str, str] | None = None) -> Column:
    """Normalised token without apostrophes, by way of a table of equivalents."""
    key = F.replace(normalize_token(token), F.lit("'"), F.lit(""))
    if not equivalents:
        return key
    table = F.create_map(*[F.lit(x) for pair in equivalents.items() for x in pair])
    return held(key, lambda k: F.coalesce(F.element_at(table, k), k))


def similar_enough(left: Column, right: Column, ratio: float) -> Column:
    """Edit distance by the longer length, at most ratio; empty strings are not similar."""
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    return (left != "") & (right != "") & (F.levenshtein(left, right) / longest <= ratio)


def natural_key(text: Column) -> Column:
    """What sorts names by their text, and by the numbers in it as numbers, however long: an array of (text in lower case, digits without leading zeros)."""
    pieces = F.regexp_extract_all(text, F.lit("[^0-9]*[0-9]+|[^0-9]+"), F.lit(0))

    def piece(p: Column) -> Column:
        digits = F.regexp_extract(p, "[0-9]+$", 0)
        value = F.regexp_replace(digits, "^0+(?=[0-9])", "")
        return F.struct(F.lower(F.substring(p, 1, F.length(p) - F.length(digits))).alias("text"), F.length(value).alias("size"), value.alias("digits"))

    return F.transform(pieces, piece)


#: What counts as a number in a cell.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def cell_equal(left: Column, right: Column, tolerance: float = 1e-5) -> Column:
    """Numbers within the tolerance where both sides are finite numbers, else equal text (so infinities equal themselves); nulls equal nulls."""
    texts = [c.cast("string") for c in (left, right)]
    a, b = (F.when(t.rlike(NUMBER), t.try_cast("double")) for t in texts)
    both = F.coalesce(finite(a) & finite(b), F.lit(False))
    return F.when(both, F.abs(a - b) <= tolerance).otherwise(texts[0].eqNullSafe(texts[1]))


def first_positive(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """The first positive finite value and the name of its choice: precedence of sources."""
    value, name = F.lit(None).cast("double"), F.lit("none")
    for label, c in reversed(choices):
        usable = finite(c) & (c > 0)
        value, name = F.when(usable, c).otherwise(value), F.when(usable, label).otherwise(name)
    return value, name


def safe_name(text: Column) -> Column:
    """A file name: runs of other characters than letters, digits, dot, underscore and dash become one underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def valid_run_id(text: Column) -> Column:
    """Whether a run's name has only letters, digits, dots, underscores and dashes; empty and null ones don't count."""
    return F.coalesce(text.rlike(r"^[\p{L}\p{N}._-]+\z"), F.lit(False))


def fraction(text: Column) -> Column:
    """30000/1001 as a number; 0 for what isn't a fraction or has the denominator 0."""
    parts = F.split(text, "/")
    value = F.try_divide(F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))
    return F.coalesce(F.when(F.size(parts) == 2, value), F.lit(0.0))


def crop_box(box: list[Column], width: int, height: int, margin: float) -> Column:
    """struct(left, top, right, bottom): the square around a box of relative corners, widened, in whole pixels within the frame; null if empty."""
    x0, y0, x1, y1 = box[0] * width, box[1] * height, box[2] * width, box[3] * height
    x, y, size = (x0 + x1) / 2, (y0 + y1) / 2, F.greatest(x1 - x0, y1 - y0) * (1 + margin)
    left, top = (F.greatest(F.lit(0.0), F.rint(c - size / 2)).cast("int") for c in (x, y))
    right, bottom = (F.least(F.lit(float(m)), F.rint(c + size / 2)).cast("int") for c, m in ((x, width), (y, height)))
    return F.when((size > 1) & (right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def detection_quality(box: list[Column], confidence: Column) -> Column:
    """Confidence times the root of the box's area, within [0, 1]."""
    area = F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))
    return F.least(F.greatest(confidence * F.sqrt(area), F.lit(0.0)), F.lit(1.0))


def conclusion(status: Column) -> Column:
    """The sentence of a review status; null and unknown ones are ordinary."""
    out = F.lit(ORDINARY)
    for k, v in CONCLUSIONS.items():
        out = F.when(status == k, v).otherwise(out)
    return out
