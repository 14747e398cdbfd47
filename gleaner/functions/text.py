"""Text clean-up, titles, prompts and instructions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from gleaner.functions.draws import SEED, draw, draw_unit

# Removal patterns of statute text, applied in this order.
CLEAN_PATTERNS = (
    r"^[①-⑳]\s?",
    r"^[1-9]{1,2}\.\s?",
    r" <개정\s(\d{4}\.\s?\d{1,2}\.\s?\d{1,2}[\.]?(?:,\s?\d{4}\.\s?\d{1,2}\.\s?\d{1,2})*)>",
    r" <신설\s(\d{4}\.\s?\d{1,2}\.\s?\d{1,2}[\.]?(?:,\s?\d{4}\.\s?\d{1,2}\.\s?\d{1,2})*)>",
    r"<\d{4}\.\s?\d{1,2}\.\s?\d{1,2}[\.]?>",
    r"\.\s*$",
    r"[「」,]",
)
# The characters a strip takes off, all Unicode white space.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# How part and chapter headings begin, and what marks a deleted clause.
PART_PATTERN = r"^제(\d+)편"
CHAPTER_PATTERN = r"^제(\d+)장"
DELETED_MARKER = "삭제"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Strip every kind of Unicode white space; trims from both ends, whatever lies in between."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def clean_text(c: Column | str, patterns: Sequence[str] = CLEAN_PATTERNS) -> Column:
    out = strip(c)
    for pattern in patterns:
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    return strip(out)


def leading_number(c: Column | str, pattern: str) -> Column:
    """The number a heading pattern captures, NULL where the text is no such heading."""
    return F.nullif(F.regexp_extract(_col(c), "(?U)" + pattern, 1), F.lit("")).cast("int")


def preamble_flag(key: Column | str) -> Column:
    """1 for a heading row (its key ends in 0), 0 for an article."""
    return F.when(_col(key).endswith("0"), 1).otherwise(0)


def is_deleted(content: Column | str, marker: str = DELETED_MARKER) -> Column:
    return strip(content).endswith(marker)


def compose_title(
    law: str | Column,
    article: Column | str = "article",
    branch: Column | str = "article_branch",
    paragraph: Column | str = "paragraph",
    subparagraph: Column | str = "subparagraph",
) -> Column:
    law = F.lit(law) if isinstance(law, str) else law
    article, branch, paragraph, subparagraph = map(_col, (article, branch, paragraph, subparagraph))
    return F.concat(
        law,
        F.format_string(" 제%d조", article),
        F.when(branch == 1, "").otherwise(F.format_string("의%d", branch)),
        F.when(paragraph == 0, "").otherwise(F.format_string(" 제%d항", paragraph)),
        F.when(subparagraph == 0, "").otherwise(F.format_string(" 제%d호", subparagraph)),
    )


def respace_title(title: Column | str, law: str | Column) -> Column:
    """Law name, then the title with a space before every ordinal mark but a leading one."""
    law = F.lit(law) if isinstance(law, str) else law
    return F.concat(law, F.lit(" "), F.regexp_replace(_col(title), r"(?<!^)(?=제)", " "))


def split_labels(labels: Column | str, sep: str = ",") -> Column:
    """The parts of a packed label; the separator is taken as it stands, not as a pattern."""
    return F.split(_col(labels), "".join(f"[{c}]" if c not in "^\\[]" else "\\" + c for c in sep))


def only_family(labels: Column | str, prefix: str, sep: str = ",") -> Column:
    """True where every packed label starts with the prefix. Parts are not trimmed."""
    return F.forall(split_labels(labels, sep), lambda label: label.startswith(F.lit(prefix)))


def first_label(labels: Column | str, sep: str = ",") -> Column:
    return F.get(split_labels(labels, sep), F.lit(0))


def instruction_text(template: str, k: int) -> str:
    """The instruction sent along with every prompt: the wanted number stands in for #K#."""
    return template.replace("#K#", str(k))


def render_prompt(id: Column | str, title: Column | str, query: Column | str) -> Column:
    return F.concat(
        F.lit('"id" : '), _col(id).cast("string"),
        F.lit(', "title" : '), _col(title),
        F.lit(', "query" : "'), _col(query), F.lit('"'),
    )


def fill_format(fmt: str, *values: Column) -> Column:
    """A '{}' format with its places filled in order."""
    pieces = fmt.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"format {fmt!r} needs {len(pieces) - 1} values, got {len(values)}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def shuffle_chunks(c: Column | str, ratio: float, *key: Column | str, seed: int = SEED) -> Column:
    """With probability ratio, cut a text of over 100 characters in chunks of len//3+1 and shuffle them."""
    c = _col(c)
    if ratio <= 0:
        return c
    length = F.char_length(c)
    size = F.floor(length / 3).cast("int") + 1
    starts = F.sequence(F.lit(1), length, size)
    drawn = F.array_sort(
        F.transform(starts, lambda at: F.struct(draw(seed, F.lit("chunk"), *key, at).alias("d"), at.alias("at")))
    )
    chunks = F.transform(drawn, lambda s: F.substring(c, s["at"], size))
    picked = (length > 100) & (draw_unit(seed, F.lit("shuffle"), *key) < ratio)
    return F.when(picked, F.array_join(chunks, " ")).otherwise(c)
