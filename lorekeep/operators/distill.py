"""Distillation of records into notes: transcript detection, note checks, managed regions, note paths."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import front_matter, slug

# Bounds of a note that is a transcript in disguise, and the marks of a managed region.
TURNS, SPEAKER_SHARE, QUOTED_LINES, QUOTED_CHARS = 12, 0.30, 12, 2400
BEGIN, END = "%% notes:distilled-begin %%", "%% notes:distilled-end %%"
_BEGIN, _END = (re.compile(rf"%% [a-z-]+:distilled-{x} %%") for x in ("begin", "end"))
TIMED = r"^\s*(?:[-*]\s*)?\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s+\S"
SPOKEN = r"^\s*(?:[-*]\s*)?(?:\*\*)?[\p{Lu}][\p{L} .'-]{0,60}(?:\*\*)?:\s+\S"
QUOTED = r"^\s*>"
LINK = re.compile(r"artifact://[a-z-]+/art_[a-z2-7]{32}")


def is_transcript(text: Column) -> Column:
    """Twelve timed turns, nearly a third of the lines spoken, or long quotations."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    of = lambda p: F.filter(lines, lambda x: F.rlike(x, F.lit(p)))
    spoken, quoted = F.size(of(SPOKEN)), of(QUOTED)
    long_quote = (F.size(quoted) > QUOTED_LINES) | (F.length(F.array_join(quoted, "")) > QUOTED_CHARS)
    return (F.size(of(TIMED)) >= TURNS) | ((spoken >= 4) & (spoken >= SPEAKER_SHARE * F.size(lines))) | long_quote


def system_only(before: Column, after: Column, operation: Column) -> Column:
    """A new or edited system message, or the removal of one, doesn't reopen a root; becoming one does."""
    is_system = lambda c: F.coalesce(F.lower(c) == "system", F.lit(False))
    return F.when(operation == "upsert", is_system(after) & (before.isNull() | is_system(before))).otherwise(is_system(before))


def note_path(folder: Column, title: Column, day: Column, artifact: Column) -> Column:
    """folder/date-slug-id.md with the first ten characters of the id's digest."""
    name = F.substring(F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("untitled")), 1, 60)
    return F.concat_ws("/", folder, F.concat_ws("-", F.date_format(day, "yyyy-MM-dd"), name, F.concat(F.substring(artifact, 5, 10), F.lit(".md"))))


def replace_managed(text: str, content: str) -> str:
    """The note with what stands between its marks replaced; text outside them is kept.

    A note without marks gets them at its end; any other number or order of marks is an error.
    """
    region = managed(text)
    if region is None:
        return f"{text.rstrip()}\n\n{BEGIN}\n{content.strip()}\n{END}\n"
    return f"{text[: region[0]]}\n{content.strip()}\n{text[region[1] :]}"


def managed(text: str) -> tuple[int, int] | None:
    """Where the managed region starts and ends, within its marks; None without marks."""
    begins, ends = list(_BEGIN.finditer(text)), list(_END.finditer(text))
    if not begins and not ends:
        return None
    if len(begins) != 1 or len(ends) != 1 or begins[0].start() > ends[0].start():
        raise ValueError("the note's managed region is broken")
    return begins[0].end(), ends[0].start()


def safe_path(path: str, taken: set[str] = frozenset()) -> str:
    """A relative Markdown path below the vault; traversal, drives and case collisions are errors."""
    parts = path.replace("\\", "/").split("/")
    if path.startswith(("/", "\\")) or ":" in parts[0] or any(p in ("", ".", "..") or p.startswith(".") for p in parts) or not path.lower().endswith(".md"):
        raise ValueError(f"unsafe note path {path!r}")
    clean = "/".join(parts)
    if any(t.casefold() == clean.casefold() and t != clean for t in taken):
        raise ValueError(f"{clean!r} differs from another note only by case")
    return clean


def note_problems(text: str, *, memory_id: str, context: set[str], required: dict[str, str] | None = None) -> list[str]:
    """What keeps a note from completing a distillation; empty for a sound one.

    Its front matter must say what is required, its managed region must be whole, and the links
    under `## Evidence` must be there and lie within the root's context.
    """
    meta, body = front_matter(text)
    out = [] if meta else ["front matter"]
    for key, value in ({"memory_id": memory_id} | (required or {})).items():
        if str(meta.get(key, "")) != value:
            out.append(key)
    if meta.get("updated") is not None and not calendar_date(str(meta["updated"])):
        out.append("updated")
    try:
        whole = managed(body) is not None
    except ValueError:
        whole = False
    if not whole:
        out.append("managed region")
    evidence = re.search(r"^##\s+Evidence\s*$(.*?)(?=^##\s|\Z)", body, re.MULTILINE | re.DOTALL)
    links = set(LINK.findall(evidence.group(1))) if evidence else set()
    if not links:
        out.append("evidence")
    elif links - context:
        out.append("evidence outside the context")
    if set(LINK.findall(body)) - links:
        out.append("links outside the evidence")
    return out


def calendar_date(value: str) -> bool:
    try:
        return date.fromisoformat(value[:10]).isoformat() == value[:10] and len(value) == 10
    except ValueError:
        return False
