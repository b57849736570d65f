"""Rows that several tests use."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
# Extra columns whose names operators might use themselves.
CLASH = ("row", "key", "n", "size", "base", "spans", "comp", "words", "mark", "held_out", "draw", "score")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def rows_of(texts, start=1):
    """Rows of (id, text, lang, source) with the clashing columns filled."""
    out = []
    for k, entry in enumerate(texts):
        doc, text, lang, source = entry if isinstance(entry, tuple) else (start + k, entry, "en", "s")
        out.append((doc, text, lang, source, None if text is None else len(text), *["x"] * len(CLASH)))
    return out


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards box with five dozen liquor jugs"
# Nulls in any column, empty and white texts, ties, repeated rows, a very long text.
EDGE = rows_of(
    [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\r\n\f\x0b ", "fr", None),
        (None, PROSE, "en", "a"), (None, None, None, None), (5, PROSE.upper(), "en", "b"), (6, "x", "de", "b"),
        (7, ("word%d " * 4000) % tuple(range(4000)), "en", "a"), (8, "z" * 700_000, "en", "c"),
        (9, "É ß ñ 日本 🙂 " * 20, "fr", "c"), (10, "12 34 56", None, None),
    ]
)
